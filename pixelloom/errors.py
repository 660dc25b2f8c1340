"""Errors as data: struct<kind, message>, first failing check first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<kind: string, message: string>"
FORMAT, STATE, RANGE, UNSUPPORTED = "FormatException", "StateError", "RangeError", "UnsupportedError"


class ImageError(ValueError):
    """An error of one of the kinds above, raised where bytes are handled in Python."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message

    def row(self) -> dict[str, str]:
        return {"kind": self.kind, "message": self.message}


def error(kind: str, message: Column | str) -> Column:
    """An error struct; message may be an expression."""
    return F.struct(F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def first_error(*checks: tuple[Column, Column]) -> Column:
    """The error of the first check (condition, error) whose condition holds, else null."""
    out = F.lit(None).cast(SCHEMA)
    for condition, found in reversed(checks):
        out = F.when(condition, found).otherwise(out)
    return out


def fail_fast(error_col: Column) -> Column:
    """error_col, raising when it is not null."""
    return F.when(error_col.isNotNull(), F.raise_error(F.concat_ws(": ", error_col["kind"], error_col["message"]))).otherwise(error_col)
