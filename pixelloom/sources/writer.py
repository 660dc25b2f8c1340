"""Writing Part-10 files: explicit or implicit, either byte order, native or encapsulated pixel data."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.dictionaries import EXPLICIT_BE, EXPLICIT_LE, IMPLICIT_LE, LONG_VRS, TAG
from pixelloom.sources import ROWS, RUN
from pixelloom.sources.part10 import PIXEL_DATA, implicit_vr

BINARY = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}


def encoded(vr: str, value: object, little: bool = True) -> bytes:
    """A value as bytes of even length: numbers by VR, text padded with a space (UIDs with NUL)."""
    order = "<" if little else ">"
    if isinstance(value, bytes):
        raw = value
    elif vr in BINARY:
        values = value if isinstance(value, (list, tuple)) else [value]
        raw = struct.pack(f"{order}{len(values)}{BINARY[vr]}", *values)
    else:
        values = value if isinstance(value, (list, tuple)) else [value]
        raw = "\\".join(str(v) for v in values).encode()
    return raw + ((b"\0" if vr in ("UI", "OB", "OW", "UN") else b" ") if len(raw) % 2 else b"")


def element(tag: int, value: object, vr: str | None = None, little: bool = True, explicit: bool = True) -> bytes:
    vr = vr or implicit_vr(tag)
    raw = encoded(vr, value, little)
    order = "<" if little else ">"
    head = struct.pack(f"{order}HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack(f"{order}I", len(raw)) + raw
    if vr in LONG_VRS:
        return head + vr.encode() + b"\0\0" + struct.pack(f"{order}I", len(raw)) + raw
    return head + vr.encode() + struct.pack(f"{order}H", len(raw)) + raw


def encapsulated(fragments: list[bytes], offsets: list[int] | None = None, vr: str = "OB") -> bytes:
    """Pixel data of undefined length: offset table, fragments, end mark."""
    out = struct.pack("<HH", 0x7FE0, 0x0010) + vr.encode() + b"\0\0" + struct.pack("<I", 0xFFFFFFFF)
    table = struct.pack(f"<{len(offsets or [])}I", *(offsets or []))
    for body in (table, *fragments):
        body += b"\0" * (len(body) % 2)
        out += struct.pack("<HHI", 0xFFFE, 0xE000, len(body)) + body
    return out + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def part10(values: dict[str, object] | list[tuple[int, str, object]], syntax: str = EXPLICIT_LE, pixel_data: bytes | None = None, wrapped: bytes | None = None, preamble: bool = True) -> bytes:
    """A file of the given elements (by keyword, or as tag, VR, value) in tag order.

    pixel_data is the native form; wrapped is a whole encapsulated pixel data element.
    """
    little, explicit = syntax != EXPLICIT_BE, syntax != IMPLICIT_LE
    rows = [(TAG[k], implicit_vr(TAG[k]), v) for k, v in values.items()] if isinstance(values, dict) else list(values)
    out = b"\0" * 128 + b"DICM" if preamble else b""
    out += element(TAG["TransferSyntaxUID"], syntax, "UI")
    for tag, vr, value in sorted(rows, key=lambda r: r[0]):
        out += element(tag, value, vr, little, explicit)
    if pixel_data is not None:
        out += element(PIXEL_DATA, pixel_data, "OW", little, explicit)
    return out + (wrapped or b"")


def write_instances(rows: DataFrame, build: Callable[[dict], bytes], id_col: str) -> DataFrame:
    """file_id and content: build's bytes for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.string())
            for at in range(0, batch.num_rows, ROWS):
                begin, got, held, end = at, [], 0, min(at + ROWS, batch.num_rows)
                for i, row in enumerate(batch.slice(at, ROWS).to_pylist(), at + 1):
                    got.append(build(row))
                    held += len(got[-1])
                    if held >= RUN or i == end:
                        yield pa.RecordBatch.from_arrays([ids.slice(begin, len(got)), pa.array(got, pa.binary())], names=["file_id", "content"])
                        begin, got, held = i, [], 0

    return rows.mapInArrow(run, "file_id string, content binary")


def packed_int16(values: list[int], little: bool = True) -> bytes:
    return np.asarray(values, "<i2" if little else ">i2").tobytes()


def head_phantom(spark: SparkSession, size: int = 256) -> DataFrame:
    """A CT head section as pixels (i, x, y, stored): air, skull ring, fluid core and brain, each HU + 1024.

    The radii are fixed shares of a 256-pixel frame, scaled with size.
    """
    mid = size // 2
    x, y = F.pmod(F.col("i"), F.lit(size)), F.floor(F.col("i") / size)
    square: Column = (x - mid) * (x - mid) + (y - mid) * (y - mid)
    r = lambda n: (n * size / 256) ** 2
    hu = F.when(square >= r(110), F.lit(-1000)).when(square > r(95), F.lit(1000)).when(square < r(30), F.lit(15)).otherwise(F.lit(40))
    return spark.range(size * size).withColumnRenamed("id", "i").select("i", x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), (hu + 1024).cast("bigint").alias("stored"))
