"""Automatic windows: the range of rescaled values of a frame, padding left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.pixels import is_padding


def auto_window(pixels: DataFrame, keys: list[str], value: Column, stored: Column | None = None, padding: Column | None = None, limit: Column | None = None) -> DataFrame:
    """keys, auto_center and auto_width from exploded pixels: one partial aggregation.

    Pixels in the padding range don't count, unless all are; without values the window is 128/256.
    """
    kept = value if padding is None else F.when(~is_padding(stored, padding, F.lit(None).cast("bigint") if limit is None else limit), value)
    low, high = F.coalesce(F.min(kept), F.min(value)), F.coalesce(F.max(kept), F.max(value))
    ranges = pixels.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"))
    return ranges.select(*keys, *_window(F.col("_low"), F.col("_high")))


def _window(low: Column, high: Column) -> tuple[Column, Column]:
    top = F.when(high == low, low + 1.0).otherwise(high)
    center = F.coalesce(low + (top - low) / 2.0, F.lit(128.0))
    width = F.when(low.isNull(), F.lit(256.0)).otherwise(F.greatest(top - low, F.lit(1.0)))  # greatest() skips nulls
    return center.alias("auto_center"), width.alias("auto_width")


def auto_window_array(values: Column, stored: Column | None = None, padding: Column | None = None, limit: Column | None = None) -> tuple[Column, Column]:
    """The same from a frame's arrays: centre and width."""
    if padding is not None:
        pairs = F.filter(F.arrays_zip(values.alias("v"), stored.alias("s")), lambda p: ~is_padding(p["s"], padding, F.lit(None).cast("bigint") if limit is None else limit))
        kept = F.transform(pairs, lambda p: p["v"])
        values = F.when(F.size(kept) > 0, kept).otherwise(values)
    return _window(F.array_min(values), F.array_max(values))
