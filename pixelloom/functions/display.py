"""What a viewer shows beside the pixels: aspect ratio, overlay text, presets, cine frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least and greatest zoom, and clinical window presets (name, centre, width).
ZOOM = (0.5, 5.0)
PRESETS = [("Brain", 40.0, 80.0), ("Lung", -600.0, 1500.0), ("Bone", 400.0, 1800.0), ("Soft tissue", 40.0, 400.0)]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, preset_center double, preset_width double")


def with_presets(frames: DataFrame) -> DataFrame:
    """Each frame once for each of the four presets, from a literal array: nothing is joined or exchanged."""
    rows = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(c).alias("preset_center"), F.lit(w).alias("preset_width")) for n, c, w in PRESETS])
    return frames.select("*", F.inline(rows))


def aspect_ratio(rows: Column, columns: Column, row_spacing: Column, column_spacing: Column) -> Column:
    """Shown width by height: with both spacings finite and positive by them, else columns by rows; 1 without an area."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    plain = columns.cast("double") / F.nullif(rows.cast("double"), F.lit(0.0))
    spaced = (columns * column_spacing) / F.nullif(rows * row_spacing, F.lit(0.0))
    return F.when((rows <= 0) | (columns <= 0), F.lit(1.0)).when(finite(row_spacing) & finite(column_spacing), spaced).otherwise(plain)


def window_text(center: Column, width: Column, monochrome: Column, photometric: Column) -> Column:
    whole = lambda x: F.round(x).cast("bigint").cast("string")
    return F.when(monochrome, F.concat(F.lit("WC: "), whole(center), F.lit("  WW: "), whole(width))).otherwise(photometric)


def overlay_text(name: Column, patient_id: Column, modality: Column, columns: Column, rows: Column, window: Column) -> Column:
    """The overlay's lines."""
    size = F.concat(F.lit("Size: "), columns.cast("string"), F.lit(" x "), rows.cast("string"))
    return F.concat_ws("\n", name, F.concat(F.lit("ID: "), patient_id), F.concat(F.lit("Modality: "), modality), size, window)


def overlay_or_error(overlay: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), F.concat(F.lit("Error rendering image:\n"), error["message"])).otherwise(overlay)


def pinched(scale: Column, factor: Column) -> Column:
    """The view's scale after a pinch, within the limits of zoom."""
    return F.least(F.greatest(scale * factor, F.lit(ZOOM[0])), F.lit(ZOOM[1]))


def view_of(matrix: Column) -> Column:
    """struct<scale, x, y> of a view's 4 x 4 matrix, column by column: its greatest axis scale, and where it is moved to."""
    axis = lambda k: F.sqrt(sum((F.get(matrix, F.lit(4 * k + i)) * F.get(matrix, F.lit(4 * k + i)) for i in range(1, 3)), F.get(matrix, F.lit(4 * k)) * F.get(matrix, F.lit(4 * k))))
    return F.struct(F.greatest(*(axis(k) for k in range(3))).alias("scale"), F.get(matrix, F.lit(12)).alias("x"), F.get(matrix, F.lit(13)).alias("y"))


def cine_frame(start: Column, tick: Column, frames: Column) -> Column:
    """The frame shown after `tick` steps; a single frame stays."""
    return F.when(frames > 1, F.pmod(start + tick, frames)).otherwise(start)


def scrubbed(frame: Column, frames: Column) -> Column:
    """A chosen frame, kept within those there are."""
    return F.greatest(F.lit(0), F.least(frame, frames - 1))
