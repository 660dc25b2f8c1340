"""Data sets: the last element of each tag, typed getters with defaults, one row for each instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import values as V
from pixelloom.functions.dictionaries import EXPLICIT_LE, RLE, TAG, clean_uid
from pixelloom.operators.frames import flat_bytes
from pixelloom.session import once


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Tasks pass on one row for each key, so a hot key costs no more than others in the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*rows.columns)


def last_wins_ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same by ranking, for rows that are sorted by key anyway."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dataset_of(elements: str) -> Column:
    """map<tag, element> of the last element of each tag; values are decoded once, at parsing, and getters only pick fields."""
    return F.expr(f"map_from_entries(transform(filter({elements}, e -> e.is_last), e -> struct(e.tag, e)))")


def with_dataset(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("dataset", dataset_of("elements"))


def element(dataset: Column, keyword: str) -> Column:
    """The element of a keyword, null if absent."""
    return F.try_element_at(dataset, F.lit(TAG[keyword]).cast("bigint"))


def get_string(dataset: Column, keyword: str, default: str | None = None) -> Column:
    """Text; the default only where the element is absent (an empty one is '')."""
    s = element(dataset, keyword)["text"]
    return s if default is None else F.coalesce(s, F.lit(default))


def get_int(dataset: Column, keyword: str, default: int | Column | None = None) -> Column:
    v = element(dataset, keyword)["whole"]
    return v if default is None else F.coalesce(v, F.lit(default).cast("bigint") if isinstance(default, int) else default)


def get_double(dataset: Column, keyword: str, default: float | None = None) -> Column:
    v = element(dataset, keyword)["decimal"]
    return v if default is None else F.coalesce(v, F.lit(default))


def get_double_list(dataset: Column, keyword: str) -> Column:
    """Numbers, null where the element is absent or gives none."""
    v = element(dataset, keyword)["decimals"]
    return F.when(F.size(v) > 0, v)


def get_string_list(dataset: Column, keyword: str) -> Column:
    v = V.parts(element(dataset, keyword)["text"])
    return F.when(F.size(v) > 0, v)


def pixel_spacing(items: Column) -> Column:
    """Row and column spacing: exactly two items, both numbers, else null."""
    numbers = F.transform(items, V.to_double)
    return F.when((F.size(items) == 2) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


@once
def getters(column: str = "dataset") -> dict[str, Column]:
    """Every typed getter of the data set map in `column`, by name."""
    d = F.col(column)
    pixels = element(d, "PixelData")
    bits_allocated = get_int(d, "BitsAllocated", 16)
    bits_stored = get_int(d, "BitsStored", bits_allocated)
    uid = get_string(d, "TransferSyntaxUID", EXPLICIT_LE)
    representation = get_int(d, "PixelRepresentation", 0)
    none = F.array().cast("array<double>")
    wrapped = pixels["encapsulated"]
    flat = flat_bytes(wrapped["fragments"])
    text = {"patient_name": ("PatientName", "Anonymous"), "patient_id": ("PatientID", ""), "study_date": ("StudyDate", ""), "modality": ("Modality", "UNKNOWN"), "study_description": ("StudyDescription", ""), "series_description": ("SeriesDescription", ""), "study_instance_uid": ("StudyInstanceUID", None), "study_time": ("StudyTime", None), "series_instance_uid": ("SeriesInstanceUID", None), "sop_class_uid": ("SOPClassUID", None), "sop_instance_uid": ("SOPInstanceUID", None), "acquisition_date": ("AcquisitionDate", None), "acquisition_time": ("AcquisitionTime", None), "institution_name": ("InstitutionName", None), "manufacturer": ("Manufacturer", None), "photometric_interpretation": ("PhotometricInterpretation", "MONOCHROME2")}
    whole = {"series_number": ("SeriesNumber", None), "instance_number": ("InstanceNumber", None), "number_of_frames": ("NumberOfFrames", 1), "rows": ("Rows", 0), "columns": ("Columns", 0), "samples_per_pixel": ("SamplesPerPixel", 1), "planar_configuration": ("PlanarConfiguration", 0), "pixel_padding_value": ("PixelPaddingValue", None), "pixel_padding_range_limit": ("PixelPaddingRangeLimit", None)}
    decimal = {"slice_thickness": ("SliceThickness", None), "rescale_slope": ("RescaleSlope", 1.0), "rescale_intercept": ("RescaleIntercept", 0.0)}
    return {
        "transfer_syntax_uid": uid,
        **{n: get_string(d, k, default) for n, (k, default) in text.items()},
        **{n: get_int(d, k, default) for n, (k, default) in whole.items()},
        **{n: get_double(d, k, default) for n, (k, default) in decimal.items()},
        "pixel_spacing": pixel_spacing(V.parts(element(d, "PixelSpacing")["text"])),
        "bits_allocated": bits_allocated,
        "bits_stored": bits_stored,
        "high_bit": get_int(d, "HighBit", bits_stored - 1),
        "is_little_endian": F.coalesce(pixels["is_little_endian"], clean_uid(uid) != "1.2.840.10008.1.2.2"),
        "pixel_representation": representation,
        "is_signed": representation == 1,
        "window_center": get_double(d, "WindowCenter"),
        "window_width": get_double(d, "WindowWidth"),
        "window_center_presets": F.coalesce(get_double_list(d, "WindowCenter"), none),
        "window_width_presets": F.coalesce(get_double_list(d, "WindowWidth"), none),
        "encapsulated_data": wrapped,
        "pixel_data_bytes": F.when(wrapped.isNotNull(), flat).otherwise(pixels["value_bytes"]),
        # The same, but null for RLE, whose frames come from fragments and need no joined copy.
        "native_pixel_bytes": F.when(wrapped.isNull(), pixels["value_bytes"]).when(clean_uid(uid) != RLE, flat),
    }


def instances(parsed: DataFrame, names: list[str] | None = None) -> DataFrame:
    """file_id, the getters (all, or those named) and error: one narrow projection."""
    rows = with_dataset(parsed)
    found = getters()
    return rows.select("file_id", *(found[n].alias(n) for n in names or [n for n in found if n != "native_pixel_bytes"]), "error")
