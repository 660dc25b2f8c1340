"""Frames: which bytes of an instance's pixel data are frame i, with every check in its order as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.errors import FORMAT, RANGE, STATE, UNSUPPORTED, error, first_error
from pixelloom.functions.dictionaries import RLE, is_encapsulated, syntax_name
from pixelloom.session import bound, once

#: What a frame needs of its instance.
NEEDS = ["transfer_syntax_uid", "number_of_frames", "rows", "columns", "samples_per_pixel", "bits_allocated", "encapsulated_data", "native_pixel_bytes"]


def fragment_offsets(fragments: DataFrame, keys: list[str], order: str, length: str, ranges: int = 64) -> DataFrame:
    """fragments with relative_tag_start: the bytes of all fragments before, headers of 8 bytes included; empty ones don't count.

    Sums run within ranges of the order (a number), whose bounds are asked for first, and each range begins at the sum of
    those before it. So a key with very many fragments is spread over all ranges.
    """
    shares = [i / ranges for i in range(1, ranges)]
    bounds = fragments.agg(F.percentile_approx(order, shares)).first()[0] or []
    size = F.when(F.col(length) > 0, F.col(length) + 8).otherwise(0).cast("bigint")
    at = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = fragments.withColumn("_size", size).withColumn("_range", F.coalesce(at, F.lit(0)))
    before = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_size").alias("_sum"))
    begins = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_begin"))
    within = dealt.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    match = [within["_range"] == begins["_range"], *(within[k].eqNullSafe(begins[k]) for k in keys)]
    return within.join(begins, match).select(*(within[c] for c in fragments.columns), (F.col("_before") + F.col("_begin")).alias("relative_tag_start"))


def offset_table_error(offsets: Column, starts: Column, frames: Column) -> Column:
    """Error of a Basic Offset Table against its fragments' starts: count, order, then places. An empty table is right."""
    n = F.size(offsets)
    falls = F.exists(F.arrays_zip(F.slice(offsets, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(offsets, 2, F.greatest(n - 1, F.lit(0))).alias("b")), lambda p: p["a"] > p["b"])
    both = F.transform(F.arrays_zip(offsets.alias("o"), starts.alias("s")), lambda p, i: F.struct(i.alias("i"), p["o"].alias("o"), p["s"].alias("s")))
    pairs = F.filter(both, lambda p: p["o"].isNotNull() & p["s"].isNotNull() & (p["o"] != p["s"]))
    bad = F.get(pairs, F.lit(0))
    message = F.concat(F.lit("Basic Offset Table entry count ("), n.cast("string"), F.lit(") does not match numberOfFrames ("), frames.cast("string"), F.lit(")."))
    place = F.concat(F.lit("Basic Offset Table entry "), bad["i"].cast("string"), F.lit(" ("), bad["o"].cast("string"), F.lit(") does not match fragment relative offset ("), bad["s"].cast("string"), F.lit(")."))
    found = first_error((n != frames, error(FORMAT, message)), (falls, error(FORMAT, "Invalid Basic Offset Table: offsets are not non-decreasing.")), (bad.isNotNull(), error(FORMAT, place)))
    return F.when(n > 0, found)


def flat_bytes(fragments: Column) -> Column:
    """All fragments' bytes in order, in one pass however many there are."""
    ordered = F.array_sort(fragments, lambda a, b: a["index"] - b["index"])
    joined = F.unhex(F.array_join(F.transform(ordered, lambda f: F.hex(f["payload"])), ""))
    return F.when(F.size(fragments) == 1, F.get(fragments, F.lit(0))["payload"]).otherwise(joined)


def looks_compressed(data: Column, uid: Column) -> Column:
    """JPEG 2000 or JPEG by first bytes, else by transfer syntax."""
    h = F.hex(F.substring(data, 1, 4))
    return h.startswith("FF4F") | (h == "0000000C") | h.startswith("FFD8") | is_encapsulated(uid)


def is_stream(data: Column, size: Column, frames: Column, wrapped: Column, uid: Column) -> Column:
    """Whether an instance's pixel bytes are a compressed stream; by first bytes only where they can't be its samples.

    Samples can begin as a stream does. So bytes of a defined length that is just that of all frames (one byte of padding
    more, where it is odd) are samples, and shorter ones too, unless they have a stream's whole signature and its end mark.
    """
    whole, n = size * F.greatest(frames, F.lit(1)), F.octet_length(data)
    full = (n == whole) | (n == whole + whole % 2)
    last = F.hex(F.substring(data, -4, 4))
    signed = F.hex(F.substring(data, 1, 12)).rlike("^(FFD8FF|FF4FFF51|0000000C6A5020200D0A870A)") & last.rlike("FFD9(00)?$")
    native = ~wrapped & (full | ((n < whole) & ~signed))
    return is_encapsulated(uid) | (~F.coalesce(native, F.lit(False)) & looks_compressed(data, uid))


def range_error(index: Column, frames: Column) -> Column:
    message = F.concat(F.lit("Invalid frameIndex "), index.cast("string"), F.lit(" (total frames: "), frames.cast("string"), F.lit(")."))
    return F.when((index < 0) | ((frames > 0) & (index >= frames)), error(RANGE, message))


def frame_bytes(rows: Column, columns: Column, samples: Column, bits: Column) -> Column:
    return rows * columns * samples * F.floor((bits + 7) / 8)


def slice_of(data: Column, index: Column, size: Column, frames: Column) -> tuple[Column, Column]:
    """Uncompressed frame `index` and its error: its bytes, clipped at the end; all bytes where it has no place of its own."""
    start = index * size
    late = (start >= F.octet_length(data)) & (frames > 1)
    message = F.concat(F.lit("Frame "), index.cast("string"), F.lit(" start offset "), start.cast("string"), F.lit(" exceeds pixel data length ("), F.octet_length(data).cast("string"), F.lit(" bytes)."))
    own = F.substring(data, (start + 1).cast("int"), size.cast("int"))
    return F.when((size > 0) & (start < F.octet_length(data)), own).otherwise(data), F.when(late, error(FORMAT, message))


def presence_error(wrapped: Column, data: Column) -> Column:
    """No pixel data, or encapsulated pixel data without fragments."""
    absent = error(STATE, "DICOM Dataset contains no Pixel Data (7FE0,0010).")
    empty = error(FORMAT, "Encapsulated Pixel Data (7FE0,0010) contains no item fragments.")
    return first_error((wrapped.isNull() & data.isNull(), absent), (F.size(wrapped["fragments"]) == 0, empty), (wrapped.isNull() & (F.octet_length(data) == 0), absent))


def _instance() -> Column:
    """What all frames of an instance share, so that it is worked out once a file; over the columns in NEEDS."""
    frames, wrapped, data, uid = (F.col(c) for c in ("number_of_frames", "encapsulated_data", "native_pixel_bytes", "transfer_syntax_uid"))
    fragments = wrapped["fragments"]
    message = F.concat(F.lit("Unsupported Transfer Syntax: "), syntax_name(uid), F.lit(" ("), uid, F.lit("). Uncompressed and RLE Lossless files are supported."))
    count = F.concat(F.lit("DICOM PS3.5 Annex G Violation: RLE Lossless multi-frame image has "), F.size(fragments).cast("string"), F.lit(" fragments for "), frames.cast("string"), F.lit(" frames. Per Annex G Section G.2, each RLE frame must be contained in exactly one Fragment."))
    missing = presence_error(wrapped, data)
    table = offset_table_error(wrapped["bot_offsets"], F.transform(fragments, lambda f: f["relative_tag_start"]), frames)
    explicit = error(FORMAT, "Invalid RLE DICOM data: Pixel Data (7FE0,0010) is explicit length. RLE Lossless requires encapsulated undefined length data per DICOM PS3.5.")
    rle = uid == RLE
    size = frame_bytes(*(F.col(c) for c in ("rows", "columns", "samples_per_pixel", "bits_allocated")))
    return F.struct(
        rle.alias("rle"),
        frames.alias("frames"),
        fragments.alias("fragments"),
        data.alias("data"),
        size.alias("size"),
        first_error((F.col("error").isNotNull(), F.col("error")), (missing.isNotNull(), missing)).alias("own"),
        F.when(rle & wrapped.isNull(), explicit).alias("explicit"),
        F.when(rle, first_error((table.isNotNull(), table), ((frames != 1) & (F.size(fragments) != frames), error(FORMAT, count)))).alias("cut"),
        F.when(~rle & is_stream(data, size, frames, wrapped.isNotNull(), uid), error(UNSUPPORTED, message)).alias("unsupported"),
    )


def _error_of(x: Column, at: Column, image: bool) -> Column:
    """The error of frame `at` of instance x: the instance's own first, then each check in its order.

    For images compression is looked at before the frame's number, for bare RGBA after all else.
    """
    frames = x["frames"]
    _, late = slice_of(x["data"], at, x["size"], frames)
    out_of_range = range_error(at, frames)
    # An encapsulated stream has no frame but those it counts, so zero frames are out of range there.
    rle_range = F.when(x["rle"] & ((at < 0) | (at >= frames)), error(RANGE, F.concat(F.lit("Invalid frameIndex "), at.cast("string"), F.lit(" (total frames: "), frames.cast("string"), F.lit(")."))))
    checks = [x["own"], out_of_range, x["explicit"], rle_range, x["cut"], x["unsupported"], F.when(~x["rle"], late)]
    if image:
        checks.insert(1, checks.pop(5))
    return F.coalesce(*checks)


def _payload_of(x: Column, at: Column) -> Column:
    one = F.when(x["frames"] == 1, flat_bytes(x["fragments"])).otherwise(F.get(x["fragments"], at.cast("int"))["payload"])
    return F.when(x["rle"], one).otherwise(slice_of(x["data"], at, x["size"], x["frames"])[0])


@once
def _cut(image: bool) -> Column:
    """array<struct<frame_index, payload, error>> of the frames listed in `_frames`."""

    def cut(x: Column) -> Column:
        checked = F.transform("_frames", lambda i: F.struct(i.alias("i"), _error_of(x, i, image).alias("e")))
        return F.transform(checked, lambda f: F.struct(f["i"].alias("frame_index"), F.when(f["e"].isNull(), _payload_of(x, f["i"])).alias("payload"), f["e"].alias("error")))

    return bound(_instance(), cut)


def extract(instances: DataFrame, index: Column | None = None, image: bool = False) -> DataFrame:
    """A row for each frame: instances' columns (without the pixel bytes), frame_index, payload and error.

    Frames are cut before rows are multiplied, so no row carries more pixels than its own. With `index` (a
    column or literal) only that frame is cut, whether it exists or not. An instance's own error stays.
    With `image` the checks come in the order of images.
    """
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("number_of_frames"), F.lit(1)) - 1) if index is None else F.array(index.cast("bigint"))
    kept = [c for c in instances.columns if c not in ("encapsulated_data", "native_pixel_bytes", "error")]
    return instances.select("*", every.alias("_frames")).select(*kept, F.inline(_cut(image)))
