"""Frames to RGBA: decode, rescale, window, colour. Frames stay one row; each batch is numpy from payload to RGBA.

`render` is the bulk path. The column expressions in functions.pixels say the same for exploded pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from pixelloom.errors import FORMAT, SCHEMA, STATE, UNSUPPORTED, ImageError
from pixelloom.functions import dictionaries as D
from pixelloom.functions.dictionaries import RLE
from pixelloom.operators import rle
from pixelloom.operators.dataset import getters, with_dataset
from pixelloom.operators.frames import NEEDS, extract
from pixelloom.operators.palette import palette
from pixelloom.sources import ROWS, RUN

INFO = ["bits_stored", "high_bit", "is_signed", "is_little_endian", "planar_configuration", "photometric_interpretation", "rescale_slope", "rescale_intercept", "window_center", "window_width", "pixel_padding_value", "pixel_padding_range_limit"]


def native_samples(payload: bytes, f: dict) -> bytes:
    """A frame's samples as native bytes."""
    if f["transfer_syntax_uid"] == RLE:
        return rle.decode_frame(payload, f["columns"], f["rows"], f["bits_allocated"], f["samples_per_pixel"])
    return payload


def stored_samples(data: bytes, f: dict) -> np.ndarray:
    """Masked and sign-extended samples, exactly as many as the frame has; none of empty data."""
    bits = f["bits_allocated"]
    if not data:
        return np.zeros(0, np.int64)
    if bits not in (8, 16, 32):
        raise ImageError(UNSUPPORTED, f"Unsupported BitsAllocated: {bits}")
    n = f["rows"] * f["columns"] * f["samples_per_pixel"]
    kind = np.dtype(f"u{bits // 8}").newbyteorder("<" if f["is_little_endian"] or f["transfer_syntax_uid"] == RLE else ">")
    got = np.frombuffer(data, kind, min(n, len(data) // kind.itemsize)).astype(np.int64)
    out = np.zeros(max(n, 0), np.int64)
    stored = f["bits_stored"]
    got &= (1 << stored) - 1
    if f["is_signed"]:
        got = np.where(got & (1 << f["high_bit"]), got | -(1 << stored), got)
    out[: len(got)] = got
    return out


def auto_window(values: np.ndarray, stored: np.ndarray, f: dict) -> tuple[float, float]:
    if not len(values):
        return 128.0, 256.0
    pad, limit = f["pixel_padding_value"], f["pixel_padding_range_limit"]
    if pad is not None:
        end = pad if limit is None else limit
        kept = values[(stored < min(pad, end)) | (stored > max(pad, end))]
        values = kept if len(kept) else values
    low, high = float(values.min()), float(values.max())
    high = low + 1 if high == low else high
    return low + (high - low) / 2, max(high - low, 1.0)


def half_up(x: np.ndarray) -> np.ndarray:
    """Numbers of 0 or more, rounded half up."""
    whole = np.floor(x)
    return whole + (x - whole >= 0.5)


def windowed(values: np.ndarray, center: float, width: float) -> np.ndarray:
    """0..255 by the linear window."""
    w, c = max(width, 1.0), center - 0.5
    half = (w - 1) / 2
    level = np.clip(((values - c) / (w - 1) + 0.5) * 255, 0, 255) if w > 1 else np.zeros_like(values)
    return np.where(values <= c - half, 0, np.where(values > c + half, 255, half_up(level))).astype(np.uint8)


def _fitted(x: np.ndarray, n: int) -> np.ndarray:
    return x[:n] if len(x) >= n else np.concatenate([x, np.zeros(n - len(x), x.dtype)])


def _triples(stored: np.ndarray, n: int, planar: bool) -> np.ndarray:
    x = _fitted(stored, 3 * n)
    return x.reshape(3, n).T if planar else x.reshape(n, 3)


def rgba(stored: np.ndarray, f: dict, center: float | None = None, width: float | None = None) -> tuple[np.ndarray, float, float]:
    """A frame's samples as pixel x RGBA, with the window used."""
    n = f["rows"] * f["columns"]
    kind = D.PHOTOMETRIC.get(f["photometric_interpretation"].strip().upper(), "unsupported")
    center = next((x for x in (center, f["window_center"]) if x is not None), 128.0)
    width = next((x for x in (width, f["window_width"]) if x is not None), 256.0)
    out = np.full((n, 4), 255, np.uint8)
    planar = f["planar_configuration"] == 1
    if kind == "rgb":
        out[:, :3] = np.clip(_triples(stored, n, planar), 0, 255)
    elif kind == "ybrFull":
        y, cb, cr = (_triples(stored, n, planar).astype(np.float64) - [0, 128, 128]).T
        level = np.stack([y + cr * 1.402, y - cb * 0.344136 - cr * 0.714136, y + cb * 1.772], axis=1)
        out[:, :3] = half_up(np.clip(level, 0, 255))  # rounding keeps 0..255 within itself
    elif kind == "paletteColor":
        p = f["palette"]
        if p is None:
            raise ImageError(FORMAT, "Missing Palette Color LUT for PALETTE COLOR image.")
        at = np.clip(_fitted(stored, n) - p["first"], 0, p["n"] - 1)
        out[:, :3] = np.stack([np.frombuffer(p[c], np.uint8)[at] for c in "rgb"], axis=1)
    else:  # monochrome, and whatever is unknown
        values = stored * f["rescale_slope"] + f["rescale_intercept"]
        if width <= 0:
            width = auto_window(values, stored, f)[1]
        gray = windowed(_fitted(values.astype(np.float64), n), center, width)
        out[:, :3] = (255 - gray if kind == "monochrome1" else gray)[:, None]
    return out, float(center), float(width)


def frames_of(parsed: DataFrame, index: Column | None = None, image: bool = False) -> DataFrame:
    """Frames of parsed files with all that rendering needs; pass `index` to cut no other frame, `image` for the checks of images."""
    rows = with_dataset(parsed)
    found = getters()
    coloured = D.photometric(found["photometric_interpretation"]) == "paletteColor"
    rows = rows.select("file_id", *(found[n].alias(n) for n in dict.fromkeys([*NEEDS, *INFO])), F.when(coloured, palette("dataset")).alias("_palette"), "error")
    rows = rows.select("*", F.col("_palette.table").alias("palette"), F.col("_palette.error").alias("palette_error")).drop("_palette")
    return extract(rows, index, image)


def render_images(parsed: DataFrame, index: Column | None = None, center: float | None = None, width: float | None = None) -> DataFrame:
    """render, with the checks that images need, in their order."""
    return render(frames_of(parsed, index, image=True), center, width, image=True, keep=["columns", "rows"])


def render(frames: DataFrame, center: float | None = None, width: float | None = None, image: bool = False, keep: list[str] | None = None) -> DataFrame:
    """file_id, frame_index (and `keep`), rgba, wc, ww and error for every frame; failed frames have no rgba.

    With `image` a frame without an area is an error.
    """
    keep = ["file_id", "frame_index", *(keep or [])]
    used = list(dict.fromkeys([*keep, "payload", "transfer_syntax_uid", "rows", "columns", "samples_per_pixel", "bits_allocated", *INFO, "palette", "palette_error", "error"]))
    err = StructType([StructField("kind", StringType()), StructField("message", StringType())])
    schema = StructType([*(frames.schema[c] for c in keep), StructField("rgba", BinaryType()), StructField("wc", DoubleType()), StructField("ww", DoubleType()), StructField("error", err)])
    kinds = [pa.binary(), pa.float64(), pa.float64(), pa.struct([("kind", pa.string()), ("message", pa.string())])]

    def one(f: dict) -> tuple[bytes | None, float | None, float | None, dict | None]:
        if f["error"] is not None:
            return None, None, None, f["error"]
        try:
            stored = stored_samples(native_samples(f["payload"] or b"", f), f)
            if f["palette_error"] is not None:
                return None, None, None, f["palette_error"]
            out, wc, ww = rgba(stored, f, center, width)
            if image and (f["columns"] <= 0 or f["rows"] <= 0):
                raise ImageError(STATE, f"Invalid image dimensions: {f['columns']}x{f['rows']}")
            return out.tobytes(), wc, ww, None
        except ImageError as e:
            return None, None, None, e.row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _runs(batch, one, lambda g: len(g[0] or b"")):
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([g[i] for g in got], t) for i, t in enumerate(kinds))], names=schema.names)

    return frames.select(*used).mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch, one: Callable[[dict], tuple], size: Callable[[tuple], int], most: int = RUN, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Runs of a batch's rows with what `one` makes of each, about `most` bytes and at most `rows` rows at a time.

    So no array outgrows its offsets, and few rows are Python objects, however many a batch has.
    """
    payload = pc.binary_length(batch.column(batch.schema.get_field_index("payload"))).fill_null(0).to_numpy(zero_copy_only=False)
    before = np.cumsum(payload, dtype=np.int64) - payload
    begin, got, held = 0, [], 0
    at = np.arange(batch.num_rows)
    for part in np.split(at, np.flatnonzero(np.diff(before // (most // 4)) | np.diff(at // rows)) + 1):
        for i, row in zip(part.tolist(), batch.slice(int(part[0]) if len(part) else 0, len(part)).to_pylist()):
            got.append(one(row))
            held += size(got[-1])
            if held >= most or len(got) == rows:
                yield batch.slice(begin, len(got)), got
                begin, got, held = i + 1, [], 0
    if got:
        yield batch.slice(begin, len(got)), got


def decode(frames: DataFrame) -> DataFrame:
    """file_id, frame_index, stored (array of samples) and error for every frame."""
    schema = f"file_id string, frame_index bigint, stored array<bigint>, error {SCHEMA}"
    used = ["file_id", "frame_index", "payload", "transfer_syntax_uid", "rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "high_bit", "is_signed", "is_little_endian", "error"]

    def one(f: dict) -> tuple[np.ndarray | None, dict | None]:
        if f["error"] is not None:
            return None, f["error"]
        try:
            return stored_samples(native_samples(f["payload"] or b"", f), f), None
        except ImageError as e:
            return None, e.row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _runs(batch, one, lambda g: 0 if g[0] is None else g[0].nbytes):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.struct([("kind", pa.string()), ("message", pa.string())]))], names=["file_id", "frame_index", "stored", "error"])

    return frames.select(*used).mapInArrow(run, schema)


def pixels_of(decoded: DataFrame, column: str = "stored") -> DataFrame:
    """A row for each sample: file_id, frame_index, i and stored."""
    return decoded.where(f"{column} is not null").select("file_id", "frame_index", F.posexplode(column).alias("i", "stored"))
