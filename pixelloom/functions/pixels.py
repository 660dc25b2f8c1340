"""Pixel arithmetic as column expressions, for single values and, through transform(), arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.session import bound


def masked(value: Column, bits_stored: Column) -> Column:
    """The low bits_stored bits."""
    return value.cast("bigint").bitwiseAND(_power(bits_stored) - 1)


def sign_extended(value: Column, bits_stored: Column, high_bit: Column, is_signed: Column) -> Column:
    """Stored bits as a number: masked, and where the sign bit is set, with all higher bits set. Not realigned."""
    v = masked(value, bits_stored)
    negative = is_signed & (v.bitwiseAND(_power(high_bit)) != 0)
    return F.when(negative, v.bitwiseOR(-_power(bits_stored))).otherwise(v)


def _power(bits: Column) -> Column:
    """2 to the given number of bits (at most 62)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))


def stored_values(payload: Column, count: Column, bits_allocated: int, little: Column) -> Column:
    """payload's 8-, 16- or 32-bit unsigned samples: exactly `count`, short input filled with zeros, excess ignored."""
    n = bits_allocated // 8

    def samples(x: Column) -> Column:
        def one(i: Column) -> Column:
            # Bytes are cut from the binary itself, so each sample costs the same wherever it stands.
            parts = [F.hex(F.substring(x["bytes"], (i * n + k + 1).cast("int"), F.lit(1))) for k in range(n)]
            word = F.when(x["little"], F.concat(*reversed(parts))).otherwise(F.concat(*parts))
            return F.when((i + 1) * n <= x["size"], F.conv(word, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

        return F.transform(F.sequence(F.lit(0).cast("bigint"), x["count"] - 1), one)

    x = F.struct(payload.alias("bytes"), little.alias("little"), F.octet_length(payload).alias("size"), count.cast("bigint").alias("count"))
    return F.when((count <= 0) | (F.octet_length(payload) == 0), F.array().cast("array<bigint>")).otherwise(bound(x, samples))


def byte_values(data: Column, step: int = 1, first: int = 0) -> Column:
    """Every step-th byte from the first-th on, as numbers."""

    def values(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.conv(F.hex(F.substring(x["bytes"], i * step + (first + 1), F.lit(1))), 16, 10).cast("int"))

    n = F.ceil((F.octet_length(data) - first) / step).cast("int")
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(bound(F.struct(data.alias("bytes"), n.alias("n")), values))


def rescaled(stored: Column, slope: Column, intercept: Column) -> Column:
    return stored.cast("double") * slope + intercept


def half_up(x: Column) -> Column:
    """A number of 0 or more, rounded half up; plain arithmetic, where round() goes through decimals."""
    whole = F.floor(x)
    return (whole + F.when(x - whole >= 0.5, F.lit(1)).otherwise(F.lit(0))).cast("int")


def voi_window(value: Column, center: Column, width: Column) -> Column:
    """Linear window to 0..255; a width under 1 counts as 1."""
    w = F.greatest(width.cast("double"), F.lit(1.0))
    c = center.cast("double") - 0.5
    half = (w - 1.0) / 2.0
    level = ((value - c) / F.nullif(w - 1.0, F.lit(0.0)) + 0.5) * 255.0
    return F.when(value <= c - half, F.lit(0)).when(value > c + half, F.lit(255)).otherwise(half_up(F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0))))


def inverted(gray: Column) -> Column:
    return F.lit(255) - gray


def clamped(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def rgb_at(samples: Column, i: Column, pixels: Column, planar: Column) -> Column:
    """struct<r,g,b> of pixel i, interleaved or by plane; samples that are missing count as 0, all are clamped to 0..255."""
    at = lambda k: clamped(F.coalesce(F.get(samples, F.when(planar, pixels * k + i).otherwise(i * 3 + k).cast("int")), F.lit(0)))
    return F.struct(*(at(k).cast("int").alias(c) for k, c in enumerate("rgb")))


def ybr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """struct<r,g,b>: full-range luma and chroma, rounded, then clamped."""
    b, r = cb.cast("double") - 128.0, cr.cast("double") - 128.0
    y = y.cast("double")
    level = lambda v: half_up(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)))  # noqa: E731  rounding keeps 0..255 within itself
    return F.struct(level(y + r * 1.402).alias("r"), level(y - b * 0.344136 - r * 0.714136).alias("g"), level(y + b * 1.772).alias("b"))


def palette_index(stored: Column, first: Column, entries: Column) -> Column:
    """Where a stored value falls in a palette of so many entries."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(entries.cast("bigint") - 1, stored.cast("bigint") - first))


def resolved_center(explicit: Column, own: Column) -> Column:
    """The window centre to use: given, else the data set's, else 128."""
    return F.coalesce(explicit, own, F.lit(128.0))


def resolved_width(explicit: Column, own: Column) -> Column:
    """The window width to use, else 256; a value of 0 or less asks for an automatic width."""
    return F.coalesce(explicit, own, F.lit(256.0))


def is_padding(stored: Column, value: Column, limit: Column) -> Column:
    """Whether a stored value lies in the padding range; false without a padding value."""
    end = F.coalesce(limit, value)
    return F.coalesce((stored >= F.least(value, end)) & (stored <= F.greatest(value, end)), F.lit(False))


def gray_at(values: Column, i: Column, center: Column, width: Column, invert: Column) -> Column:
    """Gray of pixel i of a frame's rescaled values; a pixel without a value counts as 0.0, which is not rescaled."""
    gray = voi_window(F.coalesce(F.get(values, i.cast("int")), F.lit(0.0)), center, width)
    return F.when(invert, inverted(gray)).otherwise(gray)


def pixel_info(rows: Column, columns: Column, samples: Column, bits_allocated: Column, bits_stored: Column, high_bit: Column) -> Column:
    """struct of a frame's layout with total_pixels and frame_bytes."""
    return F.struct(rows.alias("rows"), columns.alias("columns"), samples.alias("samples_per_pixel"), bits_allocated.alias("bits_allocated"), bits_stored.alias("bits_stored"), high_bit.alias("high_bit"), (rows * columns).alias("total_pixels"), (rows * columns * samples * F.floor((bits_allocated + 7) / 8)).alias("frame_bytes"))
