"""Element values: text, lists and numbers, by value representation.

An element is a struct with vr, value_bytes and is_little_endian.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at a value's ends (Unicode white space and U+FEFF).
BLANK = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ENDS = f"^[{BLANK}]+|[{BLANK}]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
HEXADECIMAL = r"^[+-]?0[xX][0-9a-fA-F]+$"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, ENDS, "")


def text(value: Column) -> Column:
    """Bytes as text: malformed UTF-8 replaced, ends trimmed, NULs dropped, ends trimmed again; empty bytes give ''."""
    s = F.make_valid_utf8(value.cast("string"))
    return trimmed(F.replace(trimmed(s), F.lit("\0"), F.lit("")))


def parts(s: Column) -> Column:
    """A text's backslash-separated items, trimmed; none for the empty text."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(s, r"\\"), trimmed))


def first_part(s: Column) -> Column:
    return F.substring_index(s, "\\", 1)


def to_double(s: Column) -> Column:
    """A decimal number, NaN or Infinity; null for anything else."""
    t = trimmed(s)
    return F.when(t.rlike(DECIMAL), t.try_cast("double")).when(t == "NaN", F.lit(float("nan"))).when(t.isin("Infinity", "+Infinity"), F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))


def to_whole(s: Column) -> Column:
    """A decimal or hexadecimal whole number; null for anything else."""
    t = trimmed(s)
    digits = F.regexp_replace(t, "^([+-]?)0[xX]", "")
    digits = F.regexp_replace(digits, "^[+-]", "")
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return F.when(t.rlike(INTEGER), t.try_cast("bigint")).when(t.rlike(HEXADECIMAL) & (F.length(digits) <= 15), sign * F.conv(digits, 16, 10).cast("bigint"))


def to_int(s: Column) -> Column:
    """A whole number, or a decimal one cut toward zero; null where neither (NaN and infinities too)."""
    d = to_double(s)
    whole = F.when(~F.isnan(d) & (F.abs(d) < 9.2e18), d).cast("bigint")
    return F.coalesce(to_whole(s), whole)


def unsigned(value: Column, start: Column | int, n: int, little: Column) -> Column:
    """n bytes from position `start` (0-based) as an unsigned number; null where there are fewer."""
    start = F.lit(start) if isinstance(start, int) else start
    h = F.hex(F.substring(value, start.cast("int") + 1, n))
    swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.when(F.octet_length(value) >= start + n, F.conv(F.when(little, swapped).otherwise(h), 16, 10).cast("decimal(20,0)").cast("bigint" if n < 8 else "decimal(20,0)"))


def signed(value: Column, start: Column | int, n: int, little: Column) -> Column:
    u = unsigned(value, start, n, little)
    return F.when(u >= (1 << (8 * n - 1)), u - (1 << (8 * n))).otherwise(u)


def float32(value: Column, little: Column) -> Column:
    """An IEEE single, widened."""
    u = unsigned(value, 0, 4, little)
    sign = F.when(u >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, part = F.shiftright(u, 23).bitwiseAND(F.lit(0xFF)), u.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    return _ieee(sign, exponent, part / (1 << 23), 255, 127)


def float64(value: Column, little: Column) -> Column:
    """An IEEE double."""
    high = F.when(little, unsigned(value, 4, 4, little)).otherwise(unsigned(value, 0, 4, little))
    low = F.when(little, unsigned(value, 0, 4, little)).otherwise(unsigned(value, 4, 4, little))
    sign = F.when(high >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    part = (high.bitwiseAND(F.lit((1 << 20) - 1)).cast("double") * float(1 << 32) + low.cast("double")) / float(1 << 52)
    return _ieee(sign, exponent, part, 2047, 1023)


def _ieee(sign: Column, exponent: Column, part: Column, top: int, bias: int) -> Column:
    special = F.when(part == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = sign * part * F.pow(F.lit(2.0), F.lit(float(1 - bias)))
    return F.when(exponent == top, special).when(exponent == 0, small).otherwise(sign * (part + 1) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))


def as_string(e: Column) -> Column:
    """null for an absent element, '' for an empty one."""
    return text(e["value_bytes"])


def as_string_list(e: Column) -> Column:
    return parts(as_string(e))


def as_int(e: Column) -> Column:
    b, little, s, vr = e["value_bytes"], e["is_little_endian"], as_string(e), e["vr"]
    out = F.when(vr == "US", unsigned(b, 0, 2, little)).when(vr == "UL", unsigned(b, 0, 4, little)).when(vr == "SS", signed(b, 0, 2, little)).when(vr == "SL", signed(b, 0, 4, little))
    return F.when(F.octet_length(b) > 0, out.when(vr.isin("IS", "DS", "CS", "SH", "LO"), to_int(first_part(s))).otherwise(to_whole(s)))


def as_double(e: Column) -> Column:
    b, little, s, vr = e["value_bytes"], e["is_little_endian"], as_string(e), e["vr"]
    out = F.when(vr == "FL", float32(b, little)).when(vr == "FD", float64(b, little))
    return F.when(F.octet_length(b) > 0, out.when(vr.isin("DS", "IS"), to_double(first_part(s))).otherwise(to_double(s)))


def as_double_list(e: Column) -> Column:
    return F.filter(F.transform(as_string_list(e), to_double), lambda x: x.isNotNull())


def described(e: Column) -> Column:
    """`tag VR [length bytes] -> text`."""
    from pixelloom.functions.dictionaries import tag_text

    return F.concat(tag_text(e["tag"]), F.lit(" "), e["vr"], F.lit(" ["), e["value_length"].cast("string"), F.lit(" bytes] -> "), as_string(e))
