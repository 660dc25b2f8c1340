"""Element values as columns: text, numbers, lists, windows, palettes; and frames' errors."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from pixelloom.functions import dictionaries as D
from pixelloom.functions import display, pixels, values


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    ("raw", "want"),
    [(b"", ""), (b" AB \0", "AB"), (b"\0 A\0B \0", "A" + "B"), (b"\xc3\xa9 ", "é"), (b"\xff", "�"), ("　x﻿".encode(), "x"), (b"\t\n x \r", "x")],
)
def test_text(spark, raw, want):
    assert one(spark, values.text(F.lit(raw).cast("binary")))[0] == want


@pytest.mark.parametrize(("s", "want"), [(" 12 ", 12), ("0045", 45), ("+5", 5), ("-7", -7), ("12.7", 12), ("-12.7", -12), ("0x10", 16), ("-0x10", -16), ("ABC", None), ("", None), ("NaN", None), ("Infinity", None), ("1e3", 1000), ("9" * 30, None)])
def test_to_int(spark, s, want):
    assert one(spark, values.to_int(F.lit(s)))[0] == want


@pytest.mark.parametrize(("s", "want"), [("3.75", 3.75), (" -.5 ", -0.5), ("5.", 5.0), ("1e-2", 0.01), ("1.5f", None), ("1d", None), ("inf", None), ("Infinity", math.inf), ("-Infinity", -math.inf), ("INVALID_DS", None), ("", None)])
def test_to_double(spark, s, want):
    assert one(spark, values.to_double(F.lit(s)))[0] == want


def test_lists(spark):
    assert one(spark, values.parts(F.lit("1.25\\ 0.85 ")), values.parts(F.lit("")), values.parts(F.lit("a\\\\b"))) == (["1.25", "0.85"], [], ["a", "", "b"])


def make(vr, raw, little=True):
    return F.struct(F.lit(0x00280010).cast("bigint").alias("tag"), F.lit(vr).alias("vr"), F.lit(len(raw)).cast("bigint").alias("value_length"), F.lit(raw).cast("binary").alias("value_bytes"), F.lit(little).alias("is_little_endian"))


@pytest.mark.parametrize("little", [True, False])
@pytest.mark.parametrize(("vr", "code", "value"), [("US", "H", 65000), ("UL", "I", 4_000_000_000), ("SS", "h", -5), ("SL", "i", -70000)])
def test_binary_ints(spark, vr, code, value, little):
    raw = struct.pack(("<" if little else ">") + code, value)
    assert one(spark, values.as_int(make(vr, raw, little)), values.as_int(make(vr, raw[:-1], little)), values.as_int(make(vr, b""))) == (value, None, None)


@pytest.mark.parametrize("little", [True, False])
@pytest.mark.parametrize("value", [0.0, 1.5, -2.75, 1e-40, 3.0e38, math.inf, -math.inf])
def test_binary_doubles(spark, value, little):
    order = "<" if little else ">"
    single = struct.pack(order + "f", value)
    got = one(spark, values.as_double(make("FL", single, little)), values.as_double(make("FD", struct.pack(order + "d", value), little)), values.as_double(make("FD", b"1234", little)))
    assert got == (struct.unpack(order + "f", single)[0], value, None)


def test_nan_double(spark):
    assert math.isnan(one(spark, values.as_double(make("FD", struct.pack("<d", math.nan))))[0])


def test_int_by_vr(spark):
    got = one(spark, values.as_int(make("IS", b"12\\13")), values.as_int(make("AE", b"12\\13")), values.as_int(make("LO", b"3.9 ")), values.as_double(make("DS", b"1.5\\2")), values.as_double(make("UT", b"2.5")), values.as_double_list(make("DS", b"1\\x\\3")))
    assert got == (12, None, 3, 1.5, 2.5, [1.0, 3.0])


def test_described(spark):
    assert one(spark, values.described(make("LO", b"AB")))[0] == "(0028,0010) LO [2 bytes] -> AB"


def test_window_goldens(spark):
    at = lambda v, c, w: pixels.voi_window(F.lit(float(v)), F.lit(float(c)), F.lit(float(w)))
    assert one(spark, at(-200, 40, 400), at(300, 40, 400), at(40, 40, 400), at(0, 128, 256), at(255, 128, 256), at(5, 5, 1), at(4, 5, 0)) == (0, 255, 128, 0, 255, 255, 0)
    assert one(spark, *[pixels.rescaled(F.lit(v), F.lit(1.0), F.lit(-1024.0)) for v in (1024, 0, 2048)]) == (0.0, -1024.0, 1024.0)


def test_sign_extension(spark):
    at = lambda v, stored, high, signed: pixels.sign_extended(F.lit(v), F.lit(stored), F.lit(high), F.lit(signed))
    assert one(spark, at(0xFFF, 12, 11, True), at(0xFFF, 12, 11, False), at(0x1FFF, 12, 11, True), at(0x7FF, 12, 11, True), at(0xF000, 12, 15, True), at(0xFFFFFFFF, 32, 31, True)) == (-1, 4095, -1, 2047, 0, -1)


def test_stored_values(spark):
    at = lambda raw, n, bits, little: pixels.stored_values(F.lit(raw).cast("binary"), F.lit(n), bits, F.lit(little))
    assert one(spark, at(bytes([0, 128, 255, 64]), 4, 8, True), at(b"\xe8\x03\xff\x0f\0\0\0\x08", 4, 16, True), at(b"\x12\x34\x56\x78", 2, 16, False), at(b"\x01\0\0\x80", 2, 32, True), at(b"", 3, 8, True), at(b"\1\2\3", 2, 8, True)) == ([0, 128, 255, 64], [1000, 4095, 0, 2048], [0x1234, 0x5678], [0x80000001, 0], [], [1, 2])


def test_aspect_ratio(spark):
    at = lambda r, c, rs, cs: display.aspect_ratio(F.lit(r), F.lit(c), F.lit(rs).cast("double"), F.lit(cs).cast("double"))
    assert one(spark, at(32, 64, None, None), at(512, 512, 0.5, 1.0), at(512, 512, 1.0, 0.5), at(0, 5, 1, 1), at(2, 4, float("nan"), 1.0), at(2, 4, -1.0, 1.0)) == (2.0, 2.0, 0.5, 1.0, 2.0, 2.0)


def test_dictionary(spark):
    assert len(D.DICTIONARY) == 62 and D.tag_dictionary(spark).count() == 62
    assert one(spark, D.tag_text(F.lit(0x7FE00010).cast("bigint")), D.vr_code(F.lit("ow")), D.vr_code(F.lit("??")), D.photometric(F.lit(" ybr_full ")), D.photometric(F.lit("X")))[:] == ("(7FE0,0010)", "OW", "UNKNOWN", "ybrFull", "unsupported")
