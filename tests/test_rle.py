"""RLE frames: exact bytes, errors, and encode-decode identity."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.errors import ImageError
from pixelloom.operators import rle


def frame(*segments):
    at, offsets = 64, []
    for s in segments:
        offsets.append(at)
        at += len(s)
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(segments))) + b"".join(segments)


def test_gray8():
    assert list(rle.decode_frame(frame(bytes([0, 10, 0xFE, 20, 0, 30])), 5, 1, 8, 1)) == [10, 20, 20, 20, 30]


def test_gray16_is_little_endian():
    assert rle.decode_frame(frame(bytes([1, 1, 2]), bytes([1, 0xAA, 0xBB])), 2, 1, 16, 1) == bytes([0xAA, 1, 0xBB, 2])


def test_rgb_is_interleaved():
    parts = [bytes([1, 255, 0]), bytes([1, 0, 255]), bytes([1, 0, 0])]
    assert list(rle.decode_frame(frame(*parts), 2, 1, 8, 3)) == [255, 0, 0, 0, 255, 0]


def test_no_op_short_and_long_streams():
    assert rle.unpacked(bytes([128, 0, 7]), 3) == b"\x07\0\0"
    assert rle.unpacked(bytes([0x81, 9]), 4) == b"\x09" * 4
    assert rle.unpacked(bytes([5, 1, 2]), 4) == b"\x01\x02\0\0"


@pytest.mark.parametrize(
    ("data", "bits", "samples", "kind"),
    [(b"x" * 63, 8, 1, "FormatException"), (frame() + b"", 8, 1, "FormatException"), (struct.pack("<16I", 1, 500, *[0] * 14), 8, 1, "FormatException"), (frame(b"\0a"), 16, 1, "FormatException"), (frame(b"\0a"), 32, 1, "UnsupportedError"), (frame(b"\0a"), 8, 3, "UnsupportedError"), (frame(b"\0a"), 8, 4, "UnsupportedError")],
)
def test_errors(data, bits, samples, kind):
    with pytest.raises(ImageError) as e:
        rle.decode_frame(data, 1, 1, bits, samples)
    assert e.value.kind == kind


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 200]), min_size=1, max_size=700), st.sampled_from([(8, 1), (16, 1), (8, 3)]))
def test_round_trip(values, layout):
    bits, samples = layout
    step = bits // 8 * samples
    data = bytes(values[: len(values) // step * step])
    if data:
        assert rle.decode_frame(rle.encode_frame(data, bits, samples), len(data) // step, 1, bits, samples) == data
