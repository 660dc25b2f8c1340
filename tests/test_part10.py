"""Parsing bytes: headers, transfer syntaxes, fragments, sequences, what is cut short."""

import struct

import pytest

from pixelloom.errors import ImageError
from pixelloom.functions.dictionaries import EXPLICIT_BE, EXPLICIT_LE, IMPLICIT_LE, TAG
from pixelloom.sources import part10
from pixelloom.sources.writer import element, encapsulated, packed_int16, part10 as write


def by_tag(content, **kw):
    return {e.tag: e for e in part10.parse(content, **kw)}


@pytest.mark.parametrize("content", [b"", b"1234567"])
def test_too_short(content):
    with pytest.raises(ImageError, match="less than 8"):
        part10.parse(content)


def test_missing_header():
    with pytest.raises(ImageError, match=r"missing DICM header \(100 bytes\)"):
        part10.parse(bytes(100))


def test_headerless_data_set_is_read():
    content = element(TAG["PatientName"], "A" * 120) + element(TAG["Rows"], 7)
    assert by_tag(content)[TAG["Rows"]].value_bytes == b"\x07\0"


@pytest.mark.parametrize("syntax", [EXPLICIT_LE, IMPLICIT_LE, EXPLICIT_BE])
def test_transfer_syntaxes(syntax):
    got = by_tag(write({"Rows": 4, "Columns": 5, "PatientName": "X^Y"}, syntax, packed_int16([1, 2], syntax != EXPLICIT_BE)))
    rows = got[TAG["Rows"]]
    assert rows.is_little_endian == (syntax != EXPLICIT_BE)
    assert int.from_bytes(rows.value_bytes, "little" if rows.is_little_endian else "big") == 4
    assert got[TAG["PatientName"]].vr == "PN" and got[part10.PIXEL_DATA].vr == "OW"


def test_meta_group_after_big_endian_switch_is_little_endian():
    body = element(TAG["TransferSyntaxUID"], EXPLICIT_BE) + element(0x00020012, "1.2.3", "UI") + element(TAG["Rows"], 9, little=False)
    got = by_tag(b"\0" * 128 + b"DICM" + body)
    assert got[0x00020012].value_bytes.rstrip(b"\0") == b"1.2.3" and got[TAG["Rows"]].value_bytes == b"\0\x09"


def test_implicit_vr_comes_from_the_dictionary():
    content = b"\0" * 128 + b"DICM" + element(TAG["TransferSyntaxUID"], IMPLICIT_LE)
    content += struct.pack("<HHI", 0x0028, 0, 4) + bytes(4) + struct.pack("<HHI", 0x0099, 1, 2) + b"ab"
    got = by_tag(content)
    assert got[0x00280000].vr == "UL" and got[0x00990001].vr == "UN"


def test_fragments_and_offset_table():
    got = by_tag(write({"Rows": 1}, wrapped=encapsulated([bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])], [0, 12])))
    wrapped = got[part10.PIXEL_DATA].encapsulated
    assert wrapped["bot_offsets"] == [0, 12]
    assert [(f["index"], f["relative_tag_start"], f["payload"]) for f in wrapped["fragments"]] == [(1, 0, bytes([1, 2, 3, 4])), (2, 12, bytes([5, 6, 7, 8]))]


def test_empty_fragments_do_not_count():
    got = by_tag(write({"Rows": 1}, wrapped=encapsulated([b"", b"ab", b"", b"cd"])))
    assert [(f["index"], f["relative_tag_start"]) for f in got[part10.PIXEL_DATA].encapsulated["fragments"]] == [(1, 0), (2, 10)]


def bad_table(length, body=b""):
    return write({"Rows": 1}) + struct.pack("<HH", 0x7FE0, 0x10) + b"OB\0\0" + struct.pack("<I", part10.UNDEFINED) + struct.pack("<HHI", 0xFFFE, 0xE000, length) + body


@pytest.mark.parametrize(("content", "said"), [(bad_table(3, b"abc"), "multiple of 4"), (bad_table(part10.UNDEFINED), "multiple of 4"), (bad_table(400), "extends beyond")])
def test_bad_offset_tables(content, said):
    with pytest.raises(ImageError, match=said):
        part10.parse(content)


def undefined(tag, vr, body):
    return struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr + b"\0\0" + struct.pack("<I", part10.UNDEFINED) + body + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def item(body, length=None):
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(body) if length is None else length) + body


def test_nested_sequences_are_skipped_whole():
    inner = undefined(0x00081115, b"SQ", item(element(TAG["Rows"], 99)))
    outer = undefined(0x00081110, b"SQ", item(inner + element(TAG["Columns"], 98) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0), part10.UNDEFINED))
    got = by_tag(write([]) + outer + element(TAG["Rows"], 3))
    assert got[TAG["Rows"]].value_bytes == b"\x03\0" and TAG["Columns"] not in got and got[0x00081110].vr == "SQ"


def test_unknown_sequence_in_implicit_vr():
    content = b"\0" * 128 + b"DICM" + element(TAG["TransferSyntaxUID"], IMPLICIT_LE)
    content += struct.pack("<HHI", 0x0099, 0x9999, part10.UNDEFINED) + item(b"\1\2\3\4") + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) + element(TAG["Rows"], 64, explicit=False)
    got = by_tag(content)
    assert got[0x00999999].vr == "SQ" and got[TAG["Rows"]].value_bytes == b"\x40\0"


def test_broken_sequence_is_scanned_for_its_end():
    body = b"junk!!" + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    content = write([]) + struct.pack("<HH", 8, 0x1110) + b"SQ\0\0" + struct.pack("<I", part10.UNDEFINED) + body + element(TAG["Rows"], 5)
    assert by_tag(content)[TAG["Rows"]].value_bytes == b"\x05\0"


def test_cut_short_keeps_what_came_before():
    whole = write({"Rows": 3, "PatientName": "LONG NAME"})
    got = part10.parse(whole[:-4])
    assert got[-1].value_length > 0 and len(part10.parse(whole[: len(whole) - 5])) <= len(part10.parse(whole))
    clipped = by_tag(whole[:132] + element(TAG["TransferSyntaxUID"], EXPLICIT_LE) + struct.pack("<HH", 0x10, 0x10) + b"PN" + struct.pack("<H", 50) + b"AB")
    assert clipped[TAG["PatientName"]].value_length == 50 and clipped[TAG["PatientName"]].value_bytes == b"AB"


def test_without_pixels_parsing_stops_there():
    assert part10.PIXEL_DATA not in by_tag(write({"Rows": 1}, pixel_data=bytes(10)), pixels=False)


def test_long_headers_of_64_bit_vrs():
    content = write([]) + struct.pack("<HH", 0x7001, 1) + b"UV\0\0" + struct.pack("<I", 8) + bytes(8) + element(TAG["Rows"], 2)
    assert by_tag(content)[TAG["Rows"]].value_bytes == b"\x02\0"


def test_encapsulated_frame_of_raw_items():
    raw = item(b"") + item(b"abcd") + item(b"efgh") + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    assert part10.encapsulated_frame(raw, 0) == b"abcd" and part10.encapsulated_frame(raw, 1) == b"efgh"
    assert part10.encapsulated_frame(raw, 5) == raw and part10.encapsulated_frame(b"plain bytes", 0) == b"plain bytes"
