"""Part-10 bytes to data elements: the one place where bytes are walked in Python.

Elements come in file order; a later element of the same tag hides an earlier one (`is_last`). Sequences
of undefined length are skipped as a whole, nested ones too, and the file meta group is always explicit
little endian, whatever the data set's transfer syntax.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from pixelloom.errors import FORMAT, ImageError
from pixelloom.functions.dictionaries import DICTIONARY, EXPLICIT_LE, LONG_VRS, LONGER_VRS, SYNTAXES, UNKNOWN, VRS

PIXEL_DATA, SYNTAX_UID = 0x7FE00010, 0x00020010
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
UNDEFINED = 0xFFFFFFFF
_KNOWN, _LONG, _LONGER = set(VRS), set(LONG_VRS), set(LONGER_VRS)
_SYNTAX = {uid: (explicit, little) for uid, _, explicit, little, _ in SYNTAXES}


#: What counts as white space at a value's ends (Unicode white space and U+FEFF).
BLANKS = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Value representations of bytes that are no text; their text is only made where it is asked for.
BYTES = frozenset(("OB", "OD", "OF", "OL", "OW", "SQ"))
NUMBERS = {"US": ("H", 2), "UL": ("I", 4), "SS": ("h", 2), "SL": ("i", 4), "FL": ("f", 4), "FD": ("d", 8)}
DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
INTEGER = re.compile(r"[+-]?[0-9]+")
HEXADECIMAL = re.compile(r"[+-]?0[xX][0-9a-fA-F]{1,15}")
WORDS = {"NaN": float("nan"), "Infinity": float("inf"), "+Infinity": float("inf"), "-Infinity": float("-inf")}


@dataclass
class Element:
    tag: int
    vr: str
    value_length: int
    value_bytes: bytes
    is_little_endian: bool
    encapsulated: dict | None = None


def text_of(value: bytes) -> str:
    """Bytes as text: malformed UTF-8 replaced, ends trimmed, NULs dropped, ends trimmed again."""
    return value.decode("utf-8", "replace").strip(BLANKS).replace("\0", "").strip(BLANKS)


def decimal_of(s: str) -> float | None:
    s = s.strip(BLANKS)
    return float(s) if DECIMAL.fullmatch(s) else WORDS.get(s)


def whole_of(s: str) -> int | None:
    s = s.strip(BLANKS)
    n = int(s) if INTEGER.fullmatch(s) else int(s, 16) if HEXADECIMAL.fullmatch(s) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def decoded(e: Element) -> dict:
    """The element's value as text, whole number, decimal number and list of decimal numbers; all null for byte VRs.

    The same as the column functions as_string, as_int, as_double and as_double_list give.
    """
    if e.vr in BYTES:
        return {"text": None, "whole": None, "decimal": None, "decimals": None}
    value, text = e.value_bytes, text_of(e.value_bytes)
    decimals = [x for x in map(decimal_of, text.split("\\")) if x is not None] if text else []
    whole = decimal = None
    if e.vr in NUMBERS:
        code, size = NUMBERS[e.vr]
        if len(value) >= size:
            (n,) = struct.unpack_from(("<" if e.is_little_endian else ">") + code, value)
            whole, decimal = (None, n) if code in "fd" else (n, None)
    first = text.split("\\", 1)[0]
    if value and whole is None and e.vr not in ("US", "UL", "SS", "SL"):
        if e.vr in ("IS", "DS", "CS", "SH", "LO"):
            whole = whole_of(first)
            if whole is None and (d := decimal_of(first)) is not None and abs(d) < 9.2e18:
                whole = int(d)
        else:
            whole = whole_of(text)
    if value and decimal is None and e.vr not in ("FL", "FD"):
        decimal = decimal_of(first if e.vr in ("DS", "IS") else text)
    return {"text": text, "whole": whole, "decimal": decimal, "decimals": decimals}


@dataclass
class _Reader:
    data: memoryview
    at: int = 0
    explicit: bool = True
    little: bool = True
    elements: list[Element] = field(default_factory=list)

    def number(self, at: int, size: int, little: bool) -> int:
        return int.from_bytes(self.data[at : at + size], "little" if little else "big")

    def tag(self, at: int, little: bool) -> int:
        return self.number(at, 2, little) << 16 | self.number(at + 2, 2, little)

    def header(self, explicit: bool, little: bool) -> tuple[int, str, int, bool] | None:
        """Tag, VR, length and byte order of the element at `at`, which moves past it; null if it is cut short."""
        tag, n = self.tag(self.at, little), len(self.data)
        if self.tag(self.at, True) >> 16 == 2:  # file meta information
            tag, explicit, little = self.tag(self.at, True), True, True
        at = self.at + 4
        if tag >> 16 == 0xFFFE or not explicit:
            if at + 4 > n:
                return None
            vr = UNKNOWN if tag >> 16 == 0xFFFE else implicit_vr(tag)
            self.at = at + 4
            return tag, vr, self.number(at, 4, little), little
        if at + 2 > n:
            return None
        code = bytes(self.data[at : at + 2]).decode("utf-8", "replace").upper()
        wide = code in _LONG or code in _LONGER
        at, size = (at + 4, 4) if wide else (at + 2, 2)
        if at + size > n:
            return None
        self.at = at + size
        return tag, code if code in _KNOWN else UNKNOWN, self.number(at, size, little), little

    def skip_sequence(self, explicit: bool, little: bool) -> bool:
        """Move past a sequence of undefined length, its end mark included; False if its structure does not hold."""
        n = len(self.data)
        while self.at + 8 <= n:
            tag, length = self.tag(self.at, little), self.number(self.at + 4, 4, little)
            if tag == SEQUENCE_END:
                self.at += 8
                return True
            if tag != ITEM:
                return False
            self.at += 8
            if length != UNDEFINED:
                if self.at + length > n:
                    return False
                self.at += length
                continue
            while True:
                if self.at + 8 > n:
                    return False
                if self.tag(self.at, little) == ITEM_END:
                    self.at += 8
                    break
                head = self.header(explicit, little)
                if head is None:
                    return False
                if head[2] == UNDEFINED:
                    if not self.skip_sequence(explicit, little):
                        return False
                elif self.at + head[2] > n:
                    return False
                else:
                    self.at += head[2]
        return False

    def scan_for_end(self, little: bool) -> None:
        """Move past the next sequence end mark, two bytes at a time, or to the end of the data."""
        while self.at + 8 <= len(self.data):
            tag = self.tag(self.at, little)
            if tag == SEQUENCE_END:
                self.at += 8
                return
            self.at += 8 if tag == ITEM else 2

    def fragments(self, little: bool) -> dict:
        """Encapsulated pixel data: the offset table, then fragments with their offsets from the first one's tag."""
        offsets, parts, first, start, n = [], [], True, 0, len(self.data)
        while self.at + 8 <= n:
            tag, length = self.tag(self.at, little), self.number(self.at + 4, 4, little)
            self.at += 8
            if tag == SEQUENCE_END:
                break
            fits = 0 < length != UNDEFINED and self.at + length <= n
            if tag == ITEM and first:
                first = False
                if length == UNDEFINED or length % 4:
                    raise ImageError(FORMAT, f"Invalid Basic Offset Table item length ({length} bytes). BOT length must be a multiple of 4.")
                if self.at + length > n:
                    raise ImageError(FORMAT, f"Truncated DICOM file: Basic Offset Table item length ({length} bytes) extends beyond file length.")
                offsets = [self.number(self.at + i, 4, little) for i in range(0, length, 4)]
                self.at += length
            elif fits:
                if tag == ITEM:
                    parts.append({"index": len(parts) + 1, "relative_tag_start": start, "payload": bytes(self.data[self.at : self.at + length])})
                    start += 8 + length
                self.at += length
        return {"bot_offsets": offsets, "fragments": parts}


def implicit_vr(tag: int) -> str:
    return DICTIONARY[tag][0] if tag in DICTIONARY else "UL" if not tag & 0xFFFF else "UN"


def parse(content: bytes, pixels: bool = True) -> list[Element]:
    """The file's elements. Without `pixels` parsing stops at the pixel data, which is left out."""
    n = len(content)
    if n < 8:
        raise ImageError(FORMAT, "Invalid DICOM file: Data length is less than 8 bytes.")
    marked = content[128:132] == b"DICM"
    if not marked and n < 132:
        raise ImageError(FORMAT, f"Invalid DICOM file: Truncated or missing DICM header ({n} bytes).")
    r = _Reader(memoryview(content), 132 if marked else 0)
    r.explicit, r.little = _SYNTAX[EXPLICIT_LE]
    while r.at + 4 <= n:
        head = r.header(r.explicit, r.little)
        if head is None:
            break
        tag, vr, length, little = head
        explicit = r.explicit if tag >> 16 not in (2, 0xFFFE) else tag >> 16 == 2
        if tag == PIXEL_DATA and not pixels:
            break
        if length == UNDEFINED and tag == PIXEL_DATA:
            r.elements.append(Element(tag, vr, 0, b"", little, r.fragments(little)))
            continue
        if length == UNDEFINED and (not explicit or vr in ("SQ", "UN", UNKNOWN)):
            start = r.at
            if not r.skip_sequence(r.explicit and vr != "UN", little):
                r.at = start
                r.scan_for_end(little)
            value = bytes(r.data[start : r.at])
            r.elements.append(Element(tag, "SQ" if vr in ("UN", UNKNOWN) else vr, len(value), value, little))
            continue
        if length == UNDEFINED:
            length = 0
        value = bytes(r.data[r.at : r.at + length])
        r.at += len(value)
        r.elements.append(Element(tag, vr, length, value, little))
        if tag == SYNTAX_UID:
            r.explicit, r.little = _SYNTAX.get(text_of(value), (True, True))
    return r.elements


def encapsulated_frame(pixel_bytes: bytes, frame_index: int = 0) -> bytes:
    """Frame `frame_index` of raw item-delimited pixel bytes: the item after the first that many; all bytes where there is none."""
    if len(pixel_bytes) < 8 or struct.unpack_from("<HH", pixel_bytes) != (0xFFFE, 0xE000):
        return pixel_bytes
    at, seen = 0, -1  # the first item is the offset table
    while at + 8 <= len(pixel_bytes):
        group, element, length = struct.unpack_from("<HHI", pixel_bytes, at)
        at += 8
        if (group, element) == (0xFFFE, 0xE0DD):
            break
        if (group, element) != (0xFFFE, 0xE000):
            at += 2
            continue
        if seen == frame_index:
            return pixel_bytes[at : at + length]
        seen += 1
        at += length
    return pixel_bytes
