import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import flac
from pixelloom.llm.queries import op3_flac_columns


def joined(blocks):
    return (np.concatenate([x[0] for _, x in blocks]) + 128).astype(np.uint8).tobytes() if blocks else b""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=700), st.sampled_from([b"", bytes([255, 248]) * 300, b" " * 500, bytes(range(256)) * 3])), min_size=1, max_size=5), st.sampled_from([16, 192, 300, 4608]))
def test_round_trip(payloads, block):
    media = flac.encode(payloads, block)
    assert [joined(b) for b in flac.decode(media)] == payloads
    assert [joined(flac._plain(m, flac.stream_info(m))) for m in media] == payloads  # both readers


def test_streams_are_the_same_alone_and_together():
    payloads = [b"one text" * 60, b"another" * 90, b"one text" * 60]
    together = flac.encode(payloads)
    assert together == [flac.encode([p])[0] for p in payloads] and together[0] == together[2]


def test_seek():
    payload = np.random.default_rng(0).integers(60, 120, 20000).astype(np.uint8).tobytes()
    (media,) = flac.encode([payload])
    info = flac.stream_info(media)
    assert len(info.seek) == -(-20000 // (192 * flac.SEEK_EVERY)) and info.samples == 20000
    for first, n in ((0, 5), (191, 2), (6143, 3), (19990, 50), (20000, 3)):
        assert (flac.read_at(media, first, n)[0] + 128).astype(np.uint8).tobytes() == payload[first : first + n]


@pytest.mark.parametrize("at", [30, 41, -1, -2, -40, -100])
def test_damage_is_found(at):
    media = bytearray(flac.encode([b"some words of a text " * 30])[0])
    media[at] ^= 0x10
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(media)])


def test_cut_short_and_not_flac():
    media = flac.encode([b"some words of a text " * 30])[0]
    for bad in (media[:-5], media[:20], b"RIFF", b""):
        with pytest.raises(flac.FlacError):
            flac.decode([bad])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]
        return self

    def done(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes()


def crc(data, poly, width):
    c = 0
    for byte in data:
        c ^= byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def stream(subframes, n, channels=0, depth_code=1, count=1, depth=8):
    head = bytes([0xFF, 0xF8, 0x64, channels << 4 | depth_code << 1, 0, n - 1])
    head += bytes([crc(head, 7, 8)])
    body = head + subframes.done()
    body += crc(body, 0x8005, 16).to_bytes(2, "big")
    packed = 8000 << 44 | (count - 1) << 41 | (depth - 1) << 36 | n
    info = n.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body


def test_constant_verbatim_and_wasted_bits():
    ((_, x),) = flac.decode([stream(Bits().put(0, 8).put(0xFB, 8), 16)])[0]
    assert x.tolist() == [[-5] * 16]
    verbatim = Bits().put(0b00000011, 8).put(1, 1)  # one wasted bit
    for v in range(16):
        verbatim.put(v, 7)
    ((_, x),) = flac.decode([stream(verbatim, 16)])[0]
    assert x.tolist() == [[2 * v for v in range(16)]]


def test_partitions_and_escape():
    b = Bits().put(0b00010000, 8).put(0, 2).put(1, 4).put(0, 4)  # order 0, two partitions
    for v in range(8):
        b.put(1, v % 3 + 1)  # k = 0: unary
    b.put(15, 4).put(5, 5)
    for v in range(8):
        b.put(v - 4 & 31, 5)
    ((_, x),) = flac.decode([stream(b, 16)])[0]
    assert x.tolist() == [[[0, -1, 1][v % 3] for v in range(8)] + [v - 4 for v in range(8)]]


@pytest.mark.parametrize("channels", [1, 8, 9, 10])
def test_stereo(channels):
    left, right = [3, -4, 10, 7] * 4, [1, -4, -9, 8] * 4
    side = [a - b for a, b in zip(left, right)]
    first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: ([(a + b) >> 1 for a, b in zip(left, right)], side)}[channels]
    b = Bits()
    for k, (samples, wide) in enumerate(((first, channels == 9), (second, channels in (8, 10)))):
        b.put(2, 8)
        for v in samples:
            b.put(v & (511 if wide else 255), 9 if wide else 8)
    ((_, x),) = flac.decode([stream(b, 16, channels, count=2)])[0]
    assert x.tolist() == [left, right]


def test_blocks_and_query_on_awkward_rows(spark, docs, awkward, tmp_path):
    docs(awkward, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(op3_flac_columns(spark, str(tmp_path)).collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    texts = {i: (t or "").encode() for i, t in awkward}
    assert len(got) == len(awkward)
    for r in got:
        raw = texts[r["doc_id"]]
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9][1:] == by_id[10][1:]
    rows = spark.createDataFrame([(1, bytearray(b"abc" * 9000)), (2, None)], "doc_id long, payload binary")
    blocks = flac.pcm_blocks(flac.write_media(rows)).orderBy("sample_offset").collect()
    assert b"".join(bytes(x ^ 128 for x in r["pcm"]) for r in blocks) == b"abc" * 9000
    assert [r["sample_offset"] for r in blocks] == list(range(0, 27000, 192 * flac.SEEK_EVERY)) and {r["doc_id"] for r in blocks} == {1}


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert op3_flac_columns(spark, str(tmp_path)).count() == 0


def test_broken_streams_are_their_rows_errors(spark):
    good = flac.encode([b"payload of this row" * 40, b""])
    flipped = bytearray(good[0])
    flipped[-5] ^= 1
    seek = b"fLaC\x03\x00\x00\x05abcde" + good[0][4:]
    rows = [(1, bytearray(good[0])), (2, flipped), (3, bytearray(b"nothing")), (4, None), (5, bytearray(good[1])), (6, bytearray(good[0][:-3])), (7, bytearray(seek)), (8, bytearray(good[0]))]
    media = spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)
    got = {r["doc_id"]: r for r in flac.media_features(media).collect()}
    bad = {2, 3, 4, 6, 7}
    assert {i for i, r in got.items() if r["error"]} == bad and all((got[i]["payload_sha256"] is None) == (i in bad) for i in got)
    assert got[1][1:] == got[8][1:] and got[1]["payload_bytes"] == 760
    blocks = flac.pcm_blocks(media).collect()
    assert {r["doc_id"] for r in blocks if r["error"]} == bad and {r["doc_id"] for r in blocks if not r["error"]} == {1, 8}
