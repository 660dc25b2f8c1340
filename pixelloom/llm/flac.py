"""FLAC media columns: write byte payloads as 8-bit mono FLAC, read any FLAC back as PCM blocks.

Writing cuts a payload into frames and codes each with the cheapest of the fixed predictors and a
short linear predictor, its residuals in Rice code; a seek table gives byte offsets of every
`SEEK_EVERY`-th frame. Reading finds the frames by their headers (sync code, CRC-8, running
number), checks every frame's CRC-16 and the stream's MD5, and decodes frames of one kind in
lockstep: step t reads the t-th Rice code of all frames at once and adds the linear prediction.
Frames of any other kind the format allows (several channels, constant or verbatim subframes,
partitioned or escaped residuals, wasted bits) go through a plain bit reader.

Defined cases: null payloads count as empty, and an empty or short text is padded to one frame by
the query. Equal payloads give equal streams, so repeated rows too. Very long payloads are coded whole, frame by frame. A
broken stream is its row's error: `pcm_blocks` and `media_features` give what is wrong and null for the rest, and go on. An
empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

BLOCK, SEEK_EVERY, RATE, LPC_ORDER, PRECISION = 192, 32, 8000, 2, 8
SLICE = 1 << 19
#: Fixed values of the format: coefficients of the fixed predictors of order 0 to 4.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Fixed values of the format: samples in a frame by 4-bit code, bits of a sample by 3-bit code.
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class FlacError(ValueError):
    """A stream that is not FLAC, is cut short or fails a check sum."""


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, out = 1 << (width - 1), []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & ((1 << width) - 1)
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wide: bool) -> np.ndarray:
    """CRC of each data[start : start + length], all in step; longest first, so that the rest drop out."""
    order = np.argsort(-lengths, kind="stable")
    at, left, crc = starts[order].copy(), lengths[order], np.zeros(len(starts), np.uint32)
    live = len(at)
    for step in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= step:
            live -= 1
        byte = data[at[:live] + step]
        if wide:
            crc[:live] = ((crc[:live] << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(crc[:live] >> np.uint32(8)) ^ byte]
        else:
            crc[:live] = CRC8[crc[:live] ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _numbered(i: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if i < 128:
        return bytes([i])
    tail = []
    lead = 0x3F
    while i > lead:
        tail.append(0x80 | i & 0x3F)
        i >>= 6
        lead >>= 1
    return bytes([(~lead << 1) & 0xFF | i, *reversed(tail)])


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter and cost in bits of each row of folded residuals, of the two next to log2(mean)."""
    n = max(1, u.shape[1])
    low = np.clip(np.floor(np.log2(np.maximum(u.sum(axis=1) / n, 1))).astype(np.int64), 0, 13)
    costs = [(u >> k[:, None]).sum(axis=1) + n * (k + 1) for k in (low, low + 1)]
    return np.where(costs[0] <= costs[1], low, low + 1), np.minimum(*costs)


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each row's linear predictor (autocorrelation, Levinson-Durbin)."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, i:] * f[:, : f.shape[1] - i]).sum(axis=1) for i in range(order + 1)])
    a, err = np.zeros((order, len(x))), np.maximum(r[0], 1e-9)
    for i in range(order):
        k = np.clip((r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err, -0.999, 0.999)
        a[:i] -= k * a[:i][::-1].copy()
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(axis=0), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a.T * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coefs.shape[1]
    guess = np.zeros((len(x), x.shape[1] - order), np.int64)
    for i in range(order):
        guess += coefs[:, i : i + 1] * x[:, order - 1 - i : x.shape[1] - 1 - i]
    return x[:, order:] - (guess >> shift[:, None])


def _frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Each row of 8-bit samples as one frame."""
    n, size = x.shape
    fold = lambda r: np.where(r < 0, -2 * r - 1, 2 * r)
    zero = np.zeros(n, np.int64)
    plans = [(o, np.broadcast_to(np.array(c, np.int64), (n, o)), zero, 8 + 8 * o) for o, c in enumerate(FIXED) if o < size]
    if size > LPC_ORDER:
        plans.append((LPC_ORDER, *_lpc(x, LPC_ORDER), 8 + 8 * LPC_ORDER + 9 + PRECISION * LPC_ORDER))
    best = np.full(n, np.iinfo(np.int64).max)
    plan, k = zero.copy(), zero.copy()
    for i, (_, coefs, shift, extra) in enumerate(plans):
        kk, cost = _rice(fold(_residual(x, coefs, shift)))
        better = cost + extra < best
        best, plan, k = np.where(better, cost + extra, best), np.where(better, i, plan), np.where(better, kk, k)
    code = next((c for c, s in SIZES.items() if s == size), 7)
    heads = [bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _numbered(i) + (b"" if code != 7 else struct.pack(">H", size - 1)) for i in number.tolist()]
    head_len = np.array([len(h) for h in heads], np.int64) + 1
    body = (best + 10 + 7) // 8  # plan bits, then method, partition order and parameter
    total = head_len + body + 2
    start = np.concatenate([[0], np.cumsum(total)])
    bits = np.zeros(int(start[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = (value >> (width - 1 - j)) & 1

    for i, (order, coefs, shift, _) in enumerate(plans):
        for kk in np.unique(k[plan == i]):
            own = np.nonzero((plan == i) & (k == kk))[0]
            xs, at = x[own], (start[own] + head_len[own]) * 8
            lpc = i == len(FIXED)
            put(at, np.full(len(own), 0x40 | (order - 1) << 1 if lpc else 0x10 | order << 1), 8)
            at = at + 8
            for j in range(order):
                put(at, xs[:, j] & 0xFF, 8)
                at = at + 8
            if lpc:
                put(at, np.full(len(own), PRECISION - 1), 4)
                put(at + 4, shift[own], 5)
                at = at + 9
                for j in range(order):
                    put(at, coefs[own, j] & ((1 << PRECISION) - 1), PRECISION)
                    at = at + PRECISION
            put(at, np.full(len(own), int(kk)), 10)
            u = fold(_residual(xs, coefs[own], shift[own]))
            q = u >> kk
            width = q + (1 + kk)
            one = (at + 10)[:, None] + np.cumsum(width, axis=1) - (1 + kk)
            bits[one] = 1
            for j in range(int(kk)):
                bits[one + 1 + j] = (u >> (kk - 1 - j)) & 1
    data = np.packbits(bits)
    head_bytes = np.frombuffer(b"".join(h + b"\0" for h in heads), np.uint8)
    at = np.repeat(start[:-1] - np.concatenate([[0], np.cumsum(head_len)[:-1]]), head_len) + np.arange(len(head_bytes))
    data[at] = head_bytes
    data[start[:-1] + head_len - 1] = _crcs(data, start[:-1], head_len - 1, False)
    crc = _crcs(data, start[:-1], total - 2, True)
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 0xFF
    raw = data.tobytes()
    cuts = start.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """Each payload as a FLAC stream of 8-bit mono samples (byte - 128); an empty one has no frames."""
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) - 128
    lengths = [len(p) for p in payloads]
    wanted: dict[int, list[tuple[int, int, int]]] = {}  # by frame size: payload, frame number, first sample
    base = 0
    for p, n in enumerate(lengths):
        for i, at in enumerate(range(0, n, block)):
            wanted.setdefault(min(block, n - at), []).append((p, i, base + at))
        base += n
    frames: list[list[bytes]] = [[b""] * -(-n // block) for n in lengths]
    for size, rows in wanted.items():
        who = np.array(rows, np.int64)
        for (p, i, _), f in zip(rows, _frames(data[who[:, 2][:, None] + np.arange(size)], who[:, 1])):
            frames[p][i] = f
    out = []
    for payload, own in zip(payloads, frames):
        sizes = [len(f) for f in own]
        starts = [0]
        for s in sizes:
            starts.append(starts[-1] + s)
        points = b"".join(struct.pack(">QQH", i * block, starts[i], min(block, len(payload) - i * block)) for i in range(0, len(own), SEEK_EVERY))
        digest = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = struct.pack(">HH", block, block) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


@dataclass
class StreamInfo:
    block: int
    rate: int
    channels: int
    depth: int
    samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]  # first sample, byte offset from the first frame, samples
    audio: int  # where frames begin


def stream_info(media: bytes) -> StreamInfo:
    if media[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info, seek = 4, None, []
    while True:
        if at + 4 > len(media):
            raise FlacError("metadata cut short")
        kind, n = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if len(body) < n:
            raise FlacError("metadata cut short")
        if kind & 0x7F == 0 and n < 34 or kind & 0x7F == 3 and n % 18:
            raise FlacError("metadata of a wrong size")
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = (int.from_bytes(body[2:4], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34])
        elif kind & 0x7F == 3:
            seek = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + n
        if kind & 0x80:
            break
    if info is None:
        raise FlacError("no stream info")
    return StreamInfo(*info, seek, at)


class _Bits:
    """A plain bit reader."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        end = self.at + n
        if end > len(self.data) * 8:
            raise FlacError("frame cut short")
        whole = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big")
        self.at = end
        return whole >> (-end % 8) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _frame_head(b: _Bits, info: StreamInfo) -> tuple[int, int, int, int, bool]:
    """Frame number (or first sample), samples, channel code, bits of a sample, and whether sizes vary."""
    start = b.at >> 3
    if b.take(15) != 0x7FFC:
        raise FlacError("no frame sync")
    varies, size, rate, channels, depth = bool(b.take(1)), b.take(4), b.take(4), b.take(4), b.take(3)
    if b.take(1) or channels > 10 or size == 0 or rate == 15:
        raise FlacError("reserved frame header bits")
    lead = b.take(8)
    more = 0
    while lead & 0x80 >> more:
        more += 1
    number = lead & 0x7F >> more
    for _ in range(max(0, more - 1)):
        number = number << 6 | b.take(8) & 0x3F
    n = SIZES[size] if size in SIZES else b.take(8 * (size - 5)) + 1
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    want = 0
    for byte in b.data[start : b.at >> 3]:
        want = int(CRC8[want ^ byte])
    if b.take(8) != want:
        raise FlacError("frame header check sum")
    return number, n, channels, DEPTHS.get(depth, info.depth), varies


def _subframe(b: _Bits, n: int, depth: int) -> list[int]:
    if b.take(1):
        raise FlacError("subframe padding bit")
    kind, wasted = b.take(6), b.take(1)
    if wasted:
        wasted += b.zeros()
    depth -= wasted
    if kind == 0:
        out = [b.signed(depth)] * n
    elif kind == 1:
        out = [b.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(depth) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coefs = [b.signed(precision) for _ in range(order)]
        method, parts = b.take(2), b.take(4)
        if method > 1:
            raise FlacError("residual method")
        wide = 4 + method
        for part in range(1 << parts):
            k = b.take(wide)
            escaped = b.take(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if part == 0 else 0)):
                if escaped is not None:
                    r = b.signed(escaped)
                else:
                    u = b.zeros() << k
                    u |= b.take(k)
                    r = -(u >> 1) - 1 if u & 1 else u >> 1
                out.append(r + (sum(c * out[-1 - i] for i, c in enumerate(coefs)) >> shift))
    else:
        raise FlacError("reserved subframe kind")
    return [x << wasted for x in out] if wasted else out


def decode_frame(media: bytes, at: int, info: StreamInfo) -> tuple[int, int, np.ndarray]:
    """One frame at byte `at`: its first sample, the byte after it, its samples as [channel, sample]."""
    b = _Bits(media, at)
    number, n, channels, depth, varies = _frame_head(b, info)
    subs = []
    for c in range(channels + 1 if channels < 8 else 2):
        side = (channels, c) in ((8, 1), (9, 0), (10, 1))
        subs.append(np.array(_subframe(b, n, depth + side), np.int64))
    if channels == 8:
        subs[1] = subs[0] - subs[1]
    elif channels == 9:
        subs[0] = subs[0] + subs[1]
    elif channels == 10:
        mid = subs[0] * 2 + (subs[1] & 1)
        subs = [(mid + subs[1]) >> 1, (mid - subs[1]) >> 1]
    b.at = (b.at + 7) // 8 * 8
    end = b.at >> 3
    want = 0
    for byte in media[at:end]:
        want = (want << 8 & 0xFFFF) ^ int(CRC16[want >> 8 ^ byte])
    if b.take(16) != want:
        raise FlacError("frame check sum")
    return number if varies else number * info.block, end + 2, np.stack(subs)


def read_at(media: bytes, first: int, count: int) -> np.ndarray:
    """Samples [first, first + count) as [channel, sample], decoded from the nearest seek point before them."""
    info = stream_info(media)
    point = max((p for p in info.seek if p[0] <= first), default=(0, 0, 0))
    at, got = info.audio + point[1], []
    while at < len(media):
        where, at, samples = decode_frame(media, at, info)
        if where >= first + count:
            break
        got.append(samples[:, max(0, first - where) : first + count - where])
    return np.concatenate(got, axis=1) if got else np.zeros((info.channels, 0), np.int64)


def _plain(media: bytes, info: StreamInfo) -> list[tuple[int, np.ndarray]]:
    at, out = info.audio, []
    while at < len(media):
        where, at, samples = decode_frame(media, at, info)
        out.append((where, samples))
    return out


def _lockstep(data: np.ndarray, head: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mono 8-bit frames of one size, decoded in step. head: where subframes begin; end: where check sums do.

    Returns which frames this could decode, and their samples.
    """
    bits = np.unpackbits(data)
    none = len(bits)
    one = np.minimum.accumulate(np.where(bits, np.arange(none, dtype=np.int32), np.int32(none))[::-1])[::-1]
    one = np.concatenate([one, np.full(64, none, np.int32)])
    del bits
    d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]

    def take(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        w = (word[at >> 3] << (at & 7).astype(np.uint32)).astype(np.int64)
        return w >> (32 - n)

    kind = data[head]
    lpc = (kind & 0xC1) == 0x40
    order = np.where(lpc, ((kind >> 1) & 31) + 1, np.where((kind & 0xF1) == 0x10, (kind >> 1) & 7, 99)).astype(np.int64)
    fine = np.where(lpc, order <= 24, order <= 4) & (order < size) & ((kind & 0x80) == 0)
    out = np.zeros((len(head), size), np.int64)
    for is_lpc, o in {(bool(a), int(b)) for a, b in zip(lpc[fine], order[fine])}:
        own = np.nonzero(fine & (lpc == is_lpc) & (order == o))[0]
        at = head[own] * 8 + 8
        x = np.zeros((size, len(own)), np.int64)
        for t in range(o):
            v = take(at, 8)
            x[t] = np.where(v > 127, v - 256, v)
            at = at + 8
        if is_lpc:
            precision, shift = take(at, 4) + 1, take(at + 4, 5)
            at = at + 9
            coefs = []
            for _ in range(o):
                v = take(at, precision)
                coefs.append(np.where(v >> (precision - 1) == 1, v - (1 << precision), v))
                at = at + precision
            odd = shift > 15
        else:
            coefs, shift, odd = [np.full(len(own), c) for c in FIXED[o]], np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        rice = take(at, 10)  # method, partition order, parameter: one partition, not escaped, if under 15
        odd |= rice >= 15
        fine[own[odd]] = False
        k, at = rice & 15, at + 10
        for t in range(o, size):
            at = np.minimum(at, none)
            stop = one[at].astype(np.int64)
            u = (stop - at) << k | take(np.minimum(stop + 1, none), k)
            at = stop + 1 + k
            r = (u >> 1) ^ -(u & 1)
            if o:
                guess = coefs[0] * x[t - 1]
                for i in range(1, o):
                    guess += coefs[i] * x[t - 1 - i]
                r = r + (guess >> shift)
            x[t] = r
        if ((at + 7) // 8 != end[own])[~odd].any():
            raise FlacError("frame ends elsewhere than its residuals")
        out[own] = x.T
    return fine, out


def decode(media: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """Each stream's PCM blocks: first sample, and samples as [channel, sample]. All check sums are verified."""
    infos = [stream_info(m) for m in media]
    data = np.frombuffer(b"".join(media), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(m) for m in media])]).astype(np.int64)
    found = np.nonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))[0] if len(data) else np.zeros(0, np.int64)
    stream = np.searchsorted(base, found, "right") - 1
    ok = found >= (base[:-1] + np.array([i.audio for i in infos], np.int64))[stream] if len(found) else np.zeros(0, bool)
    found, stream = found[ok], stream[ok]
    wide = np.concatenate([data, np.zeros(24, np.uint8)])
    code, lead = wide[found + 2] >> 4, wide[found + 4]
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 9, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & (0x3F >> more)).astype(np.int64)
    for i in range(1, 7):
        number = np.where((more >= i) & (more < 9), number << 6 | wide[found + 4 + np.minimum(i, more)] & 0x3F, number)
    extra = np.select([code == 6, code == 7], [1, 2], 0)
    at = found + 5 + more
    size = np.array([SIZES.get(c, 0) for c in range(16)])[code]
    size = np.where(code == 6, wide[np.minimum(at, len(data))].astype(np.int64) + 1, np.where(code == 7, wide[np.minimum(at, len(data))].astype(np.int64) * 256 + wide[np.minimum(at + 1, len(data))] + 1, size))
    crc_at = at + extra
    simple = (more < 9) & (wide[found + 2] & 15 == 4) & (wide[found + 3] == 0x02) & (code != 0) & (crc_at < len(data))
    found, stream, number, size, crc_at = (v[simple] for v in (found, stream, number, size, crc_at))
    good = _crcs(data, found, crc_at - found, False) == data[crc_at] if len(found) else np.zeros(0, bool)
    found, stream, number, size, crc_at = (v[good] for v in (found, stream, number, size, crc_at))
    # A stream goes in step if its frames are numbered without gaps and each passes its check sum.
    first = np.searchsorted(stream, np.arange(len(media) + 1))
    end = np.append(found[1:], len(data)) if len(found) else found
    end = np.minimum(end, base[stream + 1])
    crc = _crcs(data, found, np.maximum(end - found - 2, 0), True) if len(found) else np.zeros(0, np.uint32)
    sound = (crc == (data[end - 2].astype(np.uint32) << np.uint32(8) | data[end - 1])) & (number == np.arange(len(found)) - first[stream]) if len(found) else np.zeros(0, bool)
    out: list[list[tuple[int, np.ndarray]] | None] = [None] * len(media)
    step = np.ones(len(media), bool)
    np.logical_and.at(step, stream, sound)
    for s, i in enumerate(infos):
        a, b = first[s], first[s + 1]
        step[s] &= i.channels == 1 and i.depth == 8 and int(size[a:b].sum()) == i.samples and (b == a or found[a] == base[s] + i.audio)
    blocks = np.zeros(len(found), object)
    for n in np.unique(size[step[stream]]) if len(found) else []:
        own = np.nonzero(step[stream] & (size == n))[0]
        fine, x = _lockstep(data, crc_at[own] + 1, end[own] - 2, int(n))
        blocks[own[fine]] = list(x[fine][:, None, :])
        step[stream[own[~fine]]] = False
    for s, i in enumerate(infos):
        if step[s]:
            out[s] = [(k * i.block, blocks[f]) for k, f in enumerate(range(first[s], first[s + 1]))]
        else:
            out[s] = _plain(media[s], i)
        if any(i.md5):
            pcm = np.concatenate([x for _, x in out[s]], axis=1) if out[s] else np.zeros((i.channels, 0), np.int64)
            wide_b = (i.depth + 7) // 8
            raw = np.ascontiguousarray(pcm.T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :wide_b].tobytes()
            if hashlib.md5(raw).digest() != i.md5:
                raise FlacError("stream check sum")
    return out


def _batches(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    values = column.to_pylist()
    i = 0
    while i < len(values):
        j, n = i, 0
        while j < len(values) and (j == i or n + len(values[j] or b"") <= limit):
            n += len(values[j] or b"")
            j += 1
        yield i, [v or b"" for v in values[i:j]]
        i = j


def _read(streams: list[bytes]) -> list[tuple[list[tuple[int, np.ndarray]] | None, str | None]]:
    """Each stream's blocks, or null and what is wrong with it."""
    try:
        return [(blocks, None) for blocks in decode(streams)]
    except FlacError:
        out: list[tuple[list[tuple[int, np.ndarray]] | None, str | None]] = []
        for stream in streams:
            try:
                out.append((decode([stream])[0], None))
            except FlacError as e:
                out.append((None, str(e)))
        return out


def write_media(rows: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """rows with the binary payload column replaced, in place, by its FLAC stream under the name media_col."""
    at = rows.columns.index(payload_col)
    schema = StructType([*rows.schema.fields[:at], StructField(media_col, BinaryType()), *rows.schema.fields[at + 1 :]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, payloads in _batches(batch.column(at).cast(pa.large_binary())):
                part = batch.slice(i, len(payloads))
                yield part.set_column(at, pa.field(media_col, pa.binary()), pa.array(encode(payloads), pa.binary()))

    return rows.mapInArrow(write, schema)


def pcm_blocks(media: DataFrame, block_frames: int = SEEK_EVERY) -> DataFrame:
    """doc_id, sample_offset, n_samples, channels, pcm (little-endian samples) and error: blocks that can be sought by offset.

    A stream that can't be read gives one row, with its error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, streams in _batches(batch.column(1).cast(pa.large_binary())):
                rows: list[tuple] = []
                for doc, stream, (blocks, wrong) in zip(ids[i:], streams, _read(streams)):
                    if blocks is None:
                        rows.append((doc, None, None, None, None, wrong))
                        continue
                    width = (stream_info(stream).depth + 7) // 8
                    for b in range(0, len(blocks), block_frames):
                        x = np.concatenate([s for _, s in blocks[b : b + block_frames]], axis=1)
                        raw = np.ascontiguousarray(x.T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                        rows.append((doc, blocks[b][0], x.shape[1], x.shape[0], raw, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()))], names=["doc_id", "sample_offset", "n_samples", "channels", "pcm", "error"])

    return media.select("doc_id", "media").mapInArrow(read, "doc_id long, sample_offset long, n_samples long, channels int, pcm binary, error string")


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with each stored stream, read back, replaced by what it shows: sizes, digests, a feature string, and the error of one that can't be read.

    The feature string has the count of frames, and the samples' sum, absolute peak and sign changes.
    """
    at = media.columns.index(media_col)
    new = [("payload_bytes", LongType(), pa.int64()), ("payload_sha256", StringType(), pa.string()), ("tail_crc32", LongType(), pa.int64()), ("media_bytes", LongType(), pa.int64()), ("media_sha256", StringType(), pa.string()), ("feature", StringType(), pa.string()), ("error", StringType(), pa.string())]
    schema = StructType([f for i, f in enumerate(media.schema.fields) if i != at] + [StructField(n, t) for n, t, _ in new])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, streams in _batches(batch.column(at).cast(pa.large_binary())):
                cols: list[list] = [[] for _ in new]
                for stream, (blocks, wrong) in zip(streams, _read(streams)):
                    if blocks is None:
                        for c, v in zip(cols, (None, None, None, len(stream), hashlib.sha256(stream).hexdigest(), None, wrong)):
                            c.append(v)
                        continue
                    x = np.concatenate([s[0] for _, s in blocks]) if blocks else np.zeros(0, np.int64)
                    payload = (x + 128).astype(np.uint8).tobytes()
                    signs = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                    feature = f"frames={len(blocks)};sum={int(x.sum())};peak={int(np.abs(x).max(initial=0))};turns={signs}"
                    for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, None)):
                        c.append(v)
                part = batch.slice(i, len(streams))
                kept = [k for k in range(batch.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *(pa.array(c, t) for c, (_, _, t) in zip(cols, new))], names=[*(batch.schema.names[k] for k in kept), *(n for n, _, _ in new)])

    return media.mapInArrow(read, schema)
