"""RLE Lossless: PackBits segments to native sample bytes, and back."""

from __future__ import annotations

import struct

import numpy as np

from pixelloom.errors import FORMAT, UNSUPPORTED, ImageError


def unpacked(stream: bytes, size: int) -> bytes:
    """PackBits: short input is filled with zeros, excess ignored. One step a run, not a byte."""
    out, at, end = bytearray(), 0, len(stream)
    while at < end and len(out) < size:
        n = stream[at]
        at += 1
        if n < 128:
            out += stream[at : at + n + 1]
            at += n + 1
        elif n > 128 and at < end:
            out += stream[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size]).ljust(size, b"\0")


def packed(data: bytes) -> bytes:
    """PackBits of data: runs of three or more as repeats, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    cuts = np.concatenate([[0], np.nonzero(np.diff(a))[0] + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n = e - b
        if n < 3:
            literal.extend(data[b:e])
            continue
        flush()
        while n:
            step = min(n, 128)
            out += bytes([(257 - step) & 0xFF, data[b]]) if step > 1 else bytes([0, data[b]])
            n -= step
    flush()
    if len(out) % 2:
        out.append(128)  # a no-op keeps segments even
    return bytes(out)


def encode_frame(samples: bytes, bits_allocated: int = 8, samples_per_pixel: int = 1) -> bytes:
    """Native little-endian samples as an RLE frame: a segment for each byte of each sample, high bytes first."""
    width = (bits_allocated + 7) // 8
    a = np.frombuffer(samples, np.uint8).reshape(-1, samples_per_pixel, width)
    segments = [packed(np.ascontiguousarray(a[:, s, b]).tobytes()) for s in range(samples_per_pixel) for b in reversed(range(width))]
    offsets, at = [], 64
    for segment in segments:
        offsets.append(at)
        at += len(segment)
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(segments))) + b"".join(segments)


def decode_frame(frame: bytes, width: int, height: int, bits_allocated: int, samples_per_pixel: int) -> bytes:
    """An RLE frame as native bytes: 8-bit gray, 16-bit gray (little endian) or 8-bit colour (interleaved)."""
    if len(frame) < 64:
        raise ImageError(FORMAT, f"Invalid RLE frame: Header must be at least 64 bytes (got {len(frame)} bytes).")
    n, *offsets = struct.unpack_from("<16I", frame)
    if not 1 <= n <= 15:
        raise ImageError(FORMAT, f"Invalid RLE header: numSegments must be between 1 and 15 (got {n}).")
    pixels, sample = width * height, (bits_allocated + 7) // 8
    segments = []
    for i in range(n):
        start, end = offsets[i], offsets[i + 1] if i + 1 < n else len(frame)
        if start >= len(frame) or start >= end:
            raise ImageError(FORMAT, f"Invalid RLE segment offset at segment {i}.")
        segments.append(unpacked(frame[start:end], pixels))
    if samples_per_pixel == 1:
        if sample == 1:
            return segments[0]
        if sample != 2:
            raise ImageError(UNSUPPORTED, f"Unsupported RLE bytesPerSample: {sample}")
        if n < 2:
            raise ImageError(FORMAT, f"16-bit RLE grayscale requires 2 segments (got {n}).")
        order = [segments[1], segments[0]]
    elif samples_per_pixel == 3:
        if sample != 1 or n < 3:
            raise ImageError(UNSUPPORTED, f"Unsupported RLE multi-sample format with {sample} bytes/sample and {n} segments.")
        order = segments[:3]
    else:
        raise ImageError(UNSUPPORTED, f"Unsupported RLE samplesPerPixel: {samples_per_pixel}")
    return np.stack([np.frombuffer(s, np.uint8) for s in order], axis=1).tobytes()
