"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can cross (before each run of the space mark), and the chunks
that the worker's cache lacks are laid end to end. A suffix array of that text, ordered by as many
characters as the longest piece has, is built by prefix doubling; every piece is binary-searched in it for
the range of its occurrences; the occurrences become edges, sorted by position into a table by start and
length. Relaxation then joins neighbouring symbols along edges, best score first and leftmost among equals,
until no edge joins two neighbours: the same ids as the library's. Short chunks are relaxed all at once, a join in
each at a time; in a long one the joins wait in a heap, over the same edges. Text is indexed in windows that overlap by
the longest piece, so one long chunk needs no larger suffix array.

Models must be BPE with byte fallback, no normalization, kept white space and a space before each text; others are refused.

Defined cases: null text counts as empty, and an empty text has no ids. The space mark in a text is a space
to the tokenizer, so decoding gives a space for it. Characters without a piece become their bytes. Repeated rows are
encoded alike, and equal scores joined from the left. An empty table gives no rows. Other columns play no part. Ids must be
whole numbers or null; a text id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
ROWS = 500  # texts handled at once
CACHE = 200_000  # chunks; the cache starts anew when full
TEXT = 1 << 18  # characters that are indexed at once
LONG = 256  # characters; longer chunks are relaxed with a heap each, and not kept in the cache
NONE = np.iinfo(np.int64).max


@dataclass
class Pieces:
    text: list[str]
    kind: list[int]  # 0 piece, 1 byte, 2 other
    rank: np.ndarray  # by score, best first; equal scores share one
    id_of: dict[str, int]
    byte_id: list[int]
    raw: list[bytes]  # what each id decodes to
    whole: bool  # whether a piece holds the space mark after another character, so that texts can't be cut
    chars: np.ndarray  # searched pieces' characters, zero at the end
    size: np.ndarray
    ids: np.ndarray


_pieces: dict[str, Pieces] = {}
_caches: dict[str, dict[str, bytes]] = {}


def _fields(data: bytes) -> dict[int, list]:
    """A protocol buffer message's fields by number: whole numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def check(path: str, model: bytes) -> None:
    """Refuse models whose ids these rules would not give."""
    top = _fields(model)
    trainer, normal = (_fields(top.get(k, [b""])[-1]) for k in (2, 3))
    last = lambda fields, k, default: fields.get(k, [default])[-1]
    # Fixed values, from the model format: 3 is the model's type (2 for BPE), 35 byte fallback; 2 a map of characters,
    # 3 a space before the text, 4 white space removed, 5 spaces as marks.
    asked = {"BPE": last(trainer, 3, 1) == 2, "byte fallback": last(trainer, 35, 0) == 1, "no character map": not last(normal, 2, b""), "a space before the text": last(normal, 3, 1) == 1, "white space kept": last(normal, 4, 1) == 0, "spaces as marks": last(normal, 5, 1) == 1}
    lacks = [what for what, held in asked.items() if not held]
    if lacks:
        raise ValueError(f"{path}: this model lacks {', '.join(lacks)}")


def load(path: str) -> Pieces:
    """The model's pieces, once for each worker process."""
    if path not in _pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check(path, sp.serialized_model_proto())
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        kind = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = [bytes([int(t[3:5], 16)]) if k == 1 else b"" if k == 2 else t.replace(MARK, " ").encode() for t, k in zip(text, kind)]
        searched = sorted((i for i in range(n) if kind[i] == 0 and len(text[i]) > 1), key=lambda i: text[i])
        size = np.array([len(text[i]) for i in searched], np.int64)
        chars = np.zeros((len(searched), int(size.max(initial=1)) + 1), np.uint32)
        for r, i in enumerate(searched):
            chars[r, : size[r]] = [ord(c) for c in text[i]]
        whole = any(MARK in t.lstrip(MARK) for t, k in zip(text, kind) if k == 0)
        _pieces[path] = Pieces(text, kind, rank, {t: i for i, (t, k) in enumerate(zip(text, kind)) if k == 0}, byte_id, raw, whole, chars, size, np.array(searched, np.int64))
    return _pieces[path]


def _dense(codes: np.ndarray) -> np.ndarray:
    """Characters as small numbers in the same order, 0 for the separator."""
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    seen[0] = True
    return (np.cumsum(seen) - 1)[codes]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first `depth` characters (0 sorts first and pads the end).

    As many characters as fit 64 bits are one key to begin with; each further sort doubles the prefix.
    """
    rank, n = _dense(codes).astype(np.uint64), len(codes)
    width = max(1, int(rank.max(initial=0)).bit_length())
    done = 1
    while done * 2 * width <= 64 and done < depth:
        after = np.zeros_like(rank)
        after[:-done] = rank[done:]
        rank = rank << np.uint64(done * width) | after
        done *= 2
    while True:
        order = np.argsort(rank)
        if done >= depth:
            return order
        ahead = rank[order]
        new = np.empty(n, np.uint64)
        new[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])]).astype(np.uint64)
        after = np.zeros_like(new)
        after[:-done] = new[done:] + np.uint64(1)
        rank = new * np.uint64(n + 1) + after
        done *= 2


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern, the range of the suffix array whose suffixes begin with it.

    One character at a time: within a pattern's range so far the next character is sorted, so two
    binary searches narrow it. Patterns whose range is empty drop out.
    """
    lo, hi = np.zeros(len(size), np.int64), np.full(len(size), len(order), np.int64)
    codes = np.concatenate([codes, np.zeros(chars.shape[1] + 1, codes.dtype)])
    live = np.arange(len(size))
    for at in range(int(size.max(initial=0))):
        live = live[(size[live] > at) & (lo[live] < hi[live])]
        if not len(live):
            break
        want = chars[live, at]
        for upper in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                open_ = np.nonzero(a < b)[0]
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                c = codes[order[mid] + at]
                right = c <= want[open_] if upper else c < want[open_]
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
            if upper:
                hi[live] = a
            else:
                first = a
        lo[live] = first
    return lo, np.maximum(hi, lo)


def _edges(codes: np.ndarray, p: Pieces, window: int = 2 * TEXT) -> np.ndarray:
    """Position x length: the id of the piece that stands there, or -1."""
    longest = int(p.size.max(initial=1))
    table = np.full((len(codes) + 1, longest + 1), -1, np.int32)
    for w in range(0, len(codes), window):
        part = codes[w : w + window + longest]
        order = suffix_array(part, longest)
        lo, hi = occurrence_ranges(part, order, p.chars, p.size)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        start = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(which))]
        by_place = np.argsort(start)
        table[w + start[by_place], p.size[which[by_place]]] = p.ids[which[by_place]]  # where windows overlap both say the same, or the next one more
    return table


def _relax(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: np.ndarray, p: Pieces) -> np.ndarray:
    """End of the symbol that starts at each place (0 where none starts), after joining along edges in all chunks."""
    n, longest = len(codes), table.shape[1] - 1
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    starts = np.zeros(n + 1, bool)
    for b, e in ((begins, ends),):
        inside = np.zeros(n + 1, np.int64)
        inside[b] += 1
        inside[e] -= 1
        starts = np.cumsum(inside) > 0

    def key(at: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - at
        found = table[at, np.minimum(length, longest)]
        return np.where((length <= longest) & (found >= 0), p.rank[found] * (n + 1) + at, NONE)

    last = np.zeros(n + 1, bool)
    last[ends] = True
    keys = np.full(n + 1, NONE)
    at = np.nonzero(starts)[0]
    at = at[~last[at + 1]]
    keys[at] = key(at, at + 2)
    live, b, e = np.arange(len(begins)), begins, ends
    while len(live):
        # Least key of each live chunk; chunks are laid end to end for one reduction.
        width = e[live] - b[live]
        offset = np.cumsum(width) - width
        flat = np.repeat(b[live] - offset, width) + np.arange(int(width.sum()))
        least = np.minimum.reduceat(keys[flat], offset)
        going = least < NONE
        live, least = live[going], least[going]
        if not len(live):
            break
        left = least % (n + 1)
        mid = after[left]
        right = after[mid]
        keys[mid] = NONE
        starts[mid] = False
        after[left] = right
        more = right < e[live]
        before[right[more]] = left[more]
        keys[left] = NONE
        keys[left[more]] = key(left[more], after[right[more]])
        prior = left > b[live]
        keys[before[left[prior]]] = key(before[left[prior]], right[prior])
    out = np.zeros(n + 1, np.int64)
    out[starts] = after[starts]
    return out[:n]


def _relax_long(begin: int, end: int, table: np.ndarray, rank: list[int]) -> list[int]:
    """The same for one chunk whose joins wait in a heap; a list for the places from `begin` to `end`."""
    n, longest = end - begin, table.shape[1] - 1
    edges = memoryview(np.ascontiguousarray(table[begin:end])).cast("B").cast("i")
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def push(a: int, stop: int) -> None:
        if stop - a <= longest and (piece := edges[a * (longest + 1) + stop - a]) >= 0:
            heapq.heappush(heap, (rank[piece], a, stop))

    for a in range(n - 1):
        push(a, a + 2)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = after[a]
        if b >= n or b < 0 or after[b] != stop:  # one of the two has been joined otherwise
            continue
        after[a], after[b] = stop, -1
        if stop < n:
            before[stop] = a
            push(a, after[stop])
        if before[a] >= 0:
            push(before[a], stop)
    return [begin + x if x > 0 else 0 for x in after]


def _symbol(text: str, p: Pieces) -> list[int]:
    i = p.id_of.get(text)
    return [i] if i is not None else [p.byte_id[x] for x in text.encode()]


def encode_chunks(chunks: list[str], p: Pieces) -> list[bytes]:
    """Each chunk's ids as little-endian unsigned 32-bit numbers."""
    codes = np.frombuffer("\0".join(chunks).encode("utf-32-le") + b"\0\0\0\0", "<u4")
    # A zero in a text would look like a separator; it has no piece and joins nothing, so that does no harm.
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = begins + sizes
    short = sizes <= LONG
    got: list[bytes] = []
    if len(chunks):
        table = _edges(codes, p)
        stop = _relax(codes, begins[short], ends[short], table, p)
        if not short.all():
            rank = p.rank.tolist()
            for a, b in zip(begins[~short].tolist(), ends[~short].tolist()):
                stop[a:b] = _relax_long(a, b, table, rank)
        at = np.nonzero(stop)[0]
        length = stop[at] - at
        ids = table[at, np.minimum(length, table.shape[1] - 1)].astype(np.int64)
        ones = np.nonzero(length == 1)[0]
        kinds, which = np.unique(codes[at[ones]], return_inverse=True)
        single = [_symbol(chr(c), p) for c in kinds.tolist()]
        ids[ones] = np.array([x[0] if len(x) == 1 else -1 for x in single], np.int64)[which] if len(ones) else ids[ones]
        count = np.ones(len(at), np.int64)
        wide = np.nonzero(ids[ones] < 0)[0]
        count[ones[wide]] = [len(single[w]) for w in which[wide].tolist()]
        flat = np.repeat(ids, count)
        where = np.cumsum(count) - count
        for i, w in zip(ones[wide].tolist(), which[wide].tolist()):
            flat[where[i] : where[i] + count[i]] = single[w]
        raw = flat.astype("<u4").tobytes()
        where = np.append(where, len(flat)) * 4
        first = where[np.searchsorted(at, begins)].tolist()
        last = where[np.searchsorted(at, ends)].tolist()
        got = [raw[a:b] for a, b in zip(first, last)]
    return got


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    p, cache = load(path), _caches.setdefault(path, {})
    out: list[bytes] = []
    i = 0
    while i < len(texts):
        new: dict[str, bytes] = {}
        held: list[tuple[list[str], list, list[int]]] = []
        size = 0
        if len(cache) > CACHE:
            # What came first is mostly what is common; the rest makes room.
            kept = dict(islice(cache.items(), CACHE // 2))
            cache.clear()
            cache.update(kept)
        while i < len(texts) and size < TEXT:
            marked = MARK + texts[i].replace(" ", MARK) if texts[i] else ""
            chunks = [marked] if p.whole and marked else CHUNK.findall(marked)
            got = list(map(cache.get, chunks))
            missed = [k for k, ids in enumerate(got) if ids is None] if None in got else []
            for k in missed:
                if chunks[k] not in new:
                    new[chunks[k]] = b""
                    size += len(chunks[k]) + 1
            held.append((chunks, got, missed))
            i += 1
        fresh = list(new)
        new = dict(zip(fresh, encode_chunks(fresh, p))) if fresh else {}
        for chunks, got, missed in held:
            for k in missed:
                got[k] = new[chunks[k]]
            out.append(b"".join(got))
        cache.update(new)
        for c in new:
            if len(c) > LONG:
                del cache[c]
    return out


def decode_ids(ids: bytes | np.ndarray, p: Pieces) -> str:
    """Text of ids, given as numbers or as little-endian unsigned 32-bit bytes."""
    numbers = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids)
    raw = b"".join(map(p.raw.__getitem__, numbers.tolist()))
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _id_array(got: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                got = encode_texts([t or "" for t in batch.column(1).slice(i, ROWS).to_pylist()], path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(got)), _id_array(got)], names=["doc_id", "ids"])

    return C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for every row of doc_id and ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                ids = batch.column(1).slice(i, ROWS).fill_null([])
                cuts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                texts = [decode_ids(flat[a:b], p) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, ROWS), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def transcode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers, as bytes) and decoded (the text those ids stand for), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                got = encode_texts([t or "" for t in batch.column(1).slice(i, ROWS).to_pylist()], path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(got)), pa.array(got, pa.binary()), pa.array([decode_ids(g, p) for g in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
