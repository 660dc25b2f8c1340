"""Token ids of byte-level BPE tokenizers for whole batches of text.

A batch's bytes are cut where no pre-token of the tokenizer's pattern can cross, Arrow's dictionary encoding finds
the distinct cuts, each distinct cut is looked up in the worker's cache or encoded by the library, and the ids of
the whole batch are gathered in one step. Texts that hold an added token's string are encoded whole.
"""

from __future__ import annotations

import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa

from pixelloom.llm import _common as C
from pixelloom.llm.tokencount import load

CACHE = 450_000  # cuts that a worker keeps; when full, the later half goes, since what came first is mostly what is common
LONG = 256  # bytes; longer cuts are not kept
JOINED = 256  # cuts that the library gets as one string
SPACE, OTHER_SPACE, WORD, MARK, QUOTE, HIGH, MAYBE = range(1, 8)

#: Cuts that the library may get back to back: at most a space, then bytes that can't be white space of any kind.
SAFE = re.compile(rb" ?[^\x09-\x0d \xc2\xe1\xe2\xe3]+")


def _byte_kinds() -> np.ndarray:
    t = np.full(256, MARK, np.uint8)
    t[32], t[9:14], t[39], t[128:] = SPACE, OTHER_SPACE, QUOTE, HIGH
    for a, b in ((48, 58), (65, 91), (97, 123)):
        t[a:b] = WORD
    t[[0xC2, 0xE1, 0xE2, 0xE3]] = MAYBE  # white space beyond ASCII begins with these
    return t


KINDS = _byte_kinds()


def _cut_table() -> np.ndarray:
    """By kinds of the byte before, the byte and the byte after: whether a pre-token surely begins at the byte."""
    t = np.zeros((8, 8, 8), bool)
    # A space before what isn't white space begins a pre-token, and so does white space after what isn't.
    t[:, SPACE, [WORD, MARK, QUOTE, HIGH]] = True
    for before in (WORD, MARK, QUOTE):
        t[before, SPACE, :] = True
    t[WORD, MARK, :] = True  # letters and digits never join punctuation, save after an apostrophe
    return t.ravel()


CUTS = _cut_table()


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where cuts begin, for texts back to back; every text that isn't empty begins one."""
    kind = KINDS[data]
    starts = offsets[:-1][np.diff(offsets) > 0]
    if not len(data):
        return starts
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[-1] = 0
    after[offsets[1:][offsets[1:] > 0] - 1] = 0  # beyond the text
    code = kind.astype(np.uint16)
    code <<= 3
    code |= after
    code[1:] |= kind[:-1].astype(np.uint16) << 6
    found = CUTS[code]
    # After a lone line end or tab between bytes that aren't white space.
    ends = np.flatnonzero(kind == OTHER_SPACE)
    ends = ends[(ends > 0) & (ends < len(kind) - 1)]
    solid = np.isin(np.arange(8), (WORD, MARK, QUOTE))
    found[ends[solid[kind[ends - 1]] & (solid | (np.arange(8) == HIGH))[kind[ends + 1]]] + 1] = True
    found[starts] = True
    return np.flatnonzero(found)


class Encoder:
    """The tokenizer of a file, and a worker's cache of cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.tok = load(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)  # a byte-level name has one character for each byte
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.index: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _joined(self, parts: list[bytes], lead: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of cuts that the library gets back to back, `lead` (a pre-token and token of its own) before each."""
        texts = [(lead + lead.join(parts[i : i + JOINED])).decode() for i in range(0, len(parts), JOINED)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.cumsum(self.width[ids])
        sizes = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + len(lead))
        cuts = np.searchsorted(ends, sizes) + 1
        if len(parts) and (ends[cuts - 1] != sizes).any():
            raise ValueError("tokens cross white space")
        counts = np.diff(cuts, prepend=0)
        if lead:
            ids = np.delete(ids, cuts - counts)
            counts -= 1
        return ids, counts

    def _encoded(self, parts: list[bytes], whole: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The cuts, ordered so that those to be kept come first, their ids back to back, and id counts."""
        safe = [len(p) <= LONG and SAFE.fullmatch(p) is not None and not (whole and any(a in p for a in self.added)) for p in parts]
        spaced = [p for p, s in zip(parts, safe) if s and p[0] == 32]
        bare = [p for p, s in zip(parts, safe) if s and p[0] != 32]
        alone = sorted((p for p, s in zip(parts, safe) if not s), key=lambda p: len(p) > LONG)
        got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False)]
        ids, counts = zip(self._joined(spaced, b""), self._joined(bare, b"\n"))
        return spaced + bare + alone, np.concatenate([*ids, *got]), np.concatenate([*counts, np.fromiter(map(len, got), np.int64, len(got))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts back to back, and how many each text has."""
        raw = data.tobytes()
        places = cut_places(data, offsets)
        whole = any(a in raw for a in self.added)
        if whole:
            held = np.array([any(a in raw[i:j] for a in self.added) for i, j in zip(offsets.tolist(), offsets[1:].tolist())], bool)
            text = np.searchsorted(offsets, places, "right") - 1
            places = places[~held[text] | (places == offsets[text])]
        cuts = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(np.append(places, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
        cuts = cuts.dictionary_encode()
        parts = cuts.dictionary.to_pylist()
        entry = np.array([-1 if i is None else i for i in map(self.index.get, parts)], np.int64)
        missed = np.flatnonzero(entry < 0)
        flat, ends = self.flat, self.ends
        if len(missed):
            order, ids, counts = self._encoded([parts[i] for i in missed.tolist()], whole)
            flat, ends = np.concatenate([flat, ids]), np.concatenate([ends, ends[-1] + np.cumsum(counts)])
            at = dict(zip(order, range(len(self.index), len(self.index) + len(order))))
            entry[missed] = np.fromiter((at[parts[i]] for i in missed.tolist()), np.int64, len(missed))
            self._keep(order, at, flat, ends)
        entry = entry[cuts.indices.to_numpy()]
        first, counts = ends[entry], ends[entry + 1] - ends[entry]
        after = np.cumsum(counts)
        out = flat[np.repeat(first - after + counts, counts) + np.arange(after[-1] if len(after) else 0)]
        after = np.append(0, after)
        return out, np.diff(after[np.searchsorted(places, offsets)])

    def _keep(self, order: list[bytes], at: dict[bytes, int], flat: np.ndarray, ends: np.ndarray) -> None:
        if len(self.index) + len(order) > CACHE:
            kept = dict(islice(self.index.items(), CACHE // 2))
            self.index, self.flat, self.ends = kept, flat[: ends[len(kept)]].copy(), ends[: len(kept) + 1].copy()
            return
        while order and len(order[-1]) > LONG:
            order.pop()
        self.index.update((p, at[p]) for p in order)
        n = len(self.index)
        self.flat, self.ends = flat[: ends[n]], ends[: n + 1]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a .json file, once for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(texts: list[str], path: str) -> list[list[int]]:
    """Each text's ids."""
    data, offsets = C.text_bytes(pa.array(texts, pa.string()))
    ids, counts = encoder(path).encode(data, offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
