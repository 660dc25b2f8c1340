"""Token counts by a map-side two-tier lookup.

A text's tokens are counted pre-token by pre-token, where a pre-token is a run between ASCII white
space. That is exact for tokenizers whose pre-tokenization never joins text across white space and
drops the white space itself, which `TokenCounter` checks from the tokenizer's file. Tier one is a
compact table of the lengths of frequent pre-tokens, broadcast to all tasks (at most `table_size`
entries); tier two is a bounded cache in each worker, filled by encoding misses with the library, a
batch's misses at a time. Each distinct pre-token of a batch is looked up once. Pre-tokens are never shuffled.

The table comes from about `sample_docs` documents, chosen by a hash of each row. It
changes speed only: a pre-token that it lacks is encoded, so counts never depend on the sample.

Defined cases: null and empty texts have no tokens. A special token's string inside a text is what the
library makes of it by default. Very long texts are counted whole. Repeated rows are counted alike. An empty table gives
no rows. Other columns play no part. Ids must be whole numbers or null; a text id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

CACHE = 400_000  # entries of a worker's cache; it starts anew when full
SLICE = 1 << 22  # bytes of text handled at once
JOINED = 256  # pre-tokens that are encoded as one string
_encoders: dict[str, object] = {}
_caches: dict[str, dict[bytes, int]] = {}


def load(path: str):
    """The tokenizer of a .json file, once for each worker process."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _encoders[path] = tok
    return _encoders[path]


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer drops white space between pre-tokens, so that runs between it count alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"]) or any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
        return False  # an added token could reach across white space
    steps = [spec.get("normalizer") or {}]
    while steps:
        step = steps.pop()
        steps += step.get("normalizers", [])
        # Normalizers that act on characters, or turn white space into one space, leave words apart.
        plain = step.get("type") in (None, "Sequence", "NFC", "NFD", "NFKC", "NFKD", "Lowercase") or step.get("type") == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " "
        if not plain:
            return False
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    return any(p.get("type") == "Whitespace" or p.get("type") == "WhitespaceSplit" or p.get("type") == "Split" and p.get("behavior") == "Removed" for p in pre)


def encode_lengths(path: str, parts: list[bytes]) -> list[int]:
    """Token counts of pre-tokens. Those without a tilde are encoded in joined runs, a lone tilde, which is one token, between them."""
    tok = load(path)
    count = lambda texts: tok.encode_batch_fast(texts, add_special_tokens=False)
    tilde = count(["~"])[0].ids
    joins = [i for i, p in enumerate(parts) if len(p) <= 256 and b"~" not in p] if len(tilde) == 1 else []
    out = [-1] * len(parts)
    runs = [joins[i : i + JOINED] for i in range(0, len(joins), JOINED)]
    for run, e in zip(runs, count([b" ~ ".join([parts[i] for i in run] + [b""]).decode() for run in runs])):
        ends = np.flatnonzero(np.array(e.ids) == tilde[0])
        if len(ends) == len(run):  # an added token may take a tilde's place; then each is encoded alone
            for i, n in zip(run, np.diff(ends, prepend=-1).tolist()):
                out[i] = n - 1
    alone = [i for i, n in enumerate(out) if n < 0]
    for i, e in zip(alone, count([parts[i].decode() for i in alone])):
        out[i] = len(e)
    return out


def frequent_lengths(docs: DataFrame, path: str, text_col: str, id_col: str, table_size: int, sample_docs: int) -> dict[bytes, int]:
    """Lengths of the commonest pre-tokens of a bounded sample of documents."""
    n = docs.count()
    text = docs[text_col].cast("string")
    picked = docs.where(C.pick(8, docs[id_col], text) < sample_docs / max(n, 1)).select(text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(p for p in (text or "").encode().split() if len(p) <= 64)
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in top], pa.binary()), "n": pa.array([c for _, c in top], pa.int64())})

    total: Counter[bytes] = Counter()
    # The sample has a bound, so a few tasks are enough at any size.
    for part, c in picked.repartition(8).mapInArrow(count, "part binary, n long").collect():
        total[bytes(part)] += c
    parts = [p for p, c in total.most_common(table_size) if c > 1]
    return dict(zip(parts, encode_lengths(path, parts)))


def _lengths(parts: list[bytes], first: dict[bytes, int], second: dict[bytes, int], path: str) -> np.ndarray:
    """Token counts of distinct pre-tokens: from the broadcast table, else the worker's cache, else by encoding them, all at once."""
    got = list(map(first.get, parts))
    missed = [i for i, n in enumerate(got) if n is None]
    for i in missed:
        got[i] = second.get(parts[i])
    new = [i for i in missed if got[i] is None]
    for i, n in zip(new, encode_lengths(path, [parts[i] for i in new])):
        got[i] = n
    if len(second) + len(new) > CACHE:
        second.clear()
    # Very long pre-tokens are counted but not kept.
    second.update((parts[i], got[i]) for i in new if len(parts[i]) <= 256)
    return np.array(got, np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", table_size: int = 32768, sample_docs: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row."""
    if not splits_at_space(path):
        raise ValueError(f"{path}: this tokenizer's pre-tokens may hold white space")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col, id_col, table_size, sample_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = table.value, _caches.setdefault(path, {})
        for batch in batches:
            _, offsets = C.text_bytes(batch.column(1))
            for i, j in C.slices(offsets, SLICE):
                words, n = C.words_of(batch.column(1).slice(i, j - i))
                lengths = _lengths(words.dictionary.to_pylist(), first, second, path)[words.indices.to_numpy()]
                ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(n))]
                out = np.diff(ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(out), pa.array(out > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
