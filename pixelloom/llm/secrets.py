"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Base spans come from three patterns (assign, access, hex). The method adds spans of kind
`entropy`: candidate strings are runs of token characters; for each character class a window
slides over the run's stretches of that class, its symbol counts updated by one step in and one
step out, and windows whose Shannon entropy reaches the class's threshold are joined into spans.
Runs on the allow-list, and stretches that look like plain words, are suppressed.

Defined cases: null text counts as empty. Offsets are in code points, ends exclusive. A base span
always stays; an entropy span that a base span covers is not repeated. Spans sort by start, then kind
in the order assign, access, hex, entropy, then end. Very long texts are read whole. Repeated rows are scanned alike. An
empty table gives no rows. Other columns play no part, and stay where texts are redacted. Ids must be whole numbers or null; a
text id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

#: The base patterns, by kind.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this equals all runs less the short ones
CUE = re.compile(r"(?:passw|secret|token|api_?key)", re.ASCII | re.IGNORECASE)
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings, and for each character class its characters, window and least entropy in bits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 20, 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.9),
)
#: Allow-list: identifiers that look random but are public, and runs of letters only (long words).
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/=+]*"),
    re.compile(r"[0-9]+(?:[-_/=+][0-9]+)*"),
)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if CUE.search(text):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def entropy_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Stretches of `run` covered by windows of at least `least` bits of entropy a character.

    sum(c * log2 c) over the window's symbol counts is kept up to date as one symbol enters and one leaves.
    """
    if len(run) < window:
        return []
    weight = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    most = window * (math.log2(window) - least)  # entropy >= least exactly when the sum is at most this
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, ch in enumerate(run):
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += weight[c - 1] - weight[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        if i >= window - 1 and total <= most + 1e-9:
            start, end = i - window + 1, i + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def entropy_spans(text: str, allowed: Sequence[re.Pattern] = ALLOWED) -> list[Span]:
    out: set[tuple[int, int]] = set()
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(a.fullmatch(run) for a in allowed):
            continue
        for _, chars, window, least in CLASSES:
            for part in chars.finditer(run):
                if part.end() - part.start() < window or any(a.fullmatch(part[0]) for a in allowed):
                    continue
                at = m.start() + part.start()
                out |= {(at + a, at + b) for a, b in entropy_windows(part[0], window, least)}
    joined: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return [(a, b, "entropy") for a, b in joined]


def all_spans(text: str, allowed: Sequence[re.Pattern] = ALLOWED) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and entropy spans together."""
    base = base_spans(text)
    starts, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))  # base spans come by start
    covered = lambda s: (n := bisect_right(starts, s[0])) > 0 and reach[n - 1] >= s[1]
    extra = [s for s in entropy_spans(text, allowed) if not covered(s)]
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans: list[Span], mark: str) -> str:
    """text with every stretch of overlapping spans replaced by mark."""
    out, done = [], 0
    for a, b, _ in spans:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mark]
        done = b
    return "".join(out) + text[done:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans and base_spans: arrays of struct<kind, start, end>."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column(1).to_pylist():
                b, e = all_spans(text or "")
                for to, spans in ((base, b), (every, e)):
                    to.append([{"kind": k, "start": x, "end": y} for x, y, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span)], names=["doc_id", "base_spans", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(find, f"doc_id long, base_spans {kind}, spans {kind}")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of the text replaced by mark; null texts stay null, other columns as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else masked(t, all_spans(t)[1], mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
