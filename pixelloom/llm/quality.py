"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Twelve labellers, of two families (clutter and repetition), each look at one statistic of a text and vote good, bad or abstain. They overlap on purpose: text that
shouts, say, has too many capitals, too many marks, doubled marks and words that end in marks. Over all texts the vote
patterns are counted (at most 3**12 of them, whatever the input), and begun from the shares of the votes, estimates how each labeller votes on good, cluttered and repetitive texts, and the
shares of these. So a labeller that errs alone loses its weight, and no vote decides by itself. A pattern's
posterior is the training label of a text: a logistic scorer over hashed byte pairs and triples, and hashed bins of the
statistics, is fitted on a bounded sample of texts, at most `per_class` of each side, and then scores every whole text.

The statistics' limits are customary ones for web text, not fitted to labels.

Defined cases: null and empty texts score 0 and are rejected. If the sample holds one side only, the score is the
posterior. Equal texts get equal scores, and repeated rows count as often as they occur. A score equal to the threshold is
kept. Very long texts are read whole. An empty table gives no rows. Other columns play no part. Ids must be whole numbers
or null; a text id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

BITS = 11
SLICE = 1 << 20
DAMP = 200  # n-grams added to a text's count, so that short texts lean on their statistics
BINS = 16
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Name, family (0 clutter, 1 repetition), the statistic's least value that is bad (or most, if below the good one), the limit of good ones, and words needed for a vote.
LABELLERS = (
    ("symbols", 0, 0.05, 0.01, 5),  # of the bytes that are not white space, those like # or |
    ("marks", 0, 0.15, 0.10, 5),  # of the bytes that are not white space, all ASCII marks
    ("letters", 0, 0.75, 0.85, 5),  # of the bytes that are not white space, letters
    ("capitals", 0, 0.30, 0.15, 5),  # of the ASCII letters
    ("doubled", 0, 0.02, 0.005, 5),  # of the bytes that are not white space, marks that follow the same mark
    ("wordless", 0, 0.20, 0.05, 5),  # of the words, those without a letter
    ("ends", 0, 0.40, 0.25, 5),  # of the words, those that end in a mark
    ("echoes", 1, 0.10, 0.03, 10),  # of the words, those equal to the word before
    ("top word", 1, 0.20, 0.12, 20),  # of the words, the commonest
    ("packed", 1, 0.25, 0.33, 30),  # compressed size
    ("entropy", 1, 3.4, 3.7, 20),  # bits a byte, ASCII letters folded
    ("lines", 1, 0.50, 0.80, 5),  # of the lines, distinct ones
)
NAMES, FAMILY = tuple(x[0] for x in LABELLERS), np.array([x[1] for x in LABELLERS])
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = b"#$%&*@^~<>{}[]\\=+_|"


def _byte_classes() -> np.ndarray:
    """Byte x class: symbols, marks, letters of any script, ASCII capitals, ASCII letters, white space, line ends."""
    t = np.zeros((256, 7), np.int64)
    upper, lower = range(65, 91), range(97, 123)
    for c, chars in enumerate((SYMBOLS, MARKS, [*upper, *lower, *range(128, 256)], upper, [*upper, *lower], b" \t\n\r\x0b\x0c", b"\n")):
        t[list(chars), c] = 1
    return t


CLASSES = _byte_classes()
IS_MARK, IS_LETTER, IS_SPACE = (CLASSES[:, c].astype(bool) for c in (1, 2, 5))
FOLD = np.arange(256)
FOLD[65:91] += 32


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text x labeller: each one's statistic; and how many words each text has."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(LABELLERS)))
    if not len(data):
        return out, np.zeros(n, np.int64)
    space, mark = IS_SPACE[data], IS_MARK[data]
    text = np.repeat(np.arange(n), size)
    counts, entropy = np.zeros((n, 7)), np.zeros(n)
    for i in range(0, n, 1024):
        j = min(n, i + 1024)
        seen = np.bincount((text[offsets[i] : offsets[j]] - i) * 256 + data[offsets[i] : offsets[j]], minlength=(j - i) * 256).reshape(j - i, 256)
        counts[i:j] = seen @ CLASSES
        folded = np.zeros_like(seen)
        np.add.at(folded.T, FOLD, seen.T)
        p = folded / np.maximum(size[i:j], 1)[:, None]
        entropy[i:j] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    symbols, marks, letters, capitals, ascii_letters, spaces, ends = counts.T
    solid = np.maximum(size - spaces, 1)
    first = offsets[:-1][size > 0]  # a text begins here, so what lies before is another's
    begins, doubled = ~space, np.zeros(len(data), bool)
    begins[1:] &= space[:-1]
    begins[first] = ~space[first]
    doubled[1:] = mark[1:] & (data[1:] == data[:-1])
    doubled[first] = False
    begins = np.flatnonzero(begins)
    of = text[begins]
    words = np.bincount(of, minlength=n)
    some = np.maximum(words, 1)
    closing = ~space
    closing[:-1] &= space[1:]
    last = offsets[1:][size > 0] - 1
    closing[last] = ~space[last]
    per_word = lambda what: np.bincount(of[what], minlength=n) / some
    wordless = np.maximum.reduceat(IS_LETTER[data], begins) == 0 if len(begins) else np.zeros(0, bool)
    code = C.word_codes(data, offsets)
    echo = np.zeros(len(code), bool)
    echo[1:] = (code[1:] == code[:-1]) & (of[1:] == of[:-1])
    pairs, times = np.unique(of * (int(code.max(initial=0)) + 1) + code, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, pairs // (int(code.max(initial=0)) + 1), times)
    raw, at = data.tobytes(), offsets.tolist()
    packed_size, lines = np.ones(n), np.ones(n)
    for i in range(n):
        part = raw[at[i] : at[i + 1]]
        if words[i] >= LABELLERS[9][4]:
            packed_size[i] = len(zlib.compress(part, 1)) / len(part)
        if ends[i] >= 4:
            parts = [p for p in part.split(b"\n") if p]
            lines[i] = len(set(parts)) / max(len(parts), 1)
    columns = (symbols / solid, marks / solid, letters / solid, capitals / np.maximum(ascii_letters, 1), np.bincount(text[doubled], minlength=n) / solid, per_word(wordless), per_word(mark[np.flatnonzero(closing)]), per_word(echo), top / some, packed_size, entropy, lines)
    for k, column in enumerate(columns):
        out[:, k] = column
    return out, words


def votes_of(stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Text x labeller: what each statistic says, where the text has the words that it needs."""
    out = np.zeros(stats.shape, np.int64)
    for k, (_, _, bad, good, least) in enumerate(LABELLERS):
        x, sign = stats[:, k], 1 if bad > good else -1
        out[:, k] = np.where(words < least, ABSTAIN, np.where(sign * x >= sign * bad, BAD, np.where(sign * x <= sign * good, GOOD, ABSTAIN)))
    return out


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text x labeller."""
    return votes_of(*statistics(data, offsets))


def packed(v: np.ndarray) -> np.ndarray:
    """A vote row as one number in base 3."""
    return v @ (3 ** np.arange(v.shape[1]))


def unpacked(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """Three kinds of text: cluttered, repetitive and good. The bad kinds differ, since few texts are bad in both ways."""

    share: np.ndarray  # of each kind
    rates: np.ndarray  # labeller x kind x vote (bad, good): how often it votes so when it votes

    def kinds(self, v: np.ndarray) -> np.ndarray:
        """Chance of each kind for texts with these votes; who abstains says nothing."""
        logs = np.log(self.share) + (v == BAD) @ np.log(self.rates[:, :, 0]) + (v == GOOD) @ np.log(self.rates[:, :, 1])
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that texts with these votes are good."""
        return self.kinds(v)[:, -1]

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes: bad on the bad kind it looks for, and good on good texts."""
        own = np.array([FAMILY == 0, FAMILY == 1, np.ones(len(NAMES), bool)]).T * self.share
        right = (own[:, :2] * self.rates[:, :2, 0]).sum(axis=1) + own[:, 2] * self.rates[:, 2, 1]
        return dict(zip(NAMES, (right / own.sum(axis=1)).tolist()))


def estimate(v: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns, begun from the shares of good votes and of each family's bad votes."""
    cast = np.stack([v == BAD, v == GOOD], axis=2).astype(np.float64)
    begin = np.stack([cast[:, FAMILY == 0, 0].sum(axis=1), cast[:, FAMILY == 1, 0].sum(axis=1), cast[:, :, 1].sum(axis=1)], axis=1) + np.array([0.25, 0.25, 1])
    p = begin / begin.sum(axis=1, keepdims=True)
    total = max(counts.sum(), 1)
    model = LabelModel(np.full(3, 1 / 3), np.full((v.shape[1], 3, 2), 1 / 2))
    for _ in range(rounds):
        mass = counts[:, None] * p
        rates = np.einsum("nc,nkv->kcv", mass, cast) + 0.5
        model = LabelModel(np.clip(mass.sum(axis=0) / total, 1e-3, 1), rates / rates.sum(axis=2, keepdims=True))
        new = model.kinds(v)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return model


def _edges() -> np.ndarray:
    """Labeller x edge: bins of a statistic, even between nothing and twice its larger limit."""
    return np.array([np.linspace(0, 2 * max(bad, good), BINS + 1)[1:-1] for _, _, bad, good, _ in LABELLERS])


EDGES = _edges()
WIDTH = (2 << BITS) + len(LABELLERS) * BINS


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray | None  # of n-grams, then of bins
    bias: float
    threshold: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes, posteriors and scores."""
        stats, words = statistics(data, offsets)
        v = votes_of(stats, words)
        post = self.labels.posterior(v)
        if self.weights is None:
            score = post.copy()
        else:
            hashes, starts, n = _grams(data, offsets)
            grams = C.segment_sums(hashes, starts, self.weights[: 2 << BITS, None])[:, 0] / n
            binned = np.where(v == ABSTAIN, 0, self.weights[_bins(stats)]).sum(axis=1)
            score = 1 / (1 + np.exp(-np.clip(grams + binned + self.bias, -50, 50)))
        empty = np.diff(offsets) == 0
        score[empty], post[empty] = 0, 0
        return v, post, score


def _bins(stats: np.ndarray) -> np.ndarray:
    """Text x labeller: the feature of the bin that each statistic lies in."""
    return np.stack([(2 << BITS) + k * BINS + np.searchsorted(EDGES[k], stats[:, k], "right") for k in range(len(LABELLERS))], axis=1)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    buf, starts = C.padded(data, offsets, 2, 10)
    two, three = C.gram_hashes(buf, BITS)
    n = np.diff(np.append(starts, len(two))).astype(np.float64)
    return [two.astype(np.int64), three.astype(np.int64) + (1 << BITS)], starts, n + DAMP


def _features(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray, v: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row x feature of some of the texts: mean n-gram counts, and a one for each labeller's bin where it votes."""
    hashes, starts, n = _grams(data, offsets)
    ends = np.append(starts[1:], len(hashes[0]))
    x = np.zeros((len(rows), WIDTH), np.float32)
    bins = _bins(stats)
    for row, d in enumerate(rows):
        x[row, : 2 << BITS] = sum(np.bincount(h[starts[d] : ends[d]], minlength=2 << BITS) for h in hashes) / n[d]
        x[row, bins[d][v[d] != ABSTAIN]] = 1
    return x


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 600, gram_decay: float = 1e-2, bin_decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; both sides weigh the same. Returns weights for x as given."""
    # The floor, and the stronger decay of n-gram weights, keep n-grams that a text which repeats itself holds in excess from outweighing bins.
    scale = np.maximum(np.sqrt((x * x).mean(axis=0)), 0.01).astype(np.float32)
    scale[2 << BITS :] = 1
    x /= scale
    side = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    decay = np.where(np.arange(x.shape[1]) < 2 << BITS, gram_decay, bin_decay)
    m, s = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        d = (p - y) * side
        g = np.append(x.T @ d.astype(np.float32) + decay * w, d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w / scale, float(b)


def tally(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The vote patterns of all texts that aren't empty, and how many texts have each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(0))
            for i, j in C.slices(offsets, SLICE):
                seen.update(packed(votes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])).tolist())
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    texts = docs.select(docs[text_col].cast("string").alias("text")).where("text is not null and text <> ''")
    got = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow().sort_by("pattern")  # at most 3**12 rows
    return unpacked(got.column("pattern").to_numpy()), got.column("n").to_numpy().astype(np.float64)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1000, threshold: float = 0.5) -> QualityModel:
    """The label model from all texts' votes, and the scorer from a bounded sample labelled by it.

    The sample is chosen by a hash of each row. A task passes on at most `per_class` texts of each side, and one task keeps
    the first `per_class` of them by hash.
    """
    spark = docs.sparkSession
    v, counts = tally(docs, text_col)
    labels = estimate(v, counts)
    post = labels.posterior(v)
    share = {side: min(1.0, per_class / max(counts[(post > 0.5) == side].sum(), 1)) for side in (True, False)}
    at = spark.sparkContext.broadcast((labels, share))
    text = docs[text_col].cast("string")
    texts = docs.select(text.alias("text"), C.pick(21, docs[id_col], text).alias("pick")).where("text is not null and text <> ''")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares = at.value
        room = {True: per_class, False: per_class}
        for batch in batches:
            batch = batch.filter(pa.array(batch.column(1).to_numpy() < max(shares.values())))
            data, offsets = C.text_bytes(batch.column(0))
            pick = batch.column(1).to_numpy()
            for i, j in C.slices(offsets, SLICE):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                stats, words = statistics(part, cuts)
                v = votes_of(stats, words)
                y = model.posterior(v)
                taken = np.nonzero(pick[i:j] < np.where(y > 0.5, shares[True], shares[False]))[0]
                kept = []
                for d in taken.tolist():
                    side = bool(y[d] > 0.5)
                    if room[side] > 0:
                        room[side] -= 1
                        kept.append(d)
                if kept:
                    x = [row.tobytes() for row in _features(part, cuts, stats, v, np.array(kept))]
                    yield pa.RecordBatch.from_arrays([pa.array(pick[i:j][kept]), pa.array(y[kept]), pa.array(x, pa.binary())], names=["pick", "y", "x"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {True: [], False: []}
        for batch in batches:
            for pick, y, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held[y > 0.5].append((pick, y, x))
            for rows in held.values():
                rows.sort()
                del rows[per_class:]
        for rows in held.values():
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.binary()))], names=["pick", "y", "x"])

    schema = "pick double, y double, x binary"
    rows = texts.mapInArrow(sample, schema).repartition(1).mapInArrow(first, schema).toArrow()  # at most 2 * per_class rows
    y = rows.column("y").to_numpy()
    if not len(y) or (y > 0.5).all() or (y <= 0.5).all():
        return QualityModel(labels, None, 0.0, threshold)
    x = np.stack([np.frombuffer(r.as_py(), np.float32) for r in rows.column("x")])
    del rows
    w, b = _train(x, y)
    # Both sides weighed the same; the corpus holds them in other shares.
    sides = counts @ np.stack([post, 1 - post], axis=1) + 1
    return QualityModel(labels, w.astype(np.float32), b + float(np.log(sides[0] / sides[1])), threshold)


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), posterior of its votes, the votes (one letter each: g, b or -) and keep, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: QualityModel = shared.value
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            for i, j in C.slices(offsets, SLICE):
                v, post, score = m.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                said = ["".join("-bg"[x] for x in row) for row in v]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array(post), pa.array(said, pa.string()), pa.array(score >= m.threshold)], names=["doc_id", "score", "posterior", "votes", "keep"])

    rows = C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, posterior double, votes string, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that `classify` rejects; all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return C.filtered(docs, text_col, lambda data, offsets: shared.value.score(data, offsets)[2] >= shared.value.threshold, SLICE)
