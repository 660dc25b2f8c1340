"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of +1/-1 bits. For every bit a binary classifier over hashed byte
pairs and triples says on which side a text lies: its weight for an n-gram is the log-odds of the
n-gram between the languages whose bit is +1 and those whose bit is -1, its output the mean weight
over the text, centred and scaled so that training languages lie near +-2. A text goes to the
codeword of least loss, log(1 + exp(-bit * output)) weighted by how well each bit separates its two
sides in training. Texts whose two best codewords are nearly as far are flagged as ambiguous.

Training counts come from a bounded sample: `per_lang` texts of each language in expectation, chosen by a hash of each row,
and the `MOST_LANGS` commonest languages (as common ones: those that
sort first), so that what the driver sums has a bound. Languages beyond are not learned. Prediction reads every whole text.

Defined cases: null text or no letter gives `und`, score 0, not ambiguous. With one known language
every text with a letter gets it with score 1; with none all texts get `und`. Rows with a null id
count as id '' in the held-out rule. Equal codeword losses go to the language that sorts first. Repeated rows are
learned as often as they are chosen, and predicted alike. Very long texts are read whole. An empty table gives no rows.
Other columns play no part. Ids must be whole numbers or null; a text id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

BITS = 15
MOST_LANGS = 200
SLICE = 1 << 20
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean"


def codewords(k: int) -> np.ndarray:
    """k codewords as rows of +1/-1: every split of the languages up to five, else random splits far apart."""
    if k < 2:
        return np.ones((k, 0), np.float32)
    if k <= 5:
        splits = [[1 if i == 0 or not s >> (i - 1) & 1 else -1 for i in range(k)] for s in range(1, 1 << (k - 1))]
        return np.array(splits, np.float32).T.copy()
    width = int(np.ceil(5 * np.log2(k))) + 3
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200 if k <= 40 else 40):
        code = np.where(rng.random((k, width)) < 0.5, 1, -1)
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        apart = (width - code @ code.T) // 2
        least = int(apart[np.triu_indices(k, 1)].min())
        if least > far:
            best, far = code, least
    return best.astype(np.float32)


def _letters_table() -> np.ndarray:
    """Bytes to what n-grams see: lower-case ASCII letters, bytes of other scripts, and space for the rest."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


LETTERS = _letters_table()


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """N-gram hashes, segment starts and n-gram counts; the last hash value but one marks a gap between texts."""
    buf, starts = C.padded(LETTERS[data], offsets, 2, 32)
    two, three = C.gram_hashes(buf, BITS)
    two, three = two.astype(np.int64), three.astype(np.int64) + (1 << BITS)
    blank = (buf[:-2] == 32) & (buf[1:-1] == 32)  # runs of non-letters say nothing
    two[blank], three[blank] = 2 << BITS, 2 << BITS
    live = np.add.reduceat(~blank, starts).astype(np.float64) if len(starts) else np.zeros(0)
    return [two, three], starts, np.maximum(live, 1)


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # n-gram x bit, the last row zero
    centre: np.ndarray
    scale: np.ndarray
    bit_weight: np.ndarray
    min_gap: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the decoded mass, and whether the runner-up is as near."""
        n, k = len(offsets) - 1, len(self.langs)
        if k < 2:
            return np.zeros(n, np.int64), np.full(n, float(k)), np.zeros(n, bool)
        hashes, starts, live = _grams(data, offsets)
        out = C.segment_sums(hashes, starts, self.weights) / live[:, None]
        margin = np.clip((out - self.centre) * self.scale, -30, 30)
        loss = np.stack([(np.log1p(np.exp(-margin * c)) * self.bit_weight).sum(axis=1) for c in self.code], axis=1)
        order = np.sort(loss, axis=1)
        mass = np.exp(-(loss - order[:, :1]) * self.code.shape[1])
        best = loss.argmin(axis=1)
        return best, 1 / mass.sum(axis=1), order[:, 1] - order[:, 0] < self.min_gap


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = 2000, min_gap: float = 0.02) -> LanguageModel:
    """Count n-grams of a sample of each language and build the bit classifiers.

    docs holds only rows one may learn from. per_lang bounds the sampled texts of a language.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("lang is not null and text is not null")
    named = docs.select(docs[lang_col].alias("lang")).where("lang is not null").groupBy("lang").count()
    sizes = named.orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    entries = [F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_lang / r["count"]))]
    share = F.coalesce(F.try_element_at(F.create_map(*entries), F.col("lang")), F.lit(0.0)) if entries else F.lit(0.0)
    picked = C.pick(11, F.col("doc_id"), F.col("text")) < share

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(0))
            names = batch.column(1).to_pylist()
            for i, j in C.slices(offsets, SLICE):
                hashes, starts, _ = _grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = [*starts[1:].tolist(), len(hashes[0])]
                for name, a, b in zip(names[i:j], starts.tolist(), ends):
                    c = got.setdefault(name, np.zeros((2 << BITS) + 1, np.int64))
                    for h in hashes:
                        c += np.bincount(h[a:b], minlength=len(c))
        yield pa.RecordBatch.from_pydict({"lang": list(got), "counts": [c.tobytes() for c in got.values()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    # The sample has a bound, so a fixed number of tasks and of count vectors is enough at any size.
    sample = rows.where(picked).select("text", "lang").repartition(12)
    total: dict[str, np.ndarray] = {}
    for lang, counts in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        c = np.frombuffer(counts, np.int64).astype(np.float64)
        total[lang] = total[lang] + c if lang in total else c
    langs = sorted(total)
    code = codewords(len(langs))
    seen = np.array([total[x] for x in langs]).reshape(len(langs), (2 << BITS) + 1)
    seen[:, -1] = 0
    half = 1 << BITS
    p = np.concatenate([(seen[:, s : s + half] + 0.5) / (seen[:, s : s + half].sum(axis=1, keepdims=True) + 0.5 * half) for s in (0, half)], axis=1) if langs else np.zeros((0, 2 * half))
    w = np.zeros((2 * half + 1, code.shape[1]))
    for b in range(code.shape[1]):
        w[:-1, b] = np.log(p[code[:, b] > 0].mean(axis=0)) - np.log(p[code[:, b] < 0].mean(axis=0))
    mean = p @ w[:-1]  # expected output for each language; an n-gram of each order per place
    up = np.array([mean[code[:, b] > 0, b].min() for b in range(code.shape[1])])
    down = np.array([mean[code[:, b] < 0, b].max() for b in range(code.shape[1])])
    gap = np.maximum(up - down, 1e-6)
    return LanguageModel(langs, code, w.astype(np.float32), (up + down) / 2, 4 / gap, gap / gap.sum() if len(gap) else gap, min_gap)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            for i, j in C.slices(offsets, SLICE):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                best, score, near = m.predict(part, cuts)
                named = has_letter(part, cuts) & bool(m.langs)
                names = [m.langs[b] if ok else "und" for b, ok in zip(best, named)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.where(named, score, 0.0)), pa.array(near & named)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = C.id_and_text(docs, id_col, text_col)
    return rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, SCHEMA)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a Unicode letter; only texts without an ASCII letter are decoded."""
    lower = data | 32
    ascii_letter = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.nonzero(~out & (offsets[1:] > offsets[:-1]))[0]:
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is `und` or ambiguous; all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        m: LanguageModel = shared.value
        return has_letter(data, offsets) & bool(m.langs) & ~m.predict(data, offsets)[2]

    return C.filtered(docs, text_col, keep, SLICE)
