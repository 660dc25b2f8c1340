"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network predicts each word of a text from the two words before it and the two after it: gated word vectors are
added up, tanh, then a softmax in two levels. The commonest words are outputs of the first level; the next thousands
are outputs of clusters, which the second level tells apart by the same hidden layer; each other word is reached by
its shape (length, capital, last mark, script), an output of the first level too, times its share of all words of that
shape. A document's score is the sum of the log chances of all its words, each with its own place masked.

The whole corpus takes part. All words of all documents are counted, in a table that grows with the corpus; words
beyond a broadcast table of bounded size get their share by a join. Every document trains: a round masks every
`mask`-th word of each, begun at a place given by the text's hash, and each round masks other words. Shards of about
`shard_words` words, dealt by hash, each train a copy, and the copies' mean, weighted by words and formed in a tree in a
fixed order, starts the next round. So the model depends on the rows, not on how files are split into tasks (rows whose id
is null are dealt by their place in the files). A score is a sum of whole numbers, log chances in steps of 2**-16, and
products have fixed shapes: equal texts score the same.

Defined cases: null text counts as empty; a text without words has n_words 0, log_prob 0 and mean 0. Words
are runs between ASCII white space; one as frequent as others at the tables' ends enters them by hash. Repeated rows are
counted, and scored, as often as they occur. A very long text is cut into segments that see their neighbours' words. A
corpus without words gives a uniform model, an empty table no rows. Other columns play no part. Ids must be whole
numbers or null; a text id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

SINGLES, CLUSTERS, EACH, SHAPES = 64, 64, 64, 32
OWN = SINGLES + CLUSTERS * EACH  # words with an output of their own
CODES = OWN + SHAPES
EDGE = CODES  # stands beyond a text's ends
FIRST = SINGLES + CLUSTERS + SHAPES  # outputs of the first level
HIDDEN, SIDE = 32, 2
TABLE = 1 << 18  # words in the broadcast table
FINE = 4096  # word counts up to here are told apart when the commonest words are chosen
SLICE = 1 << 22  # bytes of text handled at once
HELD = 1 << 20  # distinct words of slices that a task holds before it adds them up
SEGMENT = 1 << 15  # words
BLOCK, ROWS = 4096, 32  # words in a product of the first level, and of the second
UNIT = 1 << 16  # steps of a log chance
FAN = 16
LONG = 1024  # bytes; longer words get their key from a digest

_POWERS = np.multiply.accumulate(np.full(LONG + 1, 0x9E3779B97F4A7C15, np.uint64))
_OPEN, _SHUT = np.zeros(256, bool), np.ones(256, bool)
_OPEN[65:91] = True  # capitals
_SHUT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False  # marks


def keys_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit key, the last 7 bytes as a number, and the shape of each word; words must not be empty."""
    data, offsets = C.text_bytes(words)
    size, start, end = np.diff(offsets), offsets[:-1], offsets[1:]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.arange(len(data)) - np.repeat(start, size), LONG)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[place], start)
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    tail = np.zeros(len(size), np.int64)
    for k in range(7):
        tail |= np.where(size > k, data[np.maximum(end - 1 - k, 0)].astype(np.int64) << (8 * (6 - k)), 0)
    high = np.maximum.reduceat(data, start) > 127
    shape = high * 1 + _OPEN[data[start]] * 2 + _SHUT[data[end - 1]] * 4 + np.searchsorted([5, 9, 14], size, "right") * 8
    return h.view(np.int64), tail, shape.astype(np.int64)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, tail, shape and n of every word over all documents; tasks add up what they have seen before they pass it on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, look, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.diff(key[order], prepend=~key[order[0]]))
            return key[order[begin]], look[order[begin]], np.add.reduceat(n[order], begin)

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["key", "look", "n"])

        size = 0
        for batch in batches:
            _, offsets = C.text_bytes(batch.column(0))
            for i, j in C.slices(offsets, SLICE):
                words, _ = C.words_of(batch.column(0).slice(i, j - i))
                if not len(words):
                    continue
                key, tail, shape = keys_of(words.dictionary)
                held.append((key, shape << 56 | tail, np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))))
                size += len(key)
                if size > HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield passed()
                        size = 0
        if held:
            held[:] = [merged()]
            yield passed()

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(count, "key long, look long, n long")
    counts = rows.groupBy("key").agg(F.max("look").alias("look"), F.sum("n").alias("n"))
    return counts.select("key", F.col("look").bitwiseAND(F.lit((1 << 56) - 1)).alias("tail"), F.shiftright("look", 56).alias("shape"), "n")


@dataclass
class Vocabulary:
    """The commonest words' codes and log shares by key, and what each code, first output and shape weighs."""

    keys: np.ndarray  # ascending
    codes: np.ndarray
    share: np.ndarray  # log count in UNITs; 0 for words with an output of their own
    count: np.ndarray  # by code
    total: int

    @property
    def shape_cost(self) -> np.ndarray:
        """What a word's log share lacks for its shape's mass, in UNITs."""
        return np.rint(np.log(self.count[OWN:] + 1) * UNIT).astype(np.int64)


def build_vocabulary(counts: DataFrame, size: int = TABLE) -> Vocabulary:
    """The `size` commonest words at most, chosen by a histogram of counts, and by key among words as frequent as the last.

    Only the chosen words reach the driver, and no task's own list of the commonest.
    """
    n = F.col("n")
    level = F.when(n <= FINE, n).otherwise(FINE + F.floor(F.log2(n / FINE) * 16)).cast("int")  # counts, then sixteenths of powers of two
    sums = {r["shape"]: r["n"] for r in counts.groupBy("shape").agg(F.sum("n").alias("n")).collect()}  # at most SHAPES rows
    room, chosen = size, F.lit(True)
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most FINE + 16 * 52 rows
        if r["count"] > room:
            share = (room + 4 * room**0.5 + 16) / r["count"]
            chosen = (level > r["level"]) | (level == r["level"]) & (F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
            break
        room -= r["count"]
    got = counts.where(chosen).select("key", "tail", "shape", "n").toArrow()
    key, tail, shape, n = (got.column(c).to_numpy() for c in ("key", "tail", "shape", "n"))
    order = np.lexsort((key, -n))[:size]
    key, tail, shape, n = key[order], tail[order], shape[order], n[order]
    code = OWN + shape
    code[:SINGLES] = np.arange(len(key))[:SINGLES]
    alike = np.argsort(tail[SINGLES:OWN], kind="stable")  # words of one ending share a cluster
    code[SINGLES:OWN][alike] = SINGLES + np.arange(len(alike))
    count = np.bincount(code[:OWN], n[:OWN], CODES)
    for s, all_n in sums.items():
        count[OWN + s] = all_n - n[:OWN][shape[:OWN] == s].sum()
    share = np.where(code < OWN, 0, np.rint(np.log(np.maximum(n, 1)) * UNIT)).astype(np.int64)
    at = np.argsort(key)
    return Vocabulary(key[at], code[at].astype(np.uint16), share[at], count.astype(np.int64), int(sum(sums.values())))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each segment of each document: row (one number a document), doc_id, segment, n_words, base, ids and far.

    ids holds SIDE codes before the segment, its codes, and SIDE after it; base is the known part of its words' log shares
    in UNITs, and far the keys of words outside the table, whose log counts are still to be added.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, context = shared.value, TaskContext.get()
        cost = v.shape_cost
        row = (context.partitionId() if context else 0) << 32
        for batch in batches:
            _, offsets = C.text_bytes(batch.column(1))
            for i, j in C.slices(offsets, SLICE):
                words, n = C.words_of(batch.column(1).slice(i, j - i))
                key, _, shape = keys_of(words.dictionary)
                at = np.minimum(np.searchsorted(v.keys, key), max(len(v.keys) - 1, 0))
                known = v.keys[at] == key if len(v.keys) else np.zeros(len(key), bool)
                code = np.where(known, v.codes[at] if len(v.keys) else 0, OWN + shape).astype(np.uint16)
                base = np.where(known, v.share[at] if len(v.keys) else 0, 0) - np.where(code >= OWN, cost[shape], 0)
                which = words.indices.to_numpy()
                ids, base, far, key = code[which], np.append(0, np.cumsum(base[which])), ~known[which], key[which]
                ends = np.cumsum(n)
                many = np.maximum(-(-n // SEGMENT), 1)
                doc = np.repeat(np.arange(j - i), many)
                segment = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                a = (ends - n)[doc] + segment * SEGMENT
                b = np.minimum(a + SEGMENT, ends[doc])
                framed = np.full(len(ids) + 2 * SIDE * len(n), EDGE, np.uint16)  # each text between its edges
                framed[np.arange(len(ids)) + np.repeat(SIDE * (2 * np.arange(len(n)) + 1), n)] = ids
                shift = 2 * SIDE * doc
                views = [framed[x:y].astype("<u2").tobytes() for x, y in zip((a + shift).tolist(), (b + shift + 2 * SIDE).tolist())]
                far_at = np.flatnonzero(far)
                cuts = np.searchsorted(far_at, np.append(a, len(ids)))
                far_keys = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key[far_at]))
                cols = [pa.array(row + doc), batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(segment, pa.int32()), pa.array(b - a), pa.array(base[b] - base[a]), pa.array(views, pa.binary()), far_keys]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "segment", "n_words", "base", "ids", "far"])
                row += j - i

    rows = C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    return C.stored(rows.mapInArrow(run, "row long, doc_id long, segment int, n_words long, base long, ids binary, far array<long>"), "encoded")


def outputs_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code's output of the first level, and its cluster (-1: none)."""
    cluster = np.where((code >= SINGLES) & (code < OWN), (code - SINGLES) // EACH, -1)
    return np.where(code < SINGLES, code, np.where(code < OWN, SINGLES + cluster, code - OWN + SINGLES + CLUSTERS)), cluster


def chunks_of(cluster: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a cluster in chunks of `rows`: which word is where (-1: none), and each chunk's cluster."""
    member = np.flatnonzero(cluster >= 0)
    member = member[np.argsort(cluster[member].astype(np.uint8), kind="stable")]
    n = np.bincount(cluster[member], minlength=CLUSTERS)
    many = -(-n // rows)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(CLUSTERS), many)
    slot = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))[:, None] * rows + np.arange(rows)
    return np.where(slot < n[of][:, None], member[np.minimum(first[of][:, None] + slot, max(len(member) - 1, 0))] if len(member) else -1, -1), of


@dataclass
class Network:
    vectors: np.ndarray  # code x hidden
    gates: np.ndarray  # place x hidden
    bias: np.ndarray
    first: np.ndarray  # hidden x output
    first_bias: np.ndarray
    second: np.ndarray  # cluster x hidden x output
    second_bias: np.ndarray  # cluster x output

    SHAPES = ((CODES + 1, HIDDEN), (2 * SIDE, HIDDEN), (HIDDEN,), (HIDDEN, FIRST), (FIRST,), (CLUSTERS, HIDDEN, EACH), (CLUSTERS, EACH))

    @staticmethod
    def start(count: np.ndarray) -> Network:
        """Small random vectors; biases that give each word its share of the corpus."""
        rng = np.random.default_rng(5)
        normal = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
        c = count.astype(np.float64) + 1
        clusters = c[SINGLES:OWN].reshape(CLUSTERS, EACH)
        outputs = np.concatenate([c[:SINGLES], clusters.sum(axis=1), c[OWN:]])
        return Network(normal(0.3, CODES + 1, HIDDEN), normal(0.7, 2 * SIDE, HIDDEN), np.zeros(HIDDEN, np.float32), normal(0.05, HIDDEN, FIRST), np.log(outputs / outputs.sum()).astype(np.float32), normal(0.05, CLUSTERS, HIDDEN, EACH), np.log(clusters / clusters.sum(axis=1, keepdims=True)).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.gates, self.bias, self.first, self.first_bias, self.second, self.second_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @staticmethod
    def shaped(x: np.ndarray) -> Network:
        cuts = np.cumsum([int(np.prod(s)) for s in Network.SHAPES])[:-1]
        return Network(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(x, cuts), Network.SHAPES)))

    def scores(self, framed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log chance, in UNITs, of the codes of `framed` at each place of `at`, given those around it."""
        tables = self.gates[:, None, :] * self.vectors  # place x code x hidden
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), BLOCK):
            here = at[i : i + BLOCK]
            n = len(here)
            here = np.pad(here, (0, BLOCK - n), mode="edge") if n < BLOCK else here  # products of one shape round alike
            h = tables[0][framed[here - SIDE]]
            for place, step in enumerate((-1, 1, 2), start=1):
                h += tables[place][framed[here + step]]
            h += self.bias
            np.tanh(h, out=h)
            target, cluster = outputs_of(framed[here].astype(np.int64))
            logits = h @ self.first
            logits += self.first_bias
            said = logits[np.arange(BLOCK), target]
            lp = said - np.log(np.exp(logits, out=logits).sum(axis=1))  # training keeps weights so small that exp can't overflow
            member, of = chunks_of(cluster, ROWS)
            if len(of):
                logits = np.matmul(h[member], self.second[of])
                logits += self.second_bias[of][:, None, :]
                word = (framed[here].astype(np.int64)[member] - SINGLES) % EACH
                said = np.take_along_axis(logits, word[:, :, None], axis=2)[:, :, 0]
                more = said - np.log(np.exp(logits, out=logits).sum(axis=2))
                real = member >= 0
                lp[member[real]] += more[real]
            out[i : i + n] = np.rint(lp[:n].astype(np.float64) * UNIT)
        return out

    def train(self, framed: np.ndarray, at: np.ndarray, rate: float, block: int = 2048) -> None:
        """One pass of gradient steps over the places `at`; each weight's steps shrink with its gradients so far."""
        sums = [np.full(s[:1] if k in (0, 5) else s, 1e-4, np.float32) for k, s in enumerate(Network.SHAPES)]  # by row for vectors and clusters
        steps = (-SIDE, -1, 1, SIDE)
        for i in range(0, len(at), block):
            here = at[i : i + block]
            n = len(here)
            context = framed[here + np.array(steps)[:, None]].astype(np.int64)
            seen = self.vectors[context]
            h = np.tanh((seen * self.gates[:, None, :]).sum(axis=0) + self.bias)
            code = framed[here].astype(np.int64)
            target, cluster = outputs_of(code)
            p = np.exp(h @ self.first + self.first_bias)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), target] -= 1
            back = p @ self.first.T
            member, of = chunks_of(cluster, 16)
            if len(of):
                real = (member >= 0)[:, :, None]
                near = h[member]
                q = np.exp(np.matmul(near, self.second[of]) + self.second_bias[of][:, None, :])
                q /= q.sum(axis=2, keepdims=True)
                word = (code[member] - SINGLES) % EACH
                np.put_along_axis(q, word[:, :, None], np.take_along_axis(q, word[:, :, None], axis=2) - 1, axis=2)
                q *= real
                more = np.matmul(q, self.second[of].transpose(0, 2, 1))
                back[member[real[:, :, 0]]] += more[real[:, :, 0]]
                begin = np.flatnonzero(np.diff(of, prepend=-1))
                g, g_bias = np.add.reduceat(np.matmul(near.transpose(0, 2, 1), q), begin), np.add.reduceat(q.sum(axis=1), begin)
                of = of[begin]
                sums[5][of] += (g * g).mean(axis=(1, 2))
                self.second[of] -= (rate / np.sqrt(sums[5][of]))[:, None, None] * g
                sums[6][of] += g_bias * g_bias
                self.second_bias[of] -= rate * 0.3 * g_bias / np.sqrt(sums[6][of])
                np.clip(self.second, -4, 4, out=self.second)
            back *= 1 - h * h
            ids = context.ravel()
            order = np.argsort(ids.astype(np.uint16), kind="stable")
            ids = ids[order]
            begin = np.flatnonzero(np.diff(ids, prepend=-1))
            g = np.add.reduceat((back * self.gates[:, None, :]).reshape(-1, HIDDEN)[order], begin)
            ids = ids[begin]
            for k, part, grad in ((1, self.gates, (seen * back).sum(axis=1)), (2, self.bias, back.sum(axis=0)), (3, self.first, h.T @ p), (4, self.first_bias, p.sum(axis=0))):
                sums[k] += grad * grad
                part -= (rate * 0.3 / np.sqrt(sums[k])) * grad
            sums[0][ids] += (g * g).mean(axis=1)
            self.vectors[ids] -= (rate / np.sqrt(sums[0][ids]))[:, None] * g
            np.clip(self.first, -2, 2, out=self.first)


def masked_places(sizes: np.ndarray, mask: int, start: np.ndarray) -> np.ndarray:
    """In framed segments of these sizes back to back, each `mask`-th word's place, the first one given by `start`."""
    inner = sizes - 2 * SIDE
    first = np.cumsum(sizes) - sizes + SIDE
    many = np.maximum(-(-(inner - start) // mask), 0)
    return np.repeat(first + start, many) + mask * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))


def merged(copies: DataFrame, shards: int) -> np.ndarray | None:
    """The copies' mean, weighted by words: groups of FAN are merged, in a fixed order, until one is left."""

    def merge(got):
        got = got.sort_by("node")
        weight = got.column("weight").to_numpy()
        total = np.zeros(0)
        for w, x in zip(weight / weight.sum(), got.column("x")):
            x = np.frombuffer(x.as_py(), np.float32).astype(np.float64) * w
            total = total + x if len(total) else x
        return pa.table({"node": pa.array([got.column("node")[0].as_py() // FAN]), "weight": pa.array([weight.sum()]), "x": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        copies = copies.groupBy((F.col("node") / FAN).cast("long")).applyInArrow(merge, "node long, weight double, x binary")
        shards = -(-shards // FAN)
        if shards <= 1:
            break
    got = copies.collect()  # one row, or none if no word was masked
    return np.frombuffer(got[0]["x"], np.float32) if got else None


@dataclass
class LanguageScorer:
    vocabulary: Vocabulary
    network: Network
    counts: DataFrame  # of words, stored


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = 2, mask: int = 4, rate: float = 0.25, shard_words: int = 1 << 22) -> Network:
    """`rounds` rounds over every document; a round masks a `mask`-th of the words, other words than the rounds before."""
    spark = encoded.sparkSession
    shards = max(1, -(-vocabulary.total // shard_words))
    network = Network.start(vocabulary.count)
    pick = F.xxhash64(F.coalesce("doc_id", "row"), F.col("segment"), F.col("ids"))
    rows = encoded.where("n_words > 0").select(F.pmod(pick, F.lit(shards)).alias("node"), pick.alias("pick"), "ids")

    def learner(step: int, at):
        def learn(got):
            got = got.sort_by([("pick", "ascending"), ("ids", "ascending")])
            pick, ids = got.column("pick").to_numpy(), got.column("ids").to_pylist()
            sizes = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            framed = np.frombuffer(b"".join(ids), "<u2")
            places = masked_places(sizes, mask, (pick // shards + step * (mask // rounds)) % mask)
            net = Network.shaped(at.value)
            net.train(framed, places, rate / (1 + step))
            return pa.table({"node": pa.array([got.column("node")[0].as_py()], pa.int64()), "weight": pa.array([float(sizes.sum())]), "x": pa.array([net.flat().tobytes()], pa.binary())})

        return learn

    for step in range(rounds):
        learn = learner(step, spark.sparkContext.broadcast(network.flat()))
        x = merged(rows.groupBy("node").applyInArrow(learn, "node long, weight double, x binary"), shards)
        if x is not None:
            network = Network.shaped(x)
    return network


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE, **training) -> LanguageScorer:
    """Count all words of all documents, then train on all of them."""
    return _fit(docs, id_col, text_col, table, training)[0]


def _fit(docs: DataFrame, id_col: str, text_col: str, table: int, training: dict) -> tuple[LanguageScorer, DataFrame]:
    counts = C.stored(count_words(docs, text_col), "words")
    vocabulary = build_vocabulary(counts, table)
    encoded = encode(docs, vocabulary, id_col, text_col)
    return LanguageScorer(vocabulary, train(encoded, vocabulary, **training), counts), encoded


def score_encoded(encoded: DataFrame, scorer: LanguageScorer) -> DataFrame:
    """doc_id, n_words, log_prob (sum over words) and mean_log_prob for every document of an encoded table."""
    shared = encoded.sparkSession.sparkContext.broadcast(scorer.network.flat())  # about 1.2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.shaped(shared.value)
        for batch in batches:
            n = batch.column(2).to_numpy()
            ids = batch.column(4).to_pylist()
            lp = batch.column(3).to_numpy().copy()
            for i, j in C.slices(np.append(0, np.cumsum(n + 1)), 1 << 18):
                framed = np.frombuffer(b"".join(ids[i:j]), "<u2")
                sizes = n[i:j] + 2 * SIDE
                first = np.cumsum(sizes) - sizes + SIDE
                places = np.repeat(first - (np.cumsum(n[i:j]) - n[i:j]), n[i:j]) + np.arange(n[i:j].sum())
                sums = np.append(0, np.cumsum(net.scores(framed, places)))
                ends = np.cumsum(n[i:j])
                lp[i:j] += sums[ends] - sums[ends - n[i:j]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lp)], names=["row", "doc_id", "n_words", "lp"])

    near = encoded.select("row", "doc_id", "n_words", "base", "ids").mapInArrow(run, "row long, doc_id long, n_words long, lp long")
    # Words outside the table: a log count each; those that occur once, or never in the corpus counted, add nothing.
    seen = scorer.counts.where("n > 1").select("key", F.rint(F.log("n") * UNIT).cast("long").alias("lp"))
    far = encoded.select("row", F.explode("far").alias("key")).join(seen, "key").groupBy("row").agg(F.sum("lp").alias("lp"))
    both = near.unionByName(far.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), "lp"))
    total = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), (F.sum("lp") / UNIT).alias("log_prob"))
    return total.select("doc_id", "n_words", "log_prob", (F.col("log_prob") / F.greatest("n_words", F.lit(1))).alias("mean_log_prob"))


def score(docs: DataFrame, scorer: LanguageScorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum over words) and mean_log_prob for every row."""
    return score_encoded(encode(docs, scorer.vocabulary, id_col, text_col), scorer)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE, **training) -> DataFrame:
    """As score(docs, fit(docs)), with the documents encoded once."""
    scorer, encoded = _fit(docs, id_col, text_col, table, training)
    return score_encoded(encoded, scorer)
