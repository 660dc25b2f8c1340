"""Best-fit packing of token pieces into fixed-length sequences by a configuration linear program.

Documents are tokenized once; a longer one is cut into full pieces, its first piece being the short
one. Full pieces are sequences of their own. For the rest only the histogram of lengths matters
(at most `capacity` numbers, so it fits the driver at any input size). The configuration program -
choose how often to use each way of filling a sequence so that every length is covered, with as few
sequences as can be - is solved by multiplicative weights: each round prices lengths by how badly
they are covered so far, and a knapsack dynamic program finds the fillings of greatest price. The
fillings are rounded to whole numbers that the pieces suffice for, the program is solved again for the pieces
left, and so on until a twentieth of the pieces is left or no filling is whole; only that residue is packed
best-fit, longest first. Pieces then take their places by rank within their length.

Defined cases: a null text counts as empty; every document has at least its end token, so each
gives a piece. Repeated rows are packed as often as they occur, pieces of one length in any order. A very
long text is encoded whole and cut. An empty table gives no pieces. Other columns play no part. Ids must be whole
numbers or null; a text id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm import _common as C
from pixelloom.llm.bytebpe import encoder

SLICE = 1 << 22  # bytes of text handled at once
#: Settings of the program that `plan` tries: rounds, how sharply prices follow cover, and how full a filling must be to be taken.
TRIES = ((15, 10.0, 1.0), (12, 5.0, 1.0), (100, 10.0, 0.0))

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and salt (an even spread over rows, by their number in the task)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rows = (context.partitionId() if context else 0) * 0x85EBCA6B
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            for i, j in C.slices(offsets, SLICE):
                ids, n = encoder(path).encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                n = n + 1
                first, many = (n - 1) % capacity + 1, (n - 1) // capacity + 1
                doc = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                at, raw = (np.cumsum(n) - n)[doc] + start, memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                salt = (rows + np.arange(len(doc)) * 0x9E3779B1) & 0x7FFFFFFF
                rows += len(doc) * 0x9E3779B1
                cols = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(salt, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt int")


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Filling]:
    """Best-fit decreasing on a histogram: whole runs of equal fillings at a time."""
    out: Counter[Filling] = Counter()
    open_: dict[int, Counter[Filling]] = {}  # by room left: fillings and how many sequences have them
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if r in open_), None)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, times in ((each, full), (rest, 1)):
                    if n and times:
                        open_.setdefault(capacity - n * length, Counter())[((length, n),)] += times
                left = 0
                break
            filling, times = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            each = min(room // length, left)
            used = min(times, left // each)
            new = (*filling, (length, each))
            open_.setdefault(room - each * length, Counter())[new] += used
            if times > used:
                open_.setdefault(room, Counter())[filling] += times - used
            left -= used * each
        for room in [r for r in open_ if r == 0]:
            out.update(open_.pop(room))
    for c in open_.values():
        out.update(c)
    return out


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic program over the room left: the dearest filling's value, and the length it takes next (0: leave a unit empty).

    price[s] belongs to length s; a length may be taken any number of times.
    """
    lengths = np.nonzero(price > 0)[0]
    values = price[lengths]
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        n = fits[room]
        if n:
            v = best[room - lengths[:n]] + values[:n]
            i = v.argmax()
            if v[i] > best[room - 1]:
                best[room], took[room] = v[i], lengths[i]
                continue
        best[room] = best[room - 1]
    return best, took


def fillings_with(first: np.ndarray, took: np.ndarray, capacity: int) -> list[Filling]:
    """For each length in `first`, the filling that takes it and then follows the program."""
    room, cols = capacity - first, [first]
    while room.any():
        s = took[room]
        room = np.where(s > 0, room - s, np.maximum(room - 1, 0))
        cols.append(s)
    return [tuple(sorted(Counter(x for x in row if x).items(), reverse=True)) for row in np.stack(cols, axis=1).tolist()]


def configuration_lp(counts: dict[int, int], capacity: int, rounds: int, slack: float = 0.1, eta: float = 10.0) -> tuple[dict[Filling, float], float, float]:
    """Fractional use of fillings, the least share of a length it covers, and a lower bound on sequences.

    Multiplicative weights: every round uses `bound / rounds` sequences; a length's price is multiplied by
    exp(-eta * c) when a share c of its need is covered, against an even pace. A round's prices are dual
    prices too: their sum over all needs, divided by the dearest filling, bounds the optimum from below.
    The round's sequences go to the fillings within `slack` of the dearest, one for each length,
    in proportion to how far that length is behind.
    """
    need = np.zeros(capacity + 1)
    for s, n in counts.items():
        need[s] = n
    lengths = np.nonzero(need)[0]
    size = np.arange(capacity + 1) / capacity
    covered, use, rng = np.zeros(capacity + 1), Counter(), np.random.default_rng(1)
    bound = float((need * size).sum())
    for t in range(1, rounds + 1):
        ahead = covered[lengths] / need[lengths] - (t - 1) / rounds
        price = np.zeros(capacity + 1)
        price[lengths] = size[lengths] * np.exp(np.clip(-eta * ahead, -30, 30))
        bound = max(bound, float((price * need).sum() / knapsack(price, capacity)[0][capacity])) if t % 10 == 0 else bound
        price[lengths] *= 1 + 1e-3 * rng.random(len(lengths))  # so that equal fillings take turns
        best, took = knapsack(price, capacity)
        value = price[lengths] + best[capacity - lengths]
        lag = np.maximum(t / rounds - covered[lengths] / need[lengths], 0) * need[lengths]
        near = (value >= (1 - slack) * best[capacity]) & (lag > 0)
        if not near.any():
            near[int(value.argmax())] = True
            lag[near] = 1
        chosen = fillings_with(lengths[near], took, capacity)
        mass = np.array([g / dict(f)[s] for g, f, s in zip(lag[near], chosen, lengths[near].tolist())])
        mass *= bound / rounds / mass.sum()
        for filling, m in zip(chosen, mass.tolist()):
            use[filling] += m
            for s, n in filling:
                covered[s] += m * n
    return dict(use), float((covered[lengths] / need[lengths]).min()), bound


def rounded(counts: dict[int, int], capacity: int, rounds: int, eta: float, fill: float = 1.0, residue: float = 0.05, times: int = 12) -> tuple[Counter[Filling], Counter[int]]:
    """Whole numbers of fillings that use a share `fill` of a sequence at least, and the pieces that none holds.

    Each time the program is solved for the pieces left, and its fillings, most used first, are taken as often as
    their use, with the fractions of those before carried over, while the pieces last.
    """
    left, chosen, total = Counter(counts), Counter(), sum(counts.values())
    for _ in range(times):
        use, _, _ = configuration_lp({s: n for s, n in left.items() if n}, capacity, rounds, eta=eta)
        carry, taken = 0.0, 0
        for filling in sorted(use, key=lambda f: (-use[f], f)):
            if sum(s * n for s, n in filling) < fill * capacity:
                continue
            carry += use[filling]
            whole = min(int(carry), *(left[s] // n for s, n in filling))
            if whole > 0:
                carry -= whole
                taken += whole
                chosen[filling] += whole
                for s, n in filling:
                    left[s] -= n * whole
        if not taken or sum(left.values()) <= residue * total:
            break
    return chosen, Counter({s: n for s, n in left.items() if n})


def plan(counts: dict[int, int], capacity: int, tries: tuple[tuple[int, float, float], ...] = TRIES) -> Counter[Filling]:
    """Fillings and how many sequences take each; together they hold exactly the histogram.

    The program's rounded fillings, and the residue best-fit; of several settings of the program the one with the fewest
    sequences, or the first within a thousandth of the volume bound.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if not counts:
        return Counter()
    volume, best = -(-sum(s * n for s, n in counts.items()) // capacity), None
    for rounds, eta, fill in tries:
        chosen, left = rounded(counts, capacity, rounds, eta, fill)
        chosen.update(best_fit(left, capacity))
        if best is None or sum(chosen.values()) < sum(best.values()):
            best = chosen
        if sum(best.values()) <= 1.001 * volume:
            break
    return best


def places(fillings: Counter[Filling]) -> dict[str, np.ndarray]:
    """For each run of places: length, first rank of the pieces that fill it, pieces a sequence, first sequence, offset."""
    rank: Counter[int] = Counter()
    cols: dict[str, list[int]] = {k: [] for k in ("length", "rank", "each", "sequence", "offset")}
    sequence = 0
    for filling, times in sorted(fillings.items()):
        offset = 0
        for s, n in filling:
            for k, v in zip(cols, (s, rank[s], n, sequence, offset)):
                cols[k].append(v)
            rank[s] += n * times
            offset += s * n
        sequence += times
    order = np.lexsort((cols["rank"], cols["length"]))
    return {k: np.array(v, np.int64)[order] for k, v in cols.items()}


def pack(cut: DataFrame, capacity: int = 2048, groups: int = 20_000, least: int = 500) -> DataFrame:
    """cut, but for its salt, with sequence_id and offset. Full pieces get negative sequence numbers, others the plan's.

    Pieces of one length are ranked in groups by salt, each of about a `groups`-th of all pieces, or of `least`. So there
    are at most `groups` + `capacity` groups at any input size, whose first ranks are summed on the driver.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.where(F.col("length") < capacity).groupBy("length").count().collect()}  # at most capacity - 1 rows
    rows = max(least, -(-sum(counts.values()) // groups))
    # An array by length, so that a row's lookup costs the same for any number of busy lengths.
    share = ",".join(str(max(1, -(-counts.get(s, 0) // rows))) for s in range(capacity + 1))
    group = F.pmod("salt", F.get(F.expr(f"array({share})"), F.col("length").cast("int"))).cast("int")
    part = cut.where(F.col("length") < capacity).withColumn("group", group)
    sizes = {(r["length"], r["group"]): r["count"] for r in part.groupBy("length", "group").count().collect()}  # at most groups + capacity rows
    base, before = {}, Counter()
    for (length, g), n in sorted(sizes.items()):
        base[length << 32 | g] = before[length]
        before[length] += n
    begins = np.array(sorted(base), np.int64), np.array([base[k] for k in sorted(base)], np.int64)
    where = spark.sparkContext.broadcast((places(plan(counts, capacity)), begins))
    # Full pieces: each is a sequence; its number only has to differ from all others.
    kept = [c for c in cut.columns if c != "salt"]
    full = cut.where(F.col("length") >= capacity).select(*kept, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    row = F.row_number().over(Window.partitionBy("length", "group").orderBy("salt", "doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = part.select(*kept, "group", row.cast("long").alias("row"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (groups_at, first) = where.value
        key = at["length"] << 44 | at["rank"]
        for batch in batches:
            length, group, row = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "group", "row"))
            rank = first[np.searchsorted(groups_at, length << 32 | group)] + row
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            turn = rank - at["rank"][i]
            sequence, copy = at["sequence"][i] + turn // at["each"][i], turn % at["each"][i]
            kept = batch.drop_columns(["group", "row"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(at["offset"][i] + copy * length)], names=[*kept.schema.names, "sequence_id", "offset"])

    return full.unionByName(ranked.mapInArrow(settle, full.schema))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document, with its sequence and its offset there."""
    return pack(C.stored(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
