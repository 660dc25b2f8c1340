"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Query vectors are dealt into blocks and base vectors into shards; a (block, shard) tile is one
matrix product. Within a tile every query keeps its best of the shard by partial selection, and
the per-tile lists are merged in a tree of group-and-merge rounds. No row sees a tile
that does not need it, and neither side is broadcast, so either may grow. Components travel in the
smallest integer type that holds them all. Products are in doubles where these are exact; beyond that doubles with a bound on
their error select, and the selected scores are worked out in whole numbers.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part on
either side. Vectors of different lengths do not meet. A query meets every row but itself: rows that repeat its id are
candidates, each as often as it occurs, and each query row has a list of its own.
Ties go to the smaller vec_id. Empty tables give an empty result. Rows with a null vec_id take no part. A component or a
score beyond 64 bits is an error. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["query_id", "h1", "h2", "copies"]
TILE_SCHEMA = "query_id long, h1 long, h2 long, copies long, vec_id long, score long, same boolean"
CELLS = 1 << 22  # scores held at once


def floored(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x); null for vectors that take no part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    whole = lambda y: F.when(F.abs(y) < F.lit(2.0**63), F.floor(y)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    values = F.transform(vector, lambda x: whole(F.lit(float(scale)) * x.cast("double")))
    return F.when(vector.isNotNull() & ~F.exists(vector, odd), values)


def best_of(q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of v for each row of q, ties to the smaller vid: row of q, row of v and score (whole numbers, as objects if need be)."""
    q, v = q.astype(np.int64), v.astype(np.int64)
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    exact = size(q) * size(v) * max(1, q.shape[1]) < 2.0**53
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    rows, cols, scores = (np.zeros(0, np.int64),) * 3
    step = max(64, CELLS // max(1, len(q)))
    for i in range(0, len(v), step):
        score = qf @ vf[i : i + step].T
        keep = min(k, score.shape[1])
        # Partial selection: the cut score of each query, then all rows at or above it, so ties survive.
        cut = np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep]
        if not exact:
            cut = cut - 4 * (q.shape[1] + 2) * 2.0**-52 * (np.abs(qf) @ np.abs(vf[i : i + step]).T).max(axis=1)
        r, c = np.nonzero(score >= cut[:, None])
        if exact:
            got = score[r, c].astype(np.int64)
        else:
            got = np.array([sum(map(int.__mul__, q[a].tolist(), v[i + b].tolist())) for a, b in zip(r.tolist(), c.tolist())], object)
        rows, cols, scores = np.append(rows, r), np.append(cols, c + i), np.append(scores, got)
        if exact:
            order = np.lexsort((vid[cols], -scores, rows))
        else:
            order = np.array(sorted(range(len(rows)), key=lambda t: (rows[t], -scores[t], vid[cols[t]])), np.int64)
        rows, cols, scores = rows[order], cols[order], scores[order]
        fits = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
        rows, cols, scores = rows[fits], cols[fits], scores[fits]
    return rows, cols, scores


def _smallest(vector: Column, most: int) -> Column:
    return vector.cast("array<smallint>" if most < 1 << 15 else "array<int>" if most < 1 << 31 else "array<long>")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    block_rows: int = 16384,
    shard_rows: int = 32768,
    fan_in: int = 8,
) -> DataFrame:
    """Each query row's k highest integer inner products: query_id, rank (from 1), vec_id, score.

    block_rows and shard_rows bound a tile's two matrices; fan_in is how many lists meet in one node of the merging tree.
    """
    spark = vectors.sparkSession
    base = vectors.select(vectors[id_col].cast("long").alias("id"), floored(vectors[vec_col], scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    n, asking, most = base.select(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    shards, blocks = (max(1, -(-x // size)) for x, size in ((n, shard_rows), (asking, block_rows)))
    shards = max(shards, min(2 * spark.sparkContext.defaultParallelism, -(-n // 2048)))
    base = base.withColumn("v", _smallest(F.col("v"), most or 0))
    # Rows that agree in id and vector ask once; both hashes together name a vector.
    queries = base.where("asks").groupBy("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    shard_of = F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(shards)).cast("int")
    block_of = F.pmod(F.xxhash64(F.lit(2), "id", "h1"), F.lit(blocks)).cast("int")
    rows = base.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), shard_of.alias("shard"), "id", "v", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("copies"))
    asked = queries.select(block_of.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v", "h1", "h2", "copies")

    def tile(both):
        both = both.combine_chunks()
        values, sizes = both.column("v").combine_chunks(), np.diff(both.column("v").combine_chunks().offsets.to_numpy())
        flat, first = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        ids, h1, h2, copies = (both.column(c).to_numpy() for c in ("id", "h1", "h2", "copies"))
        out = [pa.table({"query_id": ids[:0], "h1": h1[:0], "h2": h2[:0], "copies": copies[:0], "vec_id": ids[:0], "score": ids[:0], "same": np.zeros(0, bool)})]
        for width in np.unique(sizes):
            own = np.flatnonzero(sizes == width)
            matrix = flat[(first[own][:, None] + np.arange(width)).ravel()].reshape(len(own), width)
            asks = copies[own] > 0
            a, b = own[asks], own[~asks]
            if len(a) and len(b):
                r, c, score = best_of(matrix[asks], ids[b], matrix[~asks], k + 1)
                if any(not -(1 << 63) < int(x) < 1 << 63 for x in (score if score.dtype == object else ())):
                    raise OverflowError("a score is beyond 64 bits")
                same = (ids[a[r]] == ids[b[c]]) & (matrix[asks][r] == matrix[~asks][c]).all(axis=1)
                out.append(pa.table({"query_id": ids[a[r]], "h1": h1[a[r]], "h2": h2[a[r]], "copies": copies[a[r]], "vec_id": ids[b[c]], "score": score.astype(np.int64), "same": same}))
        return pa.concat_tables(out)

    lists = asked.unionByName(rows).groupBy("block", "shard").applyInArrow(tile, TILE_SCHEMA)
    # The tree: nodes of one level hold the k + 1 best of fan_in nodes below them; one more, as the query itself is among the candidates.
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score", "same"))), 1, k + 1)
    lists = lists.withColumn("node", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(shards)))
    nodes = shards
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        lists = lists.groupBy(*KEY, F.pmod("node", F.lit(nodes)).alias("node")).agg(best.alias("top")).select(*KEY, "node", F.inline("top")).drop("s")
    top = lists.groupBy(*KEY).agg(best.alias("top"))
    own = F.array_position(F.transform("top", lambda x: x["same"]), F.lit(True))
    others = F.slice(F.filter("top", lambda x, i: (i + 1) != own), 1, k)
    top = top.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))), others.alias("top")).select("query_id", F.posexplode("top").alias("at", "x"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
