import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import topk
from pixelloom.llm.queries import ORACLES, op1_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, scale=1024):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(good):
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(good) if other != at and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, "own", "own") for i, v in rows], "vec_id long, embedding array<double>, label int, score string, id string")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, **kw).collect())


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.randint(-512, 512) / 1024 for _ in range(dim)]) for i in range(n)]


def test_equals_brute_force_over_many_tiles(spark):
    rows = vectors(300, 5)
    assert run(spark, rows, k=7, block_rows=8, shard_rows=40, fan_in=2) == brute(rows, 7)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [0.5, 0.25]) for i in range(60)]
    assert run(spark, rows, k=3, block_rows=2, shard_rows=10) == brute(rows, 3)


def test_awkward_vectors_take_no_part(spark):
    rows = [*vectors(25, 3), (30, None), (31, [1.0, None, 2.0]), (32, [float("nan"), 0.0, 0.0]), (40, [float("inf"), 0.0, 0.0]), (50, [1.0, 2.0]), (60, [0.5, -2.0]), (None, [0.0, 0.0, 1.0]), (70, [])]
    assert run(spark, rows, k=10) == brute(rows, 10)


def test_fewer_candidates_than_k(spark):
    rows = vectors(4, 3)
    assert run(spark, rows, k=10) == brute(rows, 10)


def test_scores_beyond_exact_doubles(spark):
    rows = [(i, [1.0e6 + 4 * i, 2.0e5 - 64 * i, 1.0 * i]) for i in range(12)]
    assert run(spark, rows, k=5) == brute(rows, 5)


def test_scores_of_many_sizes(spark):
    rng = random.Random(4)
    for scale in (1.0, 1e3, 1e5, 1e6):
        rows = [(i, [rng.uniform(-scale, scale) for _ in range(4)]) for i in range(120)] + [(200 + i, [scale, -scale, scale / 2, 0.0]) for i in range(15)]
        assert run(spark, rows, k=4, shard_rows=30, block_rows=6) == brute(rows, 4)


def test_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(10, [1e18]), (11, [1.0])])
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(10, [1e12, 3e12]), (11, [1e12, 3e12])])


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == []
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [0.0, 1.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (20, [1.0, 0.0]), (4, [-1.0, 0.25])]
    for k in (1, 2, 5, 20):
        assert run(spark, rows, k=k) == brute(rows, k)
    hot = [(10, [0.25 * (i % 7), 1.0]) for i in range(80)] + vectors(40, 2)
    assert run(spark, hot, k=3, shard_rows=16, block_rows=9) == brute(hot, 3)


def test_sql_with_repeated_ids(spark, tmp_path):
    rows = [(100 * (i % 4), [((i * 7 + j * 3) % 11 - 5) / 8 for j in range(3)], i) for i in range(60)] + [(i, [0.125 * i, -1.0, 0.5], i) for i in range(1, 40)] + [(None, [1.0, 1.0, 1.0], 0), (200, None, 0), (5, [1.0], 1)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    got = op1_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(ORACLES["op1_exact_top_k"]).fetchall())
