"""The interaction log: batch folds, and the stream against a plain loop over the same events."""

import random

from pyspark.sql import functions as F

from pixelloom.streaming import interaction


def test_drag_fold_clamps_at_every_step(spark):
    rows = spark.createDataFrame([(1, 1, 50.0, 3.0), (1, 2, -900.0, 0.0), (1, 3, 30.0, -1.0)], "v int, t int, dx double, dy double")
    got = interaction.drag_fold(rows, ["v"], ["t"], "dx", "dy", 40.0, 400.0).first()
    assert (got["ww"], got["wc"]) == (61.0, 36.0)


def test_double_taps(spark):
    rows = spark.createDataFrame([(1, i, ms) for i, ms in enumerate((0, 100, 200, 450, 1000, 1299, 1598))], "v int, i int, ms bigint")
    assert interaction.double_taps(rows, ["v"], ["i"], "ms").first()["resets"] == 3


def test_initial_window(spark):
    d = lambda x: F.lit(x).cast("double")
    got = spark.range(1).select(*interaction.initial_window(d(None), d(0.0), d(5.0), d(7.0))).first()
    assert tuple(got) == (5.0, 256.0)


def test_stream_equals_a_plain_loop(spark, tmp_path):
    rng = random.Random(2)
    rows = [(v, i, ms, rng.choice(["drag", "drag", "tap", "reset", "dataset"]), rng.uniform(-90, 90), rng.uniform(-9, 9)) for v in (1, 2) for i, ms in enumerate(sorted(rng.sample(range(9000), 40)))]
    schema = "viewer bigint, event_id bigint, ms bigint, kind string, dx double, dy double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = interaction.window_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 40.0, 400.0)
    run = stream.writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = []
    for viewer in (1, 2):
        wc, ww, generation, last = 40.0, 400.0, 0, None
        for v, i, ms, kind, dx, dy in sorted(r for r in rows if r[0] == viewer):
            if kind == "drag":
                wc, ww, generation = wc - 2 * dy, max(1.0, ww + 2 * dx), generation + 1
            again = kind == "tap" and last is not None and ms - last < 300
            if again or kind in ("reset", "dataset"):
                wc, ww, generation = 40.0, 400.0, generation + 1
            if kind == "tap":
                last = None if again else ms
            want.append((viewer, i, wc, ww, generation))
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(want)


def test_late_and_out_of_order_events_are_dropped(spark, tmp_path):
    schema = "viewer bigint, event_id bigint, ms bigint, kind string, dx double, dy double"
    batches = [[(1, 1, 100_000, "drag", 1.0, 0.0)], [(1, 2, 99_000, "drag", 1.0, 0.0), (1, 3, 101_000, "drag", 1.0, 0.0), (2, 4, 98_000, "drag", 5.0, 0.0)], [(2, 5, 10_000, "drag", 5.0, 0.0), (2, 6, 99_500, "drag", 5.0, 0.0)]]
    source, sink = tmp_path / "in", []
    source.mkdir()
    stream = interaction.window_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), 40.0, 400.0, late="5 seconds")
    run = stream.writeStream.foreachBatch(lambda df, _: sink.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        run.processAllAvailable()
    run.stop()
    # Event 2 came after a later one of its viewer, event 5 lies beyond the watermark.
    assert sorted((v, i, ww) for v, i, _, ww, _ in sink) == [(1, 1, 402.0), (1, 3, 404.0), (2, 4, 410.0), (2, 6, 420.0)]


def test_hot_viewer_and_ranges(spark):
    rng = random.Random(5)
    rows = [(1 if i % 3 else 2 + i % 5, i, rng.uniform(-60, 50), rng.uniform(-9, 9)) for i in range(3000)]
    got = {r["v"]: (r["wc"], r["ww"]) for r in interaction.drag_fold(spark.createDataFrame(rows, "v int, t int, dx double, dy double").repartition(7), ["v"], ["t"], "dx", "dy", 40.0, 400.0).collect()}
    for v in {r[0] for r in rows}:
        wc, ww = 40.0, 400.0
        for _, _, dx, dy in (r for r in rows if r[0] == v):
            wc, ww = wc - 2 * dy, max(1.0, ww + 2 * dx)
        assert abs(got[v][0] - wc) < 1e-6 and abs(got[v][1] - ww) < 1e-6
