"""The viewer's interaction log: window drags, resets, double taps, data set changes, coalesced renders.

Events are rows keyed by viewer and ordered by time (then by id). The drag fold clamps the width at every
step, so it is no plain sum: in batch it is put together from ranges of a viewer's events, in a stream it is keyed
state. Both forms give the same state after each event. In a stream, events beyond the watermark, or behind what their viewer
has already seen, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Drag sensitivity, double-tap gap and cine period.
SENSITIVITY, DOUBLE_TAP_MS, CINE_MS = 2.0, 300, 200


def initial_window(explicit_center: Column, explicit_width: Column, own_center: Column, own_width: Column) -> tuple[Column, Column]:
    """Window on opening: given, else the data set's, else 128/256; a width of 0 or less gives 256."""
    width = F.coalesce(explicit_width, own_width, F.lit(256.0))
    return F.coalesce(explicit_center, own_center, F.lit(128.0)), F.when(width <= 0, F.lit(256.0)).otherwise(width)


def drag_fold(events: DataFrame, keys: list[str], order: list[str], dx: str, dy: str, center: float, width: float, sensitivity: float = SENSITIVITY) -> DataFrame:
    """Each viewer's window after all its drags: width follows dx, at least 1 after every step; centre goes against dy.

    Steps w -> max(1, w + d) compose: after sums S1, S2, .. Sn of the steps the width is Sn + max(w, 1 - the least sum).
    So events are dealt by ranges of their order, each range of a viewer gives its sum and its least running sum, and
    these few rows are put together: a hot viewer is spread over all ranges, and no list of its events is ever held.
    """
    x, y = F.col(dx).cast("double") * sensitivity, F.col(dy).cast("double") * sensitivity
    rows = events.select(*keys, *order, x.alias("_x"), y.alias("_y")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    running = rows.withColumn("_sum", F.sum("_x").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranges = running.groupBy(*keys, "_range").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"), F.min("_sum").alias("_low"))
    before = F.coalesce(F.sum("_x").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = ranges.withColumn("_low", F.col("_low") + before).groupBy(*keys).agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"), F.min("_low").alias("_low"))
    return whole.select(*keys, (F.lit(float(center)) - F.col("_y")).alias("wc"), (F.col("_x") + F.greatest(F.lit(float(width)), F.lit(1.0) - F.col("_low"))).alias("ww"))


def drags_since_reset(events: DataFrame, keys: list[str], order: list[str], kind: str, resets: list[str]) -> DataFrame:
    """The events after each viewer's last one of a kind in `resets`, and that event itself: the fold over them begins anew there."""
    last = events.where(F.col(kind).isin(*resets)).groupBy(*keys).agg(F.max(F.struct(*order)).alias("_reset"))
    return events.join(last, keys, "left").where(F.col("_reset").isNull() | (F.struct(*order) >= F.col("_reset"))).drop("_reset")


def running_center(events: DataFrame, keys: list[str], order: list[str], dy: str, center: float, sensitivity: float = SENSITIVITY) -> DataFrame:
    """events with the window centre after each: a running sum, as the centre is never clamped."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("wc", F.lit(float(center)) - F.sum(F.col(dy).cast("double") * sensitivity).over(w))


def double_taps(taps: DataFrame, keys: list[str], order: list[str], ms: str, gap: int = DOUBLE_TAP_MS) -> DataFrame:
    """keys and resets: how many double taps; a tap within `gap` of the last resets, and the next one starts afresh.

    In a run of taps each within `gap` of the one before, every second one resets.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    since = F.col(ms).cast("bigint") - F.lag(F.col(ms).cast("bigint")).over(w)
    runs = taps.select(*keys, *(c for c in order if c not in keys), F.when(since < gap, F.lit(0)).otherwise(F.lit(1)).alias("_begins"))
    runs = runs.select(*keys, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    lengths = runs.groupBy(*keys, "_run").agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("_n"))
    return lengths.groupBy(*keys).agg(F.sum("_n").alias("resets"))


def changes(events: DataFrame, keys: list[str], order: list[str], dataset: str, frame: str) -> DataFrame:
    """events with reinit (another data set) and rerender (another data set or frame) against the viewer's event before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    differs = lambda c: F.coalesce(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(True))
    first = F.row_number().over(w) == 1
    return events.withColumn("reinit", first | differs(dataset)).withColumn("rerender", first | differs(dataset) | differs(frame))


def coalesced(events: DataFrame, keys: list[str], batch: Column, order: list[str]) -> DataFrame:
    """The latest event of each viewer in each micro-batch; earlier requests are stale and never rendered."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys, batch.alias("batch")).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return last.select(*keys, "batch", *(F.col("_e")[c].alias(c) for c in rest))


STATE = "viewer bigint, event_id bigint, wc double, ww double, generation bigint"


def window_states(events: DataFrame, center: float, width: float, monochrome: bool = True, sensitivity: float = SENSITIVITY, gap: int = DOUBLE_TAP_MS, late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """A stream of viewer, event_id, wc, ww and generation after each event, from keyed state.

    events: viewer, event_id, ms, kind (drag, tap, reset or dataset), dx, dy. Drags move the window of
    monochrome images; resets, double taps and data set changes put it back. Each state change is a new generation.
    Events older than the watermark, which is `late` behind the newest, are dropped, and so are events before one that their
    viewer has already seen. A viewer's state ends when the watermark is `idle` beyond its last event; it then begins anew.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        wc, ww, generation, last, seen, seen_id = state.get if state.exists else (center, width, 0, -1, -(1 << 62), -1)
        e = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        e = e[(e["ms"] > seen) | (e["ms"] == seen) & (e["event_id"] > seen_id)]
        rows = []
        for event_id, ms, kind, dx, dy in zip(e["event_id"].tolist(), e["ms"].tolist(), e["kind"].tolist(), e["dx"].tolist(), e["dy"].tolist()):
            again = kind == "tap" and last >= 0 and ms - last < gap
            if kind == "drag" and monochrome:
                ww, wc, generation = max(1.0, ww + dx * sensitivity), wc - dy * sensitivity, generation + 1
            elif again or kind in ("reset", "dataset"):
                wc, ww, generation = center, width, generation + 1
            if kind == "tap":
                last = -1 if again else ms
            seen, seen_id = ms, event_id
            rows.append((key[0], event_id, wc, ww, generation))
        state.update((wc, ww, generation, last, seen, seen_id))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + pause)
        yield pd.DataFrame(rows, columns=["viewer", "event_id", "wc", "ww", "generation"])

    timed = events.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return timed.groupBy("viewer").applyInPandasWithState(step, STATE, "wc double, ww double, generation bigint, last bigint, seen bigint, seen_id bigint", "append", GroupStateTimeout.EventTimeTimeout)
