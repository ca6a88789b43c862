"""The replay on a stream: metrics of each narrative in each window as windows become final, held against the window before.

Windows are counted by watermarked aggregations in the JVM, so a narrative that fills a stream is combined before it is shuffled.
What the state of a narrative remembers is one row: its last window, its velocity and its stage. Whether that window was the last
one in which anything happened is known to the sink, which keeps the newest window it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from newsloom.functions.articles import stage_order
from newsloom.functions.time_windows import parse_window
from newsloom.operators import metrics, signals
from newsloom.sources.store import Store

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "w long, topic string, velocity double, stage_order int, p_w long, p_velocity double, p_order int"


def length(us: int) -> str:
    """An interval of so many microseconds, as windows and watermarks take it."""
    return f"{us} microseconds"


def window_metrics(stream: DataFrame, topic: str = "topic", outlet: str = "outlet", kind: str | None = None, ts: str = "ts", size: str = "4h", start_us: int = 0, late: str = "1h") -> DataFrame:
    """(ends, w, topic, size, velocity, stage) of each narrative in each tumbling window, of a stream or a table.

    w numbers windows from ``start_us`` (microseconds of the epoch). Outlets count distinct, null ones not at all; kind, if given, is a
    column of few values (outlet types) whose distinct number is the diversity. Rows without a topic take part in the watermark
    alone, so a source can send them to close windows. Rows later than ``late`` behind the newest are dropped once
    their window is final.
    """
    size_us = parse_window(size)
    window = F.window(ts, length(size_us), length(size_us), length(start_us % size_us))
    seen = stream.withWatermark(ts, length(parse_window(late)))
    # the time column keeps this filter above the watermark
    seen = seen.where(F.col(topic).isNotNull() | F.col(ts).isNull())
    kinds = F.collect_set(kind) if kind else F.array(F.lit("")).alias("kinds")
    by_outlet = seen.groupBy(window.alias("span"), F.col(topic).alias("topic"), F.col(outlet).alias("outlet"))
    one = by_outlet.agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), *([kinds.alias("kinds")] if kind else []))
    diversity = F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))) if kind else F.lit(1)
    per = one.groupBy("span", "topic").agg(F.sum("n").alias("size"), F.count("outlet").alias("outlets"), F.min("first").alias("first"), F.max("last").alias("last"), diversity.alias("diversity"))
    hours = (F.unix_micros("last") - F.unix_micros("first")) / 3.6e9
    velocity = F.when(hours == 0, F.col("size").cast("double")).otherwise(F.col("size") / F.when(hours != 0, hours))
    w = F.floor((F.unix_micros("span.start") - start_us) / F.lit(size_us)).cast("long")
    return per.select(F.window_time("span").alias("ends"), w.alias("w"), "topic", "size", velocity.alias("velocity"), metrics.stage(F.col("outlets"), F.col("diversity"), hours).alias("stage"))


class _Narrative(StatefulProcessor):
    """The last window of one narrative. A timer on event time forgets narratives that stay away for ``forget_ms``."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "w long, velocity double, stage_order int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows)).sort_values("w")  # a row for each window that has become final
        before = self.last.get() if self.last.exists() else (None, None, None)
        out = []
        for w, velocity, stage in zip(came["w"], came["velocity"], came["stage_order"], strict=True):
            out.append((w, key[0], velocity, stage, *before))
            before = (int(w), float(velocity), int(stage))
        self.last.update(before)
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(came["ends"].max().value // 1_000_000) + self.forget_ms)
        out = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
        yield out.astype({"p_w": "Int64", "p_velocity": "Float64", "p_order": "Int32"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def remembered(final: DataFrame, forget: str | None = None) -> DataFrame:
    """window_metrics() of a stream -> (w, topic, velocity, stage_order, p_w, p_velocity, p_order): each narrative's window with its own
    last one before, however long ago. ``forget`` (an interval of event time) bounds the state: a narrative that stays away
    longer is new when it returns. Needs the RocksDB state store, see stateful()."""
    rows = final.withColumn("stage_order", stage_order(F.col("stage"))).select("ends", "w", "topic", "velocity", "stage_order")
    processor = _Narrative(parse_window(forget) // 1000 if forget else None)
    return rows.groupBy("topic").transformWithStateInPandas(processor, COLUMNS, "append", "EventTime")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which transformWithState needs; the session's setting comes back after."""
    held = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, held)


def resolved(rows: DataFrame, newest: int | None) -> DataFrame:
    """remembered() rows of some windows -> (w, topic, signal_type, severity). A narrative's last window counts as the window before
    only if nothing happened in between. newest: the last window before these rows, null if they are the first."""
    # a row for each window of the batch
    present = rows.select("w").distinct()
    order = present.withColumn("before", F.coalesce(F.lag("w").over(Window.orderBy("w")), F.lit(newest).cast("long")))
    next_to = F.col("p_w") == F.col("before")
    told = rows.join(order, "w").withColumns({"p_velocity": F.when(next_to, F.col("p_velocity")), "p_order": F.when(next_to, F.col("p_order")), "seen_before": F.col("p_w").isNotNull()})
    return signals.fire(told, ["w", "topic"], signals.TRANSITIONS)


def sink(path: str, name: str = "transitions"):  # noqa: ANN201
    """A function for foreachBatch: transitions go to the store at ``path``, as a part for each batch that has any window, together with the newest
    window so far. Both are published at once under the batch's number, so a batch that is run again after a crash, before or after
    publishing, leaves what one run leaves."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, path)
        if store.last(name) >= number:
            return
        kept = batch.persist()
        try:
            top = kept.agg(F.max("w").alias("w")).where("w is not null")
            if top.isEmpty():
                return
            state = store.read(f"{name}_state")
            newest = state.first().w if state is not None else None
            store.put({(name, f"batch={number}"): resolved(kept, newest), (f"{name}_state", "newest"): top}, (name, number))
        finally:
            kept.unpersist()

    return write


def follow(stream: DataFrame, out: str, checkpoint: str, forget: str | None = None, **windows: Any) -> StreamingQuery:
    """Process what a stream has, or goes on having, into Store(out).read("transitions"); ``windows`` go to window_metrics().
    ``checkpoint`` and ``out`` must be shared by driver and executors; a restart goes on from there. A window is told
    when the watermark has passed its end."""
    with stateful(stream.sparkSession):
        rows = remembered(window_metrics(stream, **windows), forget)
        return rows.writeStream.foreachBatch(sink(out)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
