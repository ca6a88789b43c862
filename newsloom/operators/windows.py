"""Event-time windows by bucket arithmetic: O(rows x size / step), never a scan for each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.articles import micros
from newsloom.functions.time_windows import parse_window


def bounds(rows: DataFrame, ts: str) -> DataFrame:
    """(lo, hi) of a time column in microseconds: one row, none for an empty input."""
    return rows.agg(F.min(micros(F.col(ts))).alias("lo"), F.max(micros(F.col(ts))).alias("hi")).where("lo is not null")


def at(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def assign(rows: DataFrame, ts: str = "ts", size: str = "4h", step: str | None = None, start_us: int | None = None) -> DataFrame:
    """rows with w, the number of each window [lo + w * step, lo + w * step + size) that holds the row; lo is the first
    event or ``start_us``. A row is in no window where steps leave gaps, or before the start."""
    size_us, step_us = parse_window(size), parse_window(step or size)
    b = F.broadcast(bounds(rows, ts))  # one row
    if start_us is not None:
        b = b.withColumn("lo", F.lit(start_us).cast("long"))
    t = rows.join(b).withColumn("t", micros(F.col(ts)) - F.col("lo")).where("t >= 0")
    last = F.floor(F.col("t") / F.lit(step_us)).cast("long")
    first = F.greatest(F.floor((F.col("t") - size_us) / F.lit(step_us)).cast("long") + 1, F.lit(0).cast("long"))
    return t.where(first <= last).withColumn("w", F.explode(F.sequence(first, last))).drop("t")


def spine(rows: DataFrame, ts: str, step: str, start_us: int | None = None, strict: bool = False) -> DataFrame:
    """(w, lo): a row for each window that starts at or before the last event (before it, if strict)."""
    step_us = parse_window(step)
    b = bounds(rows, ts)
    if start_us is not None:
        b = b.withColumn("lo", F.lit(start_us).cast("long"))
    last = F.floor((F.col("hi") - F.col("lo") - (1 if strict else 0)) / F.lit(step_us)).cast("long")
    return b.where(last >= 0).select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("w"), "lo")


def counts(rows: DataFrame, ts: str = "ts", size: str = "4h", step: str | None = None, start_us: int | None = None, strict: bool = False) -> DataFrame:
    """(window_start, window_end, n) with a row for every window, empty ones too."""
    size_us, step_us = parse_window(size), parse_window(step or size)
    n = assign(rows.select(ts), ts, size, step, start_us).groupBy("w").agg(F.count("*").alias("n"))
    all_ = spine(rows.select(ts), ts, step or size, start_us, strict).join(n, "w", "left")
    start = F.col("lo") + F.col("w") * step_us
    return all_.select(at(start).alias("window_start"), at(start + size_us).alias("window_end"), F.coalesce("n", F.lit(0)).alias("n"))


def time_series(rows: DataFrame, ts: str = "ts", size: str = "1h") -> DataFrame:
    """(bucket, n), zero-filled, anchored at the first event; the last bucket holds the last event."""
    return counts(rows, ts, size).select(F.col("window_start").alias("bucket"), "n")


def cumulative(rows: DataFrame, ts: str = "ts", size: str = "4h") -> DataFrame:
    """(window_end, n): events before each window's end. One row for each window is summed, not the events."""
    per = counts(rows, ts, size)
    return per.select("window_end", F.sum("n").over(Window.orderBy("window_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"))


def sliding_delta(rows: DataFrame, ts: str = "ts", id_: str = "event_id", size: str = "4h", step: str = "1h") -> DataFrame:
    """(w, n_all, n_new, n_retained, n_expired) of each window against the one before. An id that returns after a gap is new.

    The windows of a row are a range, so what enters and leaves is known from each (id, window) and its neighbours: an
    aggregation over (window, id), no self-join."""
    seen = assign(rows.select(ts, id_), ts, size, step).select("w", F.col(id_).alias("id")).distinct()
    order = Window.partitionBy("id").orderBy("w")
    marked = seen.withColumn("before", F.coalesce(F.lag("w").over(order) == F.col("w") - 1, F.lit(False))).withColumn("after", F.coalesce(F.lead("w").over(order) == F.col("w") + 1, F.lit(False)))
    inside = marked.groupBy("w").agg(F.count("*").alias("n_all"), F.count_if(~F.col("before")).alias("n_new"), F.count_if("before").alias("n_retained"))
    gone = marked.where(~F.col("after")).groupBy((F.col("w") + 1).alias("w")).agg(F.count("*").alias("n_expired"))
    all_ = spine(rows.select(ts), ts, step).select("w").join(inside, "w", "left").join(gone, "w", "left")
    return all_.select("w", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_all", "n_new", "n_retained", "n_expired")))


def sliding_members(rows: DataFrame, ts: str = "ts", id_: str = "event_id", size: str = "4h", step: str = "1h") -> DataFrame:
    """(w, id, state): new, retained or expired, row by row; what leaves the last window is not told. One ordering of each id's
    windows, no self-join."""
    seen = assign(rows.select(ts, id_), ts, size, step).select("w", F.col(id_).alias("id")).distinct()
    order = Window.partitionBy("id").orderBy("w")
    last = F.broadcast(spine(rows.select(ts), ts, step).agg(F.max("w").alias("top")))  # one row
    marked = seen.withColumn("state", F.when(F.lag("w").over(order) == F.col("w") - 1, "retained").otherwise("new")).withColumn("goes", ~F.coalesce(F.lead("w").over(order) == F.col("w") + 1, F.lit(False)))
    here = F.struct("w", "state")
    gone = F.struct((F.col("w") + 1).alias("w"), F.lit("expired").alias("state"))
    both = F.when(F.col("goes") & (F.col("w") < F.col("top")), F.array(here, gone)).otherwise(F.array(here))
    return marked.join(last).select("id", F.inline(both)).select("w", "id", "state")


#: Ranges of time in which rows are numbered side by side.
RANGES = 200


def places(rows: DataFrame, key: str, ts: str, ties: tuple[str, ...], out: str = "place") -> DataFrame:
    """rows with the place of each by time among those of its key, from 1. All rows are dealt to RANGES ranges of time, each key's
    rows are counted by range, and a row's place is its place within key and range after what comes before. So no task orders more of a
    key than a range holds, or than rows of one time."""
    t = micros(F.col(ts))
    bounds = rows.agg(F.percentile_approx(t, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<long>")
    dealt = rows.withColumn("__r", F.when(F.col(ts).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= t))))
    counted = dealt.groupBy(F.col(key).alias("__k"), F.col("__r").alias("__q")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__k").orderBy("__q")) - F.col("__n")  # a row for each range of a key
    after = counted.select("__k", "__q", before.alias("__before"))
    here = F.row_number().over(Window.partitionBy(key, "__r").orderBy(ts, *ties))
    joined = dealt.withColumn("__here", here).join(after, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__r") == F.col("__q")))
    return joined.withColumn(out, (F.col("__before") + F.col("__here")).cast("int")).drop("__r", "__k", "__q", "__before", "__here")


def by_topic(rows: DataFrame, topic: str = "event_type", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """(topic, place, id, ts): each topic's rows by time; empty and null topics are ``unknown``."""
    named = F.coalesce(F.nullif(F.col(topic), F.lit("")), F.lit("unknown"))
    return places(rows.select(named.alias("topic"), F.col(id_).alias("id"), F.col(ts).alias("ts")), "topic", "ts", ("id",)).select("topic", "place", "id", "ts")
