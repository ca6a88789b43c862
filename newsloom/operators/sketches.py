"""Frequent values and distinct counts over sliding windows from mergeable sketches.

Rows are dealt to panes, stretches of time of which windows are made; each row is in one pane, however many windows overlap. A
sketch of each pane is built where the rows are, and windows are merged from panes by doubling: log2(panes of a window) rounds.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.articles import micros
from newsloom.functions.time_windows import parse_window
from newsloom.operators.windows import bounds
from newsloom.sources.scratch import written

#: Values that a sketch of frequent ones tracks. It holds 768 counters at most, few enough that it discards by their true median.
ITEMS = 750
#: One discarding takes at least half of the 768 counters down by what the error grows, so the error is at most rows / 384; a value
#: that the sketch does not report occurs at most twice as often as that.
SHARE = 192
#: Pairs of key and value up to which candidates are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 100_000


def _panes(rows: DataFrame, ts: str | None, size: str | None, step: str | None) -> tuple[DataFrame, int, int]:
    """(rows with their pane ``p``, panes of a window, panes of a step); without ``ts`` all are in one pane, one window."""
    if ts is None:
        return rows.withColumn("p", F.lit(0).cast("long")), 1, 1
    size_us, step_us = parse_window(size), parse_window(step or size)
    pane = math.gcd(size_us, step_us)
    lo = F.broadcast(bounds(rows, ts).select("lo"))  # one row
    dealt = rows.join(lo).withColumn("p", F.floor((micros(F.col(ts)) - F.col("lo")) / F.lit(pane)).cast("long"))
    return dealt.where("p >= 0").drop("lo"), size_us // pane, step_us // pane


def _windows(p: Column, size: int, step: int) -> Column:
    """The numbers of the windows that hold a pane, none where steps leave gaps."""
    first = F.greatest(F.floor((p - size) / F.lit(step)).cast("long") + 1, F.lit(0).cast("long"))
    last = F.floor(p / F.lit(step)).cast("long")
    return F.when(first <= last, F.sequence(first, last))


def _merged(parts: DataFrame, keys: list[str], size: int, step: int, merge: str) -> DataFrame:
    """(keys, w, s, n) of every window that holds a row, from (keys, p, s, n) of panes. Round j makes the merge of 2 ** j panes
    from every pane on; a window is made of those for the binary digits of its size, one after the other, none twice."""
    table, done = parts.select(*keys, F.lit(0).alias("kind"), "p", "s", "n"), 0
    for j in range(size.bit_length()) if size > 1 else ():
        to = []
        if size >> j & 1:
            to.append(F.struct(F.lit(1).alias("kind"), (F.col("p") - done).alias("p")))
            done += 1 << j
        if size >> (j + 1):
            to += [F.struct(F.lit(0).alias("kind"), (F.col("p") - shift).alias("p")) for shift in (0, 1 << j)]
        moved = table.select(*keys, F.inline(F.when(F.col("kind") == 0, F.array(*to)).otherwise(F.array(F.struct("kind", "p")))), "s", "n")
        table = moved.where("p >= 0").groupBy(*keys, "kind", "p").agg(F.expr(merge).alias("s"), F.sum("n").alias("n"))
    whole = table if size == 1 else table.where("kind = 1")
    return whole.where(F.col("p") % step == 0).select(*keys, (F.col("p") / step).cast("long").alias("w"), "s", "n")


def _within(rows: DataFrame, wanted: DataFrame, on: list[str], small: bool = False) -> DataFrame:
    """The rows whose columns ``on`` are among the wanted; null equals null."""
    named = wanted.select(*(F.col(c).alias(f"__{c}") for c in on)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on))
    return rows.join(F.broadcast(named) if small else named, same, "left_semi")


def _ranked(dealt: DataFrame, keys: list[str], size: int, step: int, k: int, wanted: DataFrame, on: list[str]) -> DataFrame:
    """(keys, w, rank, value, n): the k most frequent values of each wanted (window[, value]), counted exactly by pane, then by window."""
    counted = dealt.groupBy(*keys, "p", "value").agg(F.count("*").alias("n"), F.min("tie").alias("tie"))
    spread = counted.withColumn("w", F.explode(_windows(F.col("p"), size, step)))
    whole = _within(spread, wanted, on).groupBy(*keys, "w", "value").agg(F.sum("n").alias("n"), F.min("tie").alias("tie"))
    rank = F.row_number().over(Window.partitionBy(*keys, "w").orderBy(F.desc("n"), "tie", "value"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "w", "rank", "value", "n")


def frequent(rows: DataFrame, value: str, keys: tuple[str, ...] = (), ts: str | None = None, size: str | None = None, step: str | None = None, k: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    """(keys, w, rank, value, n): the k most frequent values of each key and window, exactly. Ties go to the least of the columns
    ``ties``, then to the least value; null values do not count. Windows are those of windows.assign(); without ``ts`` all rows
    are window 0. Keys must not be named value, p, w, n, s, rank, tie or kind.

    A sketch names candidates; only they are counted exactly. A window whose k-th candidate is more frequent than any value the
    sketch can have missed is done. In the others, where values are about as frequent as each other, all values are counted."""
    on = list(keys)
    tie = F.struct(*ties) if ties else F.lit(0)
    dealt, panes, stride = _panes(rows.where(F.col(value).isNotNull()).select(*on, F.col(value).alias("value"), tie.alias("tie"), *([ts] if ts else [])), ts, size, step)
    parts = dealt.groupBy(*on, "p").agg(F.expr(f"approx_top_k_accumulate(value, {ITEMS})").alias("s"), F.count("*").alias("n"))
    windows = _merged(parts, on, panes, stride, f"approx_top_k_combine(s, {ITEMS})")
    told = F.transform(F.expr(f"approx_top_k_estimate(s, {ITEMS})"), lambda x: x["item"])
    sketched = written(windows.select(*on, "w", F.col("n").alias("rows"), told.alias("values")), "frequent")
    candidates = sketched.select(*on, "w", F.explode("values").alias("value"))
    pairs = written(candidates.select(*on, "value").distinct(), "candidates")
    few = pairs.count() <= BROADCAST_ROWS
    first = written(_ranked(_within(dealt, pairs, [*on, "value"], few), on, panes, stride, k, candidates, [*on, "w", "value"]), "frequent-first")
    least = first.where(F.col("rank") == k).select(*(F.col(c).alias(f"__{c}") for c in (*on, "w")), F.col("n").alias("least"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*on, "w")))
    open_ = written(sketched.join(least, same, "left").where(F.coalesce("least", F.lit(0)) * SHARE <= F.col("rows")).where(F.col("rows") >= SHARE).select(*on, "w"), "frequent-open")
    held = F.explode(F.sequence(F.col("w") * stride, F.col("w") * stride + panes - 1))
    again = _ranked(_within(dealt, open_.select(*on, held.alias("p")), [*on, "p"]), on, panes, stride, k, open_, [*on, "w"])
    names = [F.col(c).alias(f"__{c}") for c in (*on, "w")]
    return first.join(open_.select(*names), same, "left_anti").unionByName(again)


def distinct(rows: DataFrame, value: str, keys: tuple[str, ...] = (), ts: str | None = None, size: str | None = None, step: str | None = None, lg_k: int = 12) -> DataFrame:
    """(keys, w, n): about how many different values, texts or whole numbers, each key and window that holds any has; the standard
    error is 1.04 / sqrt(2 ** lg_k), 1.6 % by default. Windows and names are those of frequent()."""
    on = list(keys)
    dealt, panes, stride = _panes(rows.where(F.col(value).isNotNull()).select(*on, F.col(value).alias("value"), *([ts] if ts else [])), ts, size, step)
    parts = dealt.groupBy(*on, "p").agg(F.hll_sketch_agg("value", lg_k).alias("s"), F.count("*").alias("n"))
    return _merged(parts, on, panes, stride, "hll_union_agg(s)").select(*on, "w", F.hll_sketch_estimate("s").alias("n"))
