"""Leakage-free splits in time. Bounds come from one row of extremes; every row is assigned by comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.articles import micros
from newsloom.operators.evaluation import running

DAY = 86_400_000_000


def _extremes(rows: DataFrame, first: str, last: str) -> tuple[int, int] | None:
    """Least start, and the end of the row that starts last, in microseconds."""
    r = rows.agg(F.min(micros(F.col(first))).alias("lo"), F.max_by(micros(F.col(last)), micros(F.col(first))).alias("hi")).first()
    return None if r.lo is None else (r.lo, r.hi)


def time_split(rows: DataFrame, ts: str = "ts", ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), gap_days: float = 1.0, end: str | None = None) -> DataFrame:
    """rows with split: train, val or test; rows in a gap go. Days are whole days between the extremes; a span of less than a
    day is split by count, in order of time and of the remaining columns. ``end`` (for clusters) ends a row's interval: train
    is decided by it, val and test by the start. An empty input stays empty."""
    if abs(sum(ratios) - 1) > 0.01:
        raise ValueError(f"ratios must add up to 1: {ratios}")
    found = _extremes(rows, ts, end or ts)
    if found is None:
        return rows.withColumn("split", F.lit("train"))
    lo, hi = found
    days = (hi - lo) // DAY
    if days == 0:
        n = rows.count()
        a, b = int(n * ratios[0]), int(n * (ratios[0] + ratios[1]))
        placed = running(rows.withColumn("__t", F.coalesce(micros(F.col(ts)), F.lit(lo - 1))), "__t", {"__p": F.lit(1)}, ties=tuple(c for c in rows.columns if c != ts))
        return placed.withColumn("split", F.when(F.col("__p") < a, "train").when(F.col("__p") < b, "val").otherwise("test")).drop("__p", "__t")
    gap = int(gap_days * DAY)
    train_end = lo + int(int(days * ratios[0]) * DAY)
    val_start = train_end + gap
    val_end = val_start + int(int(days * ratios[1]) * DAY)
    test_start = val_end + gap
    t, e = micros(F.col(ts)), micros(F.col(end or ts))
    split = F.when(e < train_end, "train").when((t >= val_start) & (t < val_end), "val").when(t >= test_start, "test")
    return rows.withColumn("split", split).where("split is not null")


def split_info(rows: DataFrame, ts: str = "ts", ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), gap_days: float = 1.0) -> DataFrame:
    """(split, n, first, last) of a time split."""
    return time_split(rows, ts, ratios, gap_days).groupBy("split").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def durations(rows: DataFrame, ts: str = "ts", ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), gap_days: float = 1.0) -> DataFrame:
    """(split, days): the whole days, of 24 hours, between the first and the last row of each part of a time split."""
    return split_info(rows, ts, ratios, gap_days).select("split", F.floor((micros(F.col("last_ts")) - micros(F.col("first_ts"))) / F.lit(DAY)).alias("days"))


def _folds(rows: DataFrame, ts: str, folds: list[tuple[int, int, int, int]], end: str | None = None) -> DataFrame:
    """rows for each fold with fold and role; folds without a train or a test row go. ``end`` ends a row's interval: train is
    decided by it, test by the start."""
    listed = F.array(*(F.struct(F.lit(i).alias("fold"), *(F.lit(v).cast("long").alias(n) for n, v in zip(("from", "to", "start", "stop"), f, strict=True))) for i, f in enumerate(folds))) if folds else F.array().cast("array<struct<fold:int,from:bigint,to:bigint,start:bigint,stop:bigint>>")
    t, e = micros(F.col(ts)), micros(F.col(end or ts))
    marked = rows.select("*", F.inline(listed)).withColumn("role", F.when((t >= F.col("from")) & (e < F.col("to")), "train").when((t >= F.col("start")) & (t < F.col("stop")), "test")).where("role is not null")
    both = marked.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).where("a > 0 and b > 0").select("fold")
    return marked.join(F.broadcast(both), "fold").select("fold", "role", *rows.columns)


def walk_forward(rows: DataFrame, ts: str = "ts", initial: float = 30, test: float = 7, step: float = 7, gap: float = 1, end: str | None = None) -> DataFrame:
    """Train on all before, test on the next ``test`` days after a gap, moving on by ``step`` days. Of intervals (clusters), with
    ``end``, those that end before a fold's bound are trained on, and the folds reach to the end of the one that starts last."""
    found = _extremes(rows, ts, end or ts)
    folds = []
    if found:
        lo, hi = found
        bound = lo + int(initial * DAY)
        while bound + int((gap + test) * DAY) <= hi:
            start = bound + int(gap * DAY)
            folds.append((lo, bound, start, start + int(test * DAY)))
            bound += int(step * DAY)
    return _folds(rows, ts, folds, end)


def n_splits(rows: DataFrame, ts: str = "ts", initial: int = 30, test: int = 7, step: int = 7, gap: int = 1) -> int:
    """An estimate of the number of walk-forward folds from whole days."""
    found = _extremes(rows, ts, ts)
    left = (found[1] - found[0]) // DAY - initial - gap - test if found else -1
    return 0 if left < 0 else max(1, left // step)


def expanding(rows: DataFrame, ts: str = "ts", least: int = 14, test: int = 7, n: int = 5, gap: int = 1) -> DataFrame:
    """``n`` folds whose train side grows from ``least`` days; test ends are cut at the last event, which is left out."""
    found = _extremes(rows, ts, ts)
    folds = []
    if found:
        lo, hi = found
        step = max(0, ((hi - lo) // DAY - least) // n)
        for i in range(n):
            end = lo + (least + i * step) * DAY
            start = end + gap * DAY
            if start < hi:
                folds.append((lo, end, start, min(start + test * DAY, hi)))
    return _folds(rows, ts, folds)
