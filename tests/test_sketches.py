"""Frequent values and distinct counts over windows, against counts of every window's rows."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from newsloom.operators import metrics, sketches, windows
from newsloom.sources.articles import from_tables
from oracle import SMALL
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def table(spark, n, skew, seed=1):
    draw = random.Random(seed)
    values = [None, *(f"v{int(draw.paretovariate(skew))}" for _ in range(n))]
    rows = [(draw.choice(("x", None)), v, START + dt.timedelta(minutes=draw.randint(0, 5000)), i) for i, v in enumerate(values)]
    return rows, spark.createDataFrame(rows, "k string, word string, ts timestamp_ntz, i int")


def held(rows, size, step):
    """(key, window) -> its words, in hours."""
    lo = min(r[2] for r in rows if r[1] is not None)
    found = defaultdict(list)
    for k, word, ts, _ in rows:
        if word is not None:
            t = (ts - lo).total_seconds() / 3600
            for w in range(int(t // step) + 1):
                if w * step <= t < w * step + size:
                    found[k, w].append(word)
    return found


def best(words, k):
    return sorted(((-n, v) for v, n in Counter(words).items()))[:k]


@pytest.mark.parametrize(("size", "step"), [(4, 4), (24, 1), (7, 3), (2, 5), (6, 4)])
def test_windows(spark, size, step):
    rows, df = table(spark, 3000, 0.7)
    want = held(rows, size, step)
    got = defaultdict(list)
    for r in sketches.frequent(df, "word", ("k",), "ts", f"{size}h", f"{step}h", 5).orderBy("w", "rank").collect():
        got[r.k, r.w].append((-r.n, r.value))
    assert got == {key: best(words, 5) for key, words in want.items()}
    near = {(r.k, r.w): r.n for r in sketches.distinct(df, "word", ("k",), "ts", f"{size}h", f"{step}h").collect()}
    assert set(near) == set(want)
    assert all(abs(near[key] - len(set(words))) <= max(1, 0.05 * len(set(words))) for key, words in want.items())


@pytest.mark.parametrize("skew", [0.25, 3.0])
def test_more_values_than_a_sketch_tracks(spark, skew):
    """With a skew of 3 a few values stand out; with 0.25 nearly all are met once, and all must be counted."""
    rows, df = table(spark, 20_000, skew)
    words = [r[1] for r in rows if r[1] is not None]
    got = [(-r.n, r.value) for r in sketches.frequent(df, "word").orderBy("rank").collect()]
    assert got == best(words, 10)
    (n,) = [r.n for r in sketches.distinct(df, "word").collect()]
    assert abs(n - len(set(words))) <= 0.05 * len(set(words))


def test_values_that_all_occur_as_often(spark):
    df = spark.range(40_000).select((F.col("id") % 4000).cast("string").alias("word"))
    assert [(r.rank, r.value, r.n) for r in sketches.frequent(df, "word", k=3).orderBy("rank").collect()] == [(1, "0", 10), (2, "1", 10), (3, "10", 10)]


def test_ties_and_whole_tables(spark):
    articles = from_tables(spark, SMALL)
    words = articles.select("cluster_id", "published_at", "id", F.posexplode("keywords").alias("place", "keyword"))
    got = sketches.frequent(words, "keyword", ("cluster_id",), ties=("published_at", "id", "place")).select("cluster_id", "rank", F.col("value").alias("keyword"), "n")
    want = metrics.keyword_counts(articles)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_distinct_agrees_with_the_windows_of_rows(spark):
    _, df = table(spark, 2000, 1.0)
    exact = windows.assign(df.where("word is not null"), "ts", "12h", "2h").groupBy("w").agg(F.count_distinct("word").alias("n"))
    near = sketches.distinct(df, "word", ts="ts", size="12h", step="2h")
    both = exact.join(near.withColumnRenamed("n", "near"), "w", "full").collect()
    assert len(both) > 30 and all(abs(r.near - r.n) <= max(1, 0.05 * r.n) for r in both)


def test_empty_tables(spark):
    _, df = table(spark, 0, 1.0)
    for rows in (df, df.where(F.lit(False))):
        assert sketches.frequent(rows, "word", ("k",), "ts", "4h", "1h").collect() == []
        assert sketches.distinct(rows, "word", ("k",), "ts", "4h").collect() == []
        assert sketches.frequent(rows, "word").collect() == []


def test_rows_are_never_repeated_for_windows(spark):
    """What grows with size over step is a sketch for each pane, not a row for each window."""
    _, df = table(spark, 10, 1.0)
    plan = sketches.distinct(df, "word", ts="ts", size="64h", step="1h")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 7 and "sequence(" not in plan
