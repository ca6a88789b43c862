"""Pruned pairs against all pairs, and places in time against a plain ordering."""

import numpy as np
import pytest
from newsloom.operators import vectors, windows
from pyspark.sql import functions as F


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "label long, centroid array<double>")


def brute(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)
    return {(a, b) for at in range(0, len(u), 1000) for a, b in zip(*np.nonzero(u[at : at + 1000] @ u.T >= threshold), strict=True) for a in [a + at] if a < b}


def test_ten_thousand_centroids_under_a_tenth_of_the_comparisons(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 24))[draw.integers(0, 200, 10_000)] + 0.12 * draw.normal(size=(10_000, 24))
    given = table(spark, x)
    got = {(r.a, r.b) for r in vectors.similar_pairs(given, threshold=0.97).select("a", "b").collect()}
    assert got == brute(x, 0.97) and len(got) > 50_000
    compared = vectors.near_candidates(given, "label", 0.97).count()
    print("compared", compared, "of", 10_000 * 9_999 // 2)
    assert compared < 0.1 * 10_000 * 9_999 / 2


@pytest.mark.parametrize("threshold", [0.05, 0.6, 1.0])
def test_small_tables(spark, threshold):
    x = np.random.default_rng(5).normal(size=(60, 3))
    x[7] = x[3] * 2
    x[9] = 0
    got = {(r.a, r.b): r.similarity for r in vectors.similar_pairs(table(spark, x), threshold=threshold).collect()}
    if threshold < 1:
        assert set(got) == brute(x, threshold)
    assert got.keys() >= {(3, 7)} or threshold == 1.0
    assert vectors.similar_pairs(table(spark, x).limit(0), threshold=threshold).collect() == []


def test_many_clusters_take_the_pruned_way(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(40, 3))
    given = table(spark, x).selectExpr("label", "centroid AS embedding")
    whole = sorted((r.a, r.b, round(r.similarity, 9)) for r in vectors.similar_clusters(given, threshold=0.5).collect())
    monkeypatch.setattr(vectors, "CENTERS_AT_ONCE", 10)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in vectors.similar_clusters(given, threshold=0.5).collect()) == whole


def test_places(spark):
    draw = np.random.default_rng(7)
    rows = [(None if i % 11 == 0 else f"t{draw.integers(0, 3)}", None if i % 13 == 0 else int(draw.integers(0, 40)), i) for i in range(500)]
    given = spark.createDataFrame(rows, "topic string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.place for r in windows.places(given, "topic", "ts", ("id",)).collect()}
    order = sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2]))
    seen = {}
    for topic, _, i in order:
        seen[topic] = seen.get(topic, 0) + 1
        assert got[i] == seen[topic]
    assert windows.places(given.limit(0), "topic", "ts", ("id",)).collect() == []
    assert windows.places(given.where("s is null"), "topic", "ts", ("id",)).count() == 39
