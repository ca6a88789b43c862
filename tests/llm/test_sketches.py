"""Sketches: merging, containment, distinct counts."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import fingerprints

K = 64


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_merged_sketches_are_the_sketch_of_the_union(spark):
    draw = np.random.default_rng(1)
    parts = [(i % 7, [f"w{x}" for x in draw.integers(0, 400, draw.integers(0, 90))]) for i in range(120)]
    rows = spark.createDataFrame([(g, i, " ".join(w)) for i, (g, w) in enumerate(parts)], "g int, i int, text string")
    out = fingerprints.merged(fingerprints.fingerprint(rows, k=K), ["g"], K).select("g", "sketch", fingerprints.distinct_shingles(F.col("sketch"), K).alias("n"))
    got = {r.g: r for r in out.collect()}
    by_text = {r.i: (r.g, set(r.sketch)) for r in fingerprints.fingerprint(rows, k=10**6).collect()}
    for g in range(7):
        union = set().union(*(s for h, s in by_text.values() if h == g))
        assert got[g].sketch == sorted(union)[:K]
        true = len(set().union(*(shingles(w) for h, w in parts if h == g)))
        assert abs(got[g].n - true) < 5 * true / np.sqrt(K)
    empty = spark.createDataFrame([(None, ""), (None, None), (3, "a b")], "g int, text string")
    got = {r.g: r.sketch for r in fingerprints.merged(fingerprints.fingerprint(empty), ["g"]).collect()}
    assert got[None] == [] and len(got[3]) == 1
    assert fingerprints.merged(fingerprints.fingerprint(empty.limit(0)), ["g"]).collect() == []


def test_containment_and_distinct_count(spark):
    draw = np.random.default_rng(2)
    rows, truth = [], []
    for i in range(60):
        whole = [f"w{x}" for x in draw.integers(0, 10**6, 2000)]
        part = whole[: draw.integers(6, 2000)] + [f"v{x}" for x in draw.integers(0, 10**6, 300)]
        rows.append((i, " ".join(part), " ".join(whole)))
        a, b = shingles(part), shingles(whole)
        truth.append((len(a & b) / len(a), len(a & b) / len(a | b), len(a)))
    frame = fingerprints.fingerprint(fingerprints.fingerprint(spark.createDataFrame(rows, "i int, a string, b string"), "a").withColumnRenamed("sketch", "sa"), "b")
    a, b = F.col("sa"), F.col("sketch")
    out = frame.select("i", fingerprints.containment(a, b).alias("c"), fingerprints.likeness(a, b).alias("j"), fingerprints.distinct_shingles(a).alias("n")).collect()
    errors = np.array([[r.c - truth[r.i][0], r.j - truth[r.i][1], r.n / truth[r.i][2] - 1] for r in out])
    assert (np.abs(errors).mean(0) < [0.08, 0.05, 0.1]).all()
    assert (np.abs(errors).max(0) < [0.3, 0.2, 0.4]).all()
