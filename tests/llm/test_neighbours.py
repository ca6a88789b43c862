"""Vantage-point trees and sharded search against brute force, recall under relaxed pruning, and edge cases."""

import numpy as np
import pytest

from newsloom.llm import neighbours, queries
from newsloom.llm.neighbours import Tree


def brute(vectors, asked, k):
    """[(query_id, rank, vec_id, score)] over {id: array}."""
    out = []
    for q in asked:
        scores = sorted((-float(np.cumsum(vectors[q] * x)[-1]), i) for i, x in vectors.items() if i != q and len(x) == len(vectors[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<double>")


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def clustered(n, d=16, centres=12, seed=0):
    """Vectors in a few dense clusters, of different lengths."""
    draw = np.random.default_rng(seed)
    c = draw.normal(size=(centres, d))
    return (c[draw.integers(0, centres, n)] + 0.05 * draw.normal(size=(n, d))) * draw.uniform(0.9, 1.1, (n, 1))


@pytest.mark.parametrize("leaf", [2, 7, 64])
def test_a_tree_is_exact_with_factor_one(leaf):
    x, q = clustered(700), clustered(60, seed=1)
    tree = Tree(x, np.sqrt((x**2).sum(1).max()), leaf)
    a, b, score, work = tree.search(q, 5, 1.0)
    dots = q @ x.T
    for i in range(len(q)):
        mine = sorted(zip(-score[a == i], b[a == i], strict=True))[:5]
        assert [j for _, j in mine] == list(np.argsort(-dots[i], kind="stable")[:5])
    assert work < len(q) * len(x)


def test_relaxed_pruning_does_less_and_still_finds_most():
    x = clustered(4000, d=8, centres=40)
    x /= np.sqrt((x**2).sum(1))[:, None]  # of one length: else even the nearest lie apart on the sphere, and bounds are wide
    q = x[::40]
    tree = Tree(x, np.sqrt((x**2).sum(1).max()), 32)
    dots = q @ x.T
    true = [set(np.argsort(-r)[:10]) for r in dots]
    share, works = {}, {}
    for factor in (1.0, 0.5, 0.25):
        a, b, score, works[factor] = tree.search(q, 10, factor)
        got = [{j for _, j in sorted(zip(-score[a == i], b[a == i], strict=True))[:10]} for i in range(len(q))]
        share[factor] = np.mean([len(g & t) / 10 for g, t in zip(got, true, strict=True)])
    assert share[1.0] == 1.0 and share[0.5] >= 0.9
    assert works[1.0] < 0.5 * len(q) * len(x)
    assert works[0.25] < works[0.5] < works[1.0]


@pytest.mark.parametrize("shard,block", [(4096, 65_536), (50, 20)])
def test_shards_and_blocks(spark, monkeypatch, shard, block):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = clustered(600)
    vectors = dict(enumerate(x))
    given = table(spark, vectors.items())
    assert found(neighbours.nearest(given, given.where("vec_id % 7 = 0"), 6)) == brute(vectors, range(0, 600, 7), 6)


def test_copies_ties_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 8)
    nan, inf = float("nan"), float("inf")
    good = {i: np.array([1.0, 2.0]) for i in range(0, 40)}
    good |= {100 + i: np.array([1.0 + i, -1.0]) for i in range(10)} | {200: np.array([1.0, 2.0, 3.0]), 201: np.array([0.5]), 202: np.array([-1.0])}
    rows = [*good.items(), (3, good[3]), (300, None), (301, []), (302, [0.0, 0.0]), (303, [1.0, None]), (304, [nan, 1.0]), (305, [inf, 1.0]), (None, [9.0, 9.0])]
    given = table(spark, rows).selectExpr("*", "1 as x", "2 as rank", "3 as centre", "4 as score")
    asked = given.where("vec_id in (0, 3, 39, 100, 104, 200, 201, 300, 302, 304) or vec_id is null")
    assert found(neighbours.nearest(given, asked, 5)) == brute(good, (0, 3, 39, 100, 104, 200, 201), 5)


def test_empty_tables(spark):
    given = table(spark, [(1, [1.0]), (2, [2.0])])
    assert neighbours.nearest(given.limit(0), given, 3).collect() == []
    assert neighbours.nearest(given, given.limit(0), 3).collect() == []
    assert found(neighbours.nearest(given, given, 3)) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]


def test_copies_are_cut_before_the_shuffle(spark):
    given = neighbours.usable(table(spark, [(i, [1.0, 2.0]) for i in range(100)]))
    ranked = neighbours._top(given.selectExpr("x", "1D as score", "vec_id"), ["x"], 5)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    got = found(queries.QUERIES["op11_neighbours"](spark, sf))
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert got == want
