"""Density clustering of whole tables."""

import itertools
import math

import numpy as np
import pytest

from newsloom import catalog
from newsloom.operators import clustering
from oracle import SMALL


def test_clusters_span_labels(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    expected = clustering.hdbscan(np.stack([np.asarray(r.embedding, float) for r in v]))
    rows = {r.id: r.cluster for r in catalog.QUERIES["hdbscan_labels"](spark, SMALL).collect()}
    assert [rows[r.vec_id] for r in v] == expected.tolist()
    members = {}
    for r in v:
        if rows[r.vec_id] >= 0:
            members.setdefault(rows[r.vec_id], set()).add(r.label)
    assert max(map(len, members.values())) > 1


def test_blocks_agree(monkeypatch):
    x = np.random.default_rng(3).normal(size=(300, 4)) + np.repeat([[0], [9], [30]], 100, axis=0)
    whole = clustering.hdbscan(x, 5, 4)
    monkeypatch.setattr(clustering, "BLOCK_PAIRS", 1000)
    assert np.array_equal(clustering.hdbscan(x, 5, 4), whole)
    assert len(set(whole[whole >= 0])) >= 3


def test_more_vectors_than_fit_as_pairs(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=(10_001, 2)), draw.normal(size=(10_000, 2)) + 100])
    rows = spark.createDataFrame([(i, 0, p.tolist()) for i, p in enumerate(x)], "vec_id long, label int, embedding array<double>")
    out = clustering.cluster(rows, "label", min_cluster_size=4000, min_samples=5).collect()
    assert len(out) == len(x)
    assert {r.cluster for r in out if r.id <= 10_000 and r.cluster >= 0} == {0}
    assert {r.cluster for r in out if r.id > 10_000 and r.cluster >= 0} == {1}


def by_definition(x, least, samples):
    """Clusters as a set of sets: components of the mutual reachability graph under falling bounds, by all pairs."""
    n = len(x)
    d = [[math.dist(a, b) for b in x] for a in x]
    core = [sorted(row)[min(samples, n) - 1] for row in d]
    reach = lambda a, b: max(d[a][b], core[a], core[b])

    def components(members, bound):
        left, out = set(members), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                a = todo.pop()
                part.add(a)
                near = {b for b in left if reach(a, b) < bound}
                left -= near
                todo += near
            out.append(part)
        return out

    def bottleneck(members):  # the least bound that keeps them connected
        heights = sorted({reach(a, b) for a, b in itertools.combinations(members, 2)})
        low, high = 0, len(heights) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if len(components(members, math.nextafter(heights[mid], math.inf))) == 1 else (mid + 1, high)
        return heights[low]

    def grow(members, birth):
        """(mass, clusters) of a cluster born with these members, and whether it is the answer itself."""
        mass, now = 0.0, set(members)
        while True:
            h = bottleneck(now)
            rate = 1 / max(h, 1e-12)
            large = [c for c in components(now, h) if len(c) >= least]
            if len(large) > 1:
                mass += (rate - birth) * len(now)
                below = [grow(c, rate) for c in large]
                return mass, below, members
            mass += (rate - birth) * (len(now) - sum(map(len, large)))
            if not large or len(large[0]) < 2:
                return mass, [], members
            now = large[0]

    def best(tree):
        mass, below, members = tree
        picked = [best(b) for b in below]
        total = sum(m for m, _ in picked)
        return (total, [c for _, cs in picked for c in cs]) if below and total > mass else (mass, [frozenset(members)])

    if n < max(2, least):
        return set()
    return {c for b in grow(set(range(n)), 0.0)[1] for c in best(b)[1]}


def as_sets(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels[labels >= 0].tolist())}


def small(seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(60, 3)) + draw.integers(0, 3, (60, 1)) * 4
    x[50:] = x[40:50]  # copies
    return x


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("least", "samples"), [(3, 2), (5, 4), (2, 1)])
def test_density_clusters_by_definition(seed, least, samples):
    x = small(seed)
    assert as_sets(clustering.hdbscan(x, least, samples)) == by_definition(x.tolist(), least, samples)


def test_few_and_equal_rows():
    assert clustering.hdbscan(np.empty((0, 2))).tolist() == []
    assert clustering.hdbscan(np.zeros((2, 2))).tolist() == [-1, -1]
    assert clustering.hdbscan(np.ones((9, 2))).tolist() == [-1] * 9  # one cluster of all is none
    assert clustering.hdbscan(np.repeat([[0.0], [5.0]], 4, axis=0)).tolist() == [0] * 4 + [1] * 4


def test_pairs_of_blocks_agree(spark, monkeypatch):
    """Groups of several blocks, of one and of few rows, a null group, repeated vectors."""
    groups = {"large": np.concatenate([small(s) for s in range(4)]), "middling": small(7), None: small(8)[:30], "two": small(9)[:2]}
    rows = [(g, i, p.tolist()) for g, x in groups.items() for i, p in enumerate(x)]
    table = spark.createDataFrame(rows, "topic string, vec_id long, embedding array<double>")
    monkeypatch.setattr(clustering, "TILE", 40)
    monkeypatch.setattr(clustering, "FOREST_FAN", 2)
    found = {(r.group, r.id): r.cluster for r in clustering.cluster(table, "topic", min_cluster_size=4).collect()}
    assert len(found) == len(rows)
    for g, x in groups.items():
        assert [found[g, i] for i in range(len(x))] == clustering.hdbscan(x, 4).tolist()


@pytest.mark.parametrize(("least", "samples"), [(3, 2), (5, 12), (2, 1)])
def test_parts_far_apart_and_many_copies(spark, monkeypatch, least, samples):
    """Parts whose listed neighbours are all their own look for others outside; copies are one point to their neighbours."""
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(size=(60, 3)) + c for c in ([0, 0, 0], [40, 0, 0], [0, 90, 0], [40, 1, 90])])
    x = np.concatenate([x, np.repeat(x[5:6], 50, axis=0), x[100:104], draw.normal(size=(30, 3)) * 1e-4 + 7])
    x = x[draw.permutation(len(x))]
    looked, inside = [], clustering.written
    monkeypatch.setattr(clustering, "written", lambda df, name: looked.append(name) or inside(df, name))
    monkeypatch.setattr(clustering, "TILE", 40)
    monkeypatch.setattr(clustering, "FOREST_FAN", 2)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.id: r.cluster for r in clustering.cluster(table, None, min_cluster_size=least, min_samples=samples).collect()}
    assert "heard" in looked
    assert [found[i] for i in range(len(x))] == clustering.hdbscan(x, least, samples).tolist()


def test_lists_are_the_nearest(monkeypatch):
    """Both sides of two lots, strip by strip, copies of a vector and a lot with itself, against all distances."""
    monkeypatch.setattr(clustering, "STRIP", 7)
    monkeypatch.setattr(clustering, "TILE", 9)
    x = np.random.default_rng(8).normal(size=(70, 5)) + 1000
    a, b, own = (clustering.Lot(v, np.arange(len(v)), np.ones(len(v), int), 4) for v in (x[:30], x[30:], x))
    clustering.meet(a, b, True)
    clustering.meet(own, own, False)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.array_equal(a.length, np.sort(d[:30, 30:], axis=1)[:, :4])
    assert np.array_equal(b.length, np.sort(d[30:, :30], axis=1)[:, :4])
    assert np.array_equal(own.length, np.sort(d, axis=1)[:, 1:5])
    assert np.array_equal(own.other, np.argsort(d, axis=1)[:, 1:5])


def test_null_vectors_raise_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TILE", 1)
    table = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a vector is null"):
        clustering.cluster(table).collect()


def test_sequential_assignment_by_definition(spark):
    """Each vector against means taken anew of all members; what is left is clustered."""
    draw = np.random.default_rng(5)
    base = draw.normal(size=(4, 6)) * 3
    seeds = [(k, base[k].tolist(), 2 + k, "s") for k in range(3)]
    arrive = [(i, base[draw.integers(0, 4)] + draw.normal(size=6) * 0.7) for i in range(80)]
    members = {k: [np.array(c)] * n for k, c, n, _ in seeds}
    expected, left = {}, []
    for i, x in arrive:
        scores = {k: float(np.mean(m, 0) @ x / (np.linalg.norm(np.mean(m, 0)) * np.linalg.norm(x))) for k, m in members.items()}
        k = max(scores, key=lambda k: (scores[k], -k))
        if scores[k] >= 0.8:
            members[k].append(x)
            expected[i] = (k, round(scores[k], 9))
        else:
            left.append(i)
    places = dict(arrive)
    for number, group in enumerate(sorted(map(sorted, by_definition([places[i].tolist() for i in left], 3, 2)))):
        expected |= {left[p]: (3 + number, 0.0) for p in group}
    expected |= {i: (-1, 0.0) for i in left if i not in expected}
    new = spark.createDataFrame([(i, x.tolist(), "s") for i, x in arrive], "id long, embedding array<double>, topic string").selectExpr("*", "timestamp_ntz'2024-01-01' as ts")
    old = spark.createDataFrame(seeds, "cluster long, centroid array<double>, size long, topic string")
    out = clustering.update_clusters(new, old, "topic", 0.8).collect()
    assert left
    assert {r.id: (r.cluster, round(r.similarity, 9)) for r in out} == expected


def test_what_joins_none_is_clustered_by_lots(spark, monkeypatch):
    """Left vectors are numbered in order of arrival, on from the greatest cluster of their part, by whatever way they are clustered."""
    draw = np.random.default_rng(12)
    x = draw.normal(size=(90, 4)) + np.repeat([[9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0]], 30, axis=0)
    rows = [(i, p.tolist(), f"s{i % 2}", int(t)) for i, (p, t) in enumerate(zip(x, draw.permutation(90), strict=True))]
    new = spark.createDataFrame(rows, "id long, embedding array<double>, topic string, t int").selectExpr("*", "timestamp_ntz'2024-01-01' + make_dt_interval(t) as ts")
    old = spark.createDataFrame([(5, [9.0, 0.0, 0.0, 0.0], 2, "s0")], "cluster long, centroid array<double>, size long, topic string")
    monkeypatch.setattr(clustering, "TILE", 10)
    lots, run = [], clustering._cluster_lots
    monkeypatch.setattr(clustering, "_cluster_lots", lambda *a: lots.append(a) or run(*a))
    found = {r.id: (r.cluster, r.similarity) for r in clustering.update_clusters(new, old, "topic", 0.7).collect()}
    assert lots
    assert len(found) == 90
    assert {i % 2 for i, (c, _) in found.items() if c == 5 and found[i][1] > 0} == {0}
    for part, top in ((0, 6), (1, 0)):
        left = sorted((i for i, (_, s) in found.items() if i % 2 == part and s == 0), key=lambda i: (rows[i][3], i))
        labels = clustering.hdbscan(x[left])
        assert labels.max() > 0
        assert [found[i][0] for i in left] == [top + k if k >= 0 else -1 for k in labels.tolist()]
