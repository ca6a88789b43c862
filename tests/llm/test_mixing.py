"""Pareto order sampling: inclusion frequencies, sizes, repeated rows."""

import math
import random
from collections import defaultdict

import pytest

from newsloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_expected(sizes, target, limit=mixing.MAX_COPIES):
    """Copies that each size may expect, by bisection."""
    gain = {s: 2 ** (math.floor(mixing.CLASSES * math.log2(s)) * mixing.PREFER / mixing.CLASSES) for s in sizes}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * min(limit, mid * gain[s]) for s in sizes) < target else (low, mid)
    return {s: min(limit, low * gain[s]) for s in sizes}


def test_inclusion_frequencies(spark):
    """600 sources of equal documents, 200 of each weight: as many draws, for eight documents of a size each."""
    sizes = [*range(5, 35), 60, 90, 140, 200]
    rows = [(1000 * s + i, "w " * n, f"s{s:03d}") for s in range(600) for i, n in enumerate(sizes * 8)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    copies, targets = defaultdict(list), {}
    for r in out:
        group = int(r.source[1:]) % 3
        copies[group, r.size].append(r.copies)
        targets.setdefault(group, r.target)
    for group, target in targets.items():
        wanted = brute_expected(sizes * 8, target)
        for size in sizes:
            drawn, p = copies[group, size], wanted[size] % 1
            assert len(drawn) == 1600
            assert set(drawn) <= {math.floor(wanted[size] + 1e-9), math.floor(wanted[size] + 1e-9) + 1}
            # 4.5 standard errors, and what cutting by whole documents may shift
            assert abs(sum(drawn) / 1600 - wanted[size]) < 4.5 * math.sqrt(p * (1 - p) / 1600) + 0.02, (group, size)
    # longer documents are likelier
    assert sum(copies[1, 200]) > sum(copies[1, 5])


def test_fixed_size(spark):
    draw = random.Random(6)
    rows = [(i, "w " * draw.choice((3, 20, 50, 400)), draw.choice("aabc")) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(frame).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 200 for s in target)  # half the longest document
    assert sorted(out) == sorted(mixing.mix(frame.repartition(7)).collect())
    assert sorted(out) != sorted(mixing.mix(frame, seed=1).collect())


def test_a_row_repeated_a_million_times(spark):
    """Equal rows have one rank; so many of them are taken as the target lacks, and they are written in pieces."""
    hot = spark.range(1_000_000).selectExpr("7L as doc_id", "'one two three' as text", "'a' as source")
    rest = spark.range(1000).selectExpr("100 + id as doc_id", "'one two three four' as text", "'b' as source")
    out = mixing.mix(hot.unionByName(rest))
    got = {r.source: r for r in out.groupBy("source").agg({"taken": "sum", "target": "max", "*": "count", "copies": "max"}).collect()}
    assert got["a"]["count(1)"] == 1_000_000
    assert got["b"]["count(1)"] == 1000
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 2 for r in got.values())
    copied = mixing.copies(hot.unionByName(rest)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in copied} == {"a": got["a"]["sum(taken)"] // 3, "b": got["b"]["sum(taken)"] // 4}


@pytest.mark.parametrize("n", [0, 1, 7, 2000])
def test_targets_of_many_sources(spark, n):
    draw = random.Random(n)
    sizes = [(f"s{i}" if i else None, draw.choice((0, 1, 10, 100, 10_000)), 1) for i in range(n)]
    order = sorted((s for s, _, _ in sizes), key=lambda s: (s is None, s or ""))
    weight, size = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: w for s, w, _ in sizes}
    target, left, free = {}, float(sum(size.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left, free = left - sum(3 * size[s] for s in over), free - over
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long, n long")).collect()}
    assert got == {s: pytest.approx(t, rel=1e-9, abs=1e-9) for s, t in target.items()}
