"""Quality rules: exact counts of repetitive and very long texts, and expectation-maximisation row by row."""

import math
import random
from collections import Counter, defaultdict

from newsloom.llm import quality

SCHEMA = "doc_id long, text string"


def brute_repeats(words):
    windows = defaultdict(list)
    for at in range(len(words) - 2):
        windows[tuple(words[at : at + 3])].append(at)
    return len({at + k for places in windows.values() if len(places) > 1 for at in places for k in range(3)})


def test_repeats_of_few_words(spark):
    draw = random.Random(8)
    texts = [draw.choices("abcde", k=draw.randint(0, 60)) for _ in range(300)] + [["a"] * 5000, ["a", "b"] * 3000]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.n_repeat_words for r in quality.features(rows).collect()} == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_hashes_short_of_bits(spark, monkeypatch):
    """With next to no bits of the hash left, candidates are many and the result is the same."""
    draw = random.Random(9)
    texts = [[f"w{draw.randrange(60)}" for _ in range(400)] for _ in range(20)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(quality, "SPARE_BITS", 46)
    got = {r.doc_id: r.n_repeat_words for r in quality.features(rows).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_millions_of_words(spark):
    one = spark.range(1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 8000000), i -> conv(i, 10, 36)), ' ') as text")
    two = spark.range(1).selectExpr("1L as doc_id", "array_join(transform(sequence(1, 2000000), i -> conv(i, 10, 36)), ' ') as text").selectExpr("doc_id", "text || ' 1 2 3 4' as text")
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.features(one.unionByName(two)).select("doc_id", "n_words", "n_repeat_words").collect()}
    assert got == {0: (8_000_000, 0), 1: (2_000_004, 8)}


def brute_em(rows, prior=0.8, rounds=50):
    """Over single rows; the same start, smoothing and constraint."""
    weight = [0.9 if sum(r) > 0 else 0.1 if sum(r) < 0 else prior for r in rows]
    for _ in range(rounds):
        mass = sum(weight)
        good = (mass + 10 * prior) / (len(rows) + 10)
        chance = []
        for j in range(len(rows[0])):
            own = {}
            for v in (-1, 0, 1):
                p = (sum(w for w, r in zip(weight, rows, strict=True) if r[j] == v) + 1) / (mass + 3)
                q = (sum(1 - w for w, r in zip(weight, rows, strict=True) if r[j] == v) + 1) / (len(rows) - mass + 3)
                own[v] = ((p + q) / 2, (p + q) / 2) if (v == 1 and p < q) or (v == -1 and p > q) else (p, q)
            chance.append(own)
        for i, r in enumerate(rows):
            log = math.log(good / (1 - good)) + sum(math.log(chance[j][v][0] / chance[j][v][1]) for j, v in enumerate(r))
            weight[i] = 1 / (1 + math.exp(-max(-60.0, min(60.0, log))))
    return weight


def test_posteriors_against_brute_force():
    draw = random.Random(10)
    rows = []
    for _ in range(500):
        good = draw.random() < 0.7
        rows.append(tuple((1 if draw.random() < (0.9 if good else 0.2) else -1) if draw.random() < 0.6 else 0 for _ in range(4)))
    _, chances, posterior = quality.estimate(dict(Counter(rows)))
    for r, w in zip(rows, brute_em(rows), strict=True):
        assert math.isclose(posterior[r], w, rel_tol=1e-6, abs_tol=1e-9)
    assert all(c[1][0] >= c[1][1] and c[-1][0] <= c[-1][1] for c in chances)
