"""Labelling by an injected generator, against values worked out by hand."""

import json
import random
import re

import pytest

from newsloom.operators import generation
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, i, f"text {i} " + "x" * 400) for i in range(12)] + [(2, 0, None), (2, 1, "short")]
    return spark.createDataFrame(rows, "cluster_id int, ord int, text string")


@pytest.fixture(scope="module")
def clusters(spark):
    rows = [(1, 12, 3, 4.0, 0.5), (2, 2, 2, 1.0, 0.1), (3, 0, 0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "cluster_id int, size int, unique_authors int, coordination_ratio double, semantic_coherence double").selectExpr("*", "timestamp '2024-01-01 08:00:00' AS window_start", "timestamp '2024-01-01 12:30:00' AS window_end")


def test_excerpts(docs):
    out = {r.cluster_id: r.posts.split("\n") for r in generation.excerpts(docs).collect()}
    assert out[1] == [f"[Post {i + 1}]: " + (f"text {i} " + "x" * 400)[:300] for i in range(10)]
    assert out[2] == ["[Post 1]: ", "[Post 2]: short"]


@pytest.mark.parametrize(
    ("text", "found"),
    [('{"a": 1}', {"a": 1}), ('so: {"a": {"b": 2}} end', {"a": {"b": 2}}), ('{"a": 1} x {"b": 2}', None), ("[1]", None), ("", None), (None, None), ("no", None), (' {"a":\n1} ', {"a": 1}), ("{a}", None)],
)
def test_json_object(spark, text, found):
    got = spark.createDataFrame([(text,)], "t string").select(generation.json_object(F.col("t"))).first()[0]
    assert (json.loads(got) if got else None) == found


def as_python_reads(text):
    block = re.search(r"\{.*\}", text, re.DOTALL)
    try:
        return block and isinstance(json.loads(block.group()), dict) and block.group() or None
    except ValueError:
        return None


def test_json_object_is_what_python_takes_for_one(spark):
    draw = random.Random(5)
    seeds = ['{"a": [1, 2.50, -3e+5, true, null], "b": {"c": "x \\" y \\u00e9 \\\\", "d": []}, "e": "{}[],:"}', '{"stance": "mixed", "emotions": {"anger": 0.5, "fear": -0}, "n": NaN, "m": -Infinity}', "{}"]
    parts = [*'{}[],:"\\ \t\n0123456789.-+eE', "NaN", "Infinity", "INF", "+INF", "true", "nul", "'", "/**/", '"a": 1, ', "é", "\u2028", "\x01", "\ufeff", " }", "{ ", "]}"]
    texts = ['{"a": 1, "a": 2}', '{"a": -INF}', '{"a": "INF +I"}', '{"a": 1}]}', '{"a": 1}, "x"}', '{"a": 1e400}', '{"a": "' + "\\\\" * 50_000 + '"}', "{'a': 1}", '{"a": 01}']
    for _ in range(3000):
        text = draw.choice(seeds)
        for _ in range(draw.randint(1, 3)):
            i = draw.randint(0, len(text))
            text = text[:i] + draw.choice(("", draw.choice(parts))) + text[i + draw.randint(0, 2) :]
        texts.append(text)
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(generation.json_object(F.col("t"))).collect()]
    want = list(map(as_python_reads, texts))
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert 300 < sum(w is not None for w in want) < 2700


def test_a_name_that_comes_twice_counts_as_python_counts_it(spark):
    posts = spark.createDataFrame([(1, "x")], "cluster_id int, posts string")
    assert generation.stance(posts, lambda p: '{"stance": "mixed", "stance": "neutral", "emotions": {"joy": 1, "joy": 0.5}}').first()[1:3] == ("neutral", {"joy": 0.5})


def test_only_the_generator_needs_a_python_worker(spark):
    said = spark.createDataFrame([("x",)], "response string").select(generation.json_object(F.col("response")))
    assert "Python" not in said._jdf.queryExecution().executedPlan().toString()


def test_claims_and_stance(spark):
    posts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "wrong")], "cluster_id int, posts string")

    def say(prompt):
        if prompt.endswith("good"):
            return 'Here: {"templates": [{"template": "X is Y", "frequency": 4}, {"template": ""}, {"claim_type": "hoax"}], "stance": "mixed", "emotions": {"anger": 0.5}}'
        return "I cannot" if prompt.endswith("bad") else '{"templates": "none", "stance": null}'

    out = {r.cluster_id: [tuple(t) for t in r.claim_templates] for r in generation.claims(posts, say).collect()}
    assert out == {1: [("X is Y", "unknown", 4)], 2: [], 3: []}
    felt = {r.cluster_id: (r.stance, r.emotions, r.manipulation_indicators) for r in generation.stance(posts, say).collect()}
    assert felt == {1: ("mixed", {"anger": 0.5}, []), 2: ("unknown", {}, []), 3: ("unknown", {}, [])}


def test_assessment_of_every_cluster(docs, clusters):
    def say(prompt):
        if "12 texts of 3 authors, ratio 4.00, coherence 0.50, 2024-01-01 08:00 to 12:30" in prompt:
            return json.dumps({"risk_level": "high", "confidence": 0.9, "indicators": ["same words"], "posts": prompt.count("[Post ")})
        return "no"

    out = {r.cluster_id: tuple(r)[1:] for r in generation.assess(clusters, docs, say).collect()}
    assert out == {1: ("high", 0.9, ["same words"], [], ""), 2: ("unknown", 0.0, [], [], ""), 3: ("unknown", 0.0, [], [], "")}
    whole = {r.cluster_id: r for r in generation.label_clusters(clusters, docs, say).collect()}
    assert set(whole) == {1, 2, 3}
    assert whole[1].coordination_assessment.risk_level == "high" and whole[3].claim_templates == [] and whole[3].stance_emotion.stance == "unknown"
    assert generation.label_clusters(clusters, docs, say, with_claims=False, with_stance=False).columns == ["cluster_id", "coordination_assessment"]


def test_explanations(spark):
    rows = spark.createDataFrame([("a", "burst", "high", 9, 3, 3.0, 0.25, ["e" * 300] * 7), ("b", "burst", "low", 1, 1, 1.0, None, None)], "alert_id string, alert_type string, severity string, cluster_size int, unique_authors int, coordination_ratio double, duplicate_burst_score double, evidence array<string>")
    out = {r.alert_id: r.explanation for r in generation.explain(rows, lambda p: p).collect()}
    assert out["a"].count("- " + "e" * 200 + "...") == 5 and "duplicates 25%" in out["a"]
    assert "duplicates 0%" in out["b"]


def test_names(spark):
    rows = [(1, "ok", ["a", "b"]), (2, "long", ["buy", "$gme"]), (3, "fail", ["red", "fox"]), (4, "tiny", ["one"])]
    posts = spark.createDataFrame(rows, "cluster_id int, posts string, keywords array<string>")

    def say(prompt):
        if prompt.endswith("fail"):
            raise ValueError("no answer")
        return {"ok": ' "Push to hold" \n', "long": "x" * 100, "tiny": "five5"}[prompt.split("\n\n")[-1]]

    out = {r.cluster_id: r.name for r in generation.names(posts, say).collect()}
    assert out == {1: "Push to hold", 2: "Buy Campaign for $GME", 3: "Coordinated Red Fox Campaign", 4: "Unclassified Coordination Pattern"}
