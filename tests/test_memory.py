"""Answers that are kept: how often a generator is called, and what is left when a job dies."""

import uuid
from collections import Counter
from pathlib import Path

import pytest
from newsloom.operators import generation
from newsloom.operators.memory import Remembered
from newsloom.sources.store import Store


def noting(at, dies=()):
    """A generator that notes its calls in files, as calls run in other processes."""
    at = str(at)

    def generate(prompt):
        Path(at, f"{uuid.uuid4().hex}").write_text(prompt)
        if prompt in dies:
            raise SystemExit("the worker is killed")
        if prompt.startswith("bad"):
            raise ValueError("overloaded")
        if prompt.startswith("null"):
            return None
        return f'{{"stance": "{prompt[-5:]}"}}'

    return generate


def calls(at):
    return Counter(p.read_text() for p in at.iterdir())


@pytest.fixture
def at(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def prompts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "prompt string")


def test_equal_prompts_make_one_call(spark, tmp_path, at):
    memory = Remembered(noting(at), str(tmp_path / "store"), tasks=3)
    got = memory.ask(prompts(spark, "a", "a", "b", None, "a"))
    assert got.count() == 2 and calls(at) == {"a": 1, "b": 1}
    memory.ask(prompts(spark, "b", "c")).count()
    assert calls(at) == {"a": 1, "b": 1, "c": 1}
    assert memory.ask(prompts(spark)).count() == 3


def test_failures_are_tried_and_kept(spark, tmp_path, at):
    memory = Remembered(noting(at), str(tmp_path / "store"), tries=2, tasks=2)
    got = {(r.response, r.error, r.tries) for r in memory.ask(prompts(spark, "bad", "ok", "null")).collect()}
    assert got == {(None, "ValueError: overloaded", 2), ('{"stance": "ok"}', None, 1), (None, "no answer", 1)}
    memory.ask(prompts(spark, "bad", "ok"))
    assert calls(at) == {"bad": 2, "ok": 1, "null": 1}
    again = Remembered(lambda p: "mended", str(tmp_path / "store"), retry_failed=True, tasks=2)
    assert sorted(r.response for r in again.ask(prompts(spark, "bad", "ok", "null")).collect()) == ["mended", "mended", '{"stance": "ok"}']


def test_a_job_that_dies_repeats_no_stored_call(spark, tmp_path, at):
    texts = [f"text {i}" for i in range(40)]
    last = Remembered(noting(at, dies=texts), str(tmp_path / "store"), at_once=10, tasks=2)
    good = Remembered(noting(at), str(tmp_path / "store"), at_once=10, tasks=2)
    good.ask(prompts(spark, *texts[:25]))
    stored = Store(spark, str(tmp_path / "store")).read("answers").count()
    with pytest.raises(Exception, match="killed|exited|crashed|SystemExit"):
        last.ask(prompts(spark, *texts))
    tried = calls(at)
    assert all(tried[t] == 1 for t in texts[:25]) and stored == 25
    assert good.ask(prompts(spark, *texts)).where("response is not null").count() == 40
    assert all(calls(at)[t] == 1 for t in texts[:25])
    assert all(calls(at)[t] == tried[t] + 1 for t in texts[25:])


def test_labels_come_from_the_memory(spark, tmp_path, at):
    posts = spark.createDataFrame([(1, "mixed"), (2, "mixed"), (3, "other")], "cluster_id int, posts string")
    memory = Remembered(noting(at), str(tmp_path / "store"), tasks=2)
    for _ in range(2):
        assert {r.cluster_id: r.stance for r in generation.stance(posts, memory).collect()} == {1: "mixed", 2: "mixed", 3: "other"}
    assert sum(calls(at).values()) == 2
    named = generation.names(posts.selectExpr("*", "array('red', 'fox') as keywords"), Remembered(lambda p: "bad"[9:], str(tmp_path / "n")))
    assert {r.name for r in named.collect()} == {"Coordinated Red Fox Campaign"}
