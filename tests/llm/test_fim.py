"""Ropes against strings, fill-in-middle against a plain version, and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import fim, queries

TEXTS = st.text(alphabet="ab\n\r é\U0001f600<PSM>", max_size=60)


def height_ok(rope):
    if rope.left is None:
        return True
    return abs(rope.left.height - rope.right.height) <= 2 and height_ok(rope.left) and height_ok(rope.right)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS, st.integers(0, 70), st.integers(1, 5))
def test_ropes_split_and_join_as_strings(a, b, at, leaf):
    lines = re.findall(fim.LINES, a)
    rope = fim.Rope.of(a, fim.LINES, leaf)
    assert (rope.units, rope.chars, str(rope)) == (len(lines), len(a), a)
    left, right = rope.split_units(at)
    assert (str(left), str(right)) == ("".join(lines[:at]), "".join(lines[at:]))
    assert left.units == min(at, len(lines))
    left, right = rope.split_chars(at)
    assert (str(left), str(right)) == (a[:at], a[at:])
    both = rope.joined(fim.Rope.of(b, fim.LINES, leaf))
    assert (str(both), both.chars) == (a + b, len(a) + len(b))
    assert height_ok(both)


def test_many_splits_keep_ropes_low():
    text = "".join(f"line {i}\n" for i in range(20_000))
    rope = fim.Rope.of(text, fim.LINES, 16)
    for i in range(200):
        left, right = rope.split_units(97 * i % 20_000)
        rope = right.joined(left)
    assert rope.chars == len(text) and rope.units == 20_000
    assert rope.height <= 30


def plain(doc_id, text):
    """The contract, with strings alone."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ROWS = [(1, None), (2, ""), (3, "\n"), (4, "a"), (5, "a\n\nb\r\nc"), (5, "a\n\nb\r\nc"), (6, "has <M> in it\n"), (7, "\U0001f600\né" * 50), (8, "long line " * 30_000), (9, "l\n" * 100_000), (10, "\n\n\n"), (11, "<P\n>")]


def test_small_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'clash' as n", "1 as form", "2 as output", "3 as Restored", "4 as `a.b`")
    out = fim.restore(fim.transform(docs))
    assert [c for c in out.columns if c.lower() in ("n", "form", "output", "restored")] == ["n", "form", "output", "restored"]
    found = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect() if r.form != "plain")
    assert found == sorted((i, *plain(i, t), t or "") for i, t in ROWS if plain(i, t)[1] != "plain")
    assert {(r.doc_id, r.prefix_chars, r.restored) for r in out.where("form = 'plain'").collect()} == {(1, None, ""), (2, None, ""), (6, None, "has <M> in it\n")}
    assert out.limit(0).collect() == []
    assert fim.restore(fim.transform(docs.limit(0))).collect() == []


def test_a_null_id_and_null_output(spark):
    out = fim.transform(spark.createDataFrame([(None, "a\nb\n")], "doc_id long, text string")).collect()
    assert out[0].output == plain("", "a\nb\n")[4]
    made = spark.createDataFrame([(None, "psm"), ("x", None), ("x", "plain")], "output string, form string")
    assert [r.restored for r in fim.restore(made).collect()] == [None, None, "x"]


def test_rate_and_other_units(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'some text' as text")
    out = fim.transform(docs, rate=40, spm=0, unit=fim.CHARS)
    forms = {r.form: r["count"] for r in out.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 110 < forms["psm"] < 210
    assert {r.n for r in out.select("n").distinct().collect()} == {9}
    assert {r.restored for r in fim.restore(out).collect()} == {"some text"}


def test_a_missing_sentinel_raises(spark):
    with pytest.raises(Exception, match="substring not found"):
        fim.restore(spark.createDataFrame([("<P>ab<M>c", "psm")], "output string, form string")).collect()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_fim"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, output = plain(r.doc_id, docs[r.doc_id])
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(docs[r.doc_id] or ""))
