"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns with clashing names."""

import pytest

from newsloom.llm import chat, fingerprints, language, mixing, packing, pii, quality, queries, simhash, toxicity, urls

LONG = "word " * 60_000
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "\U0001f600 Ünïcode, mail a@b.org now", "de", "a"),
    (4, "\U0001f600 Ünïcode, mail a@b.org now", "de", "a"),
    (5, LONG, "en", "b"),
    (6, "x" * 300_000, "en", "b"),
    (None, "a row without an id", "en", None),
    (7, "a row without an id", None, "b"),
]
CLASHING = ("b", "ghost", "w", "h", "fp", "base", "found", "rank", "size", "n", "target", "score", "lang_pred", "copies", "u", "key", "part", "row", "kept", "sketch", "component_id")


def docs(spark, rows=ROWS):
    plain = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return plain.selectExpr("*", *(f"'clash' as {c}" for c in CLASHING))


OPERATORS = {
    "fingerprints": lambda spark, d: fingerprints.edited_fingerprints(d),
    "quality": lambda spark, d: quality.judge_quality(d),
    "toxicity": lambda spark, d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))),
    "language": lambda spark, d: language.identify(d, language.fit(d)),
    "pii": lambda spark, d: pii.report(d, pii.fit(spark)),
    "redaction": lambda spark, d: pii.redact(d, pii.fit(spark)),
    "mixing": lambda spark, d: mixing.mix(d),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "urls": lambda spark, d: urls.filter_urls(d.selectExpr("*", "text as url"), queries.URL_RULES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_a_result(spark, name):
    rows = OPERATORS[name](spark, docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark).limit(0)).collect() == []


def test_packing(spark):
    pieces = packing.pack(docs(spark), queries.tokenizer_text())
    held = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    times = {i: sum(r[0] == i for r in ROWS) for i in {r[0] for r in ROWS}}
    assert {r[0] for r in held} == set(times)
    assert all(r["sum(length)"] == times[r[0]] * r["max(doc_tokens)"] for r in held)
    assert packing.pack(docs(spark).limit(0), queries.tokenizer_text()).collect() == []


def test_copies_keep_columns(spark):
    out = mixing.copies(docs(spark))
    assert out.columns == docs(spark).columns
    assert {r.doc_id for r in out.collect()} >= {1, 2, 3}
    assert mixing.copies(docs(spark).limit(0)).collect() == []


def test_language_without_letters(spark):
    model = language.fit(docs(spark))
    given = spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language.identify(given, model).collect()} == {("und", 0.0)}


def test_texts_without_words_are_linked(spark):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark)).collect()}
    assert [found[i].component_id for i in (1, 2, 3)] == [1, 1, 1]
    assert found[2].fingerprint == "0" * 16


def test_toxic_seeds_decide_without_labels(spark):
    d = docs(spark)
    model = toxicity.fit(d, d.limit(0).selectExpr("doc_id", "1 as toxic"))
    given = spark.createDataFrame([(1, f"you {toxicity.SEEDS[0]}"), (2, "a calm text"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.5 for r in toxicity.score(given, model).collect()} == {1: True, 2: False, 3: False}


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (None, 0, "user", "y"), (None, 1, "assistant", LONG), (3, 0, "user", "same"), (3, 0, "user", "same")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.conversations(chat.chain(given))).collect()}
    assert {i: r.n_turns for i, r in out.items()} == {1: 2, 2: 1, None: 2, 3: 2}
    assert {i: r.loss_chars for i, r in out.items()} == {1: 0, 2: 0, None: len(LONG), 3: 0}
    assert chat.digests(chat.conversations(chat.chain(given.limit(0)))).collect() == []


def test_a_cycle_of_replies_raises(spark):
    given = spark.createDataFrame([("t", 0, 1, 0.0), ("t", 1, 0, 0.0)], "tree string, node long, parent long, score double")
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(given).collect()
