"""Language by cross-parsing: lanes against a brute-force parse, the whole query against a brute-force predictor."""

import math
import random
from collections import defaultdict

import numpy as np
from oracle import SMALL

from newsloom.llm import language, queries

MEDIUM = "/root/testdata/sf0.01"


def brute_phrases(taught: bytes, text: bytes, block: int) -> int:
    """Longest substrings of taught, from left to right, one byte at least, cut at multiples of block."""
    at = n = 0
    while at < len(text):
        end, stop = at + 1, min(len(text), (at // block + 1) * block)
        while end < stop and text[at : end + 1] in taught:
            end += 1
        at, n = end, n + 1
    return n


def test_lanes_count_as_brute_force_does():
    draw = random.Random(2)
    some = lambda k, most: bytes(draw.choices(b"abcd ", k=draw.randint(k, most)))
    for block in (7, 64):
        taught = [some(20, 60).decode() for _ in range(3)]
        parser = language.Parser(language.Model(("a", "b", "c"), tuple(taught)), block)
        texts = [b"zz", b"a", *(some(1, 200) + b"xy" for _ in range(60))]
        for text, counts in zip(texts, parser.count(texts).tolist(), strict=True):
            assert counts == [brute_phrases(t.encode(), text, block) for t in taught]
            assert counts[0] == language.phrases(language.automaton(taught[0].encode()), text, block)


def test_every_document_as_a_brute_force_predictor_says(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    taught = spark.read.parquet(f"{SMALL}/documents.parquet").where(~language.held_out(language.F.col("doc_id")))
    model = language.fit(taught)
    texts = [t.encode() for t in model.texts]
    for r in queries.op5_language(spark, SMALL).collect():
        text = docs[r.doc_id].text
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        # every run of letters in lower case, one blank before, between and after
        bare = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        cost = [brute_phrases(t, f" {bare} ".encode(), language.BLOCK) * math.log2(len(t) + 2) for t in texts]
        assert r.lang_pred == model.languages[int(np.argmin(cost))]


def test_automata_hold_running_text(spark):
    """Words stand in the automaton's text in the order in which sampled texts have them."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    by = defaultdict(list)
    for r in docs.where("lang is not null").collect():
        by[r.lang].append(language.plain(r.text or ""))
    model = language.fit(docs)
    draw = random.Random(7)
    for name, text in zip(model.languages, model.texts, strict=True):
        assert len(text) > 0.8 * language.SAMPLE_CHARS
        whole, words, ordered = "\n".join(by[name]), text.split(), 0
        for at in (draw.randrange(len(words) - 3) for _ in range(60)):
            ordered += " ".join(words[at : at + 3]) in whole
        assert ordered > 50


def test_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs.where(~language.held_out(language.F.col("doc_id"))))
    held = docs.where(language.held_out(language.F.col("doc_id")) & language.F.col("lang").isNotNull()).select("lang", "text").collect()
    parser = language.Parser(model)
    least = {1: 0.88, 2: 0.97, 5: 0.99, 10**9: 0.995}
    for words, share in least.items():
        cut = [(r.lang, " ".join(language.plain(r.text).split()[:words])) for r in held if r.text and language.plain(r.text).strip()]
        got = parser.predict([t for _, t in cut], model.languages)
        assert np.mean([g == lang for (g, _), (lang, _) in zip(got, cut, strict=True)]) >= share


def test_word_order_tells_languages_apart(spark):
    words = ("one", "two", "three", "four", "five", "six")
    there, back = " ".join(words), " ".join(reversed(words))
    rows = [(i, f"{t} {t} {t}", lang) for i, (t, lang) in enumerate([(there, "aa"), (back, "bb")])]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "two three four five"), (2, "five four three two")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()} == {1: "aa", 2: "bb"}
