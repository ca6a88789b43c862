"""Near words through the errata trie against all pairs, long words, light entries, and the query's own rules."""

import random
import re
import zlib
from collections import Counter
from math import log2

import pytest

from newsloom.llm import queries, spelling


def near(u, v):
    """Whether one inserted, deleted or replaced code point turns u into v."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts, ratio=10):
    out = {}
    by = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(by[w]), None if form[w] is None else counts[form[w]])
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("seed,letters,longest,size", [(1, "ab", 7, 120), (2, "aé\U0001f600", 5, 150), (3, "abcdefg", 4, 300), (4, "a", 90, 60)])
def test_words_against_all_pairs(spark, seed, letters, longest, size):
    draw = random.Random(seed)
    counts = {"".join(draw.choices(letters, k=draw.randint(1, longest))): 10 ** draw.randint(0, 4) for _ in range(size)}
    assert found(spelling.variants(table(spark, counts))) == brute(counts)


def test_words_beyond_the_trie(spark):
    draw = random.Random(5)
    counts = {}
    for length in (62, 63, 64, 65, 66, 130, 5000):
        base = "".join(draw.choices("abc", k=length))
        for i in (0, 1, length // 2, length - 1):
            counts |= {base: 500, base[:i] + "x" + base[i + 1 :]: 50, base[:i] + base[i + 1 :]: 3, base[:i] + "y" + base[i:]: 7}
    counts |= {"q" * n: 2 for n in (64, 65, 66, 67)}
    assert found(spelling.variants(table(spark, counts))) == brute(counts)


def test_light_entries_are_logarithmic(spark):
    counts = {format(i, "012b").replace("0", "a").replace("1", "b"): 2 for i in range(0, 4096, 3)}
    entries = spelling.light_entries(table(spark, counts)).groupBy("word").count().agg({"count": "max"}).first()[0]
    assert entries <= log2(len(counts))


def test_chains_ties_and_repeats(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10**4, "zzz": 3, "zzy": 30, "zzx": 30}
    got = found(spelling.variants(table(spark, counts)))
    assert got == brute(counts)
    assert got["aaaaaaa"][1] == "aaabbbb" and got["zzz"][0] == "zzx"
    rows = [("abc", 2), ("abc", 3), (None, 9), ("", 4), ("abd", None), ("ab", 0)]
    given = spark.createDataFrame(rows, "word string, n long").selectExpr("*", "1 as key", "2 as root", "3 as less")
    assert found(spelling.variants(given)) == brute({"abc": 5, "abd": 0, "ab": 0})
    assert spelling.variants(given.limit(0)).collect() == []
    with pytest.raises(ValueError, match="circle"):
        spelling.variants(given, ratio=1)


def typed(docs):
    """The query's words, by its contract alone."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_marked_runs(spark):
    docs = [(1, None), (2, ""), (3, "Straße ÀÉtranger x×÷yzabcd"), (4, "Ordinary ordinary words"), (4, "Ordinary ordinary words"), (None, "nothing nothing"), (5, "long" * 40_000), (6, "long" * 40_000)]
    docs += [(i, "ordinary surrounding ÀÉtranger") for i in range(10, 200)]
    given = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as sign")
    words = spelling.vocabulary(spelling.marked_runs(given, 31))
    assert {r.word: r.n for r in words.collect()} == typed(docs)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    counts = typed((r.doc_id, r.text) for r in docs)
    got = found(queries.QUERIES["op13_spelling"](spark, sf))
    assert {w: r[2] for w, r in got.items()} == counts
    some = sorted(counts)[::37]
    for w in some:
        others = [v for v in counts if near(w, v)]
        assert got[w][3] == len(others)
