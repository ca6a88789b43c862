"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import filled, stash, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Bits of a window's hash that are given up besides those of its place: none; tests give up nearly all.
SPARE_BITS = 0


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where that condition holds (bad first), else abstains; null conditions don't hold."""

    name: str
    good: str = "false"
    bad: str = "false"


_SHARES = "100e0 * n_symbols < 1e0 * word_chars and 100e0 * n_repeat_words < 15e0 * n_words and 100e0 * n_dup_lines < 10e0 * n_lines"
#: Shares are of the text's words, lines, letters or word characters.
RULES = (
    Rule("symbols", bad="100e0 * n_symbols > 5e0 * word_chars"),
    Rule("repeats", bad="100e0 * n_repeat_words > 35e0 * n_words"),
    Rule("duplicate_lines", bad="n_lines > 3 and 100e0 * n_dup_lines > 30e0 * n_lines"),
    Rule("capitals", bad="100e0 * n_upper > 40e0 * n_letters"),
    Rule("letters", bad="100e0 * (word_chars - n_letters) > 25e0 * word_chars"),
    Rule("shouting", bad="100e0 * n_shouts > 20e0 * n_words"),
    Rule("prose", good=f"n_words >= 50 and {_SHARES}", bad="n_words < 40"),
    Rule("sentences", good="n_words >= 50 and 100e0 * (word_chars - n_letters) < 12e0 * word_chars and 100e0 * n_upper < 12e0 * n_letters"),
)


def _shift(value: Column, by: Column, left: bool = False) -> Column:
    return F.call_function("shiftleft" if left else "shiftrightunsigned", value, by)


def _window(i: Column) -> Column:
    return F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW)))


def _key(i: Column) -> Column:
    """The upper bits of the hash of the window at i, and i below them."""
    return _shift(_shift(_window(i), F.col("place_bits")), F.col("place_bits"), left=True).bitwiseOR(i.cast("long"))


def _place(key: Column) -> Column:
    return key.bitwiseAND(_shift(F.lit(1).cast("long"), F.col("place_bits"), left=True) - 1)


def _met(keys: str, own: Callable[[Column], Column]) -> Column:
    """The keys of a sorted array that agree in what ``own`` gives with the key before or after."""
    near = lambda key, other: F.coalesce(own(key) == own(other), F.lit(False))
    return F.filter(keys, lambda k, i: near(k, F.get(F.col(keys), i - 1)) | near(k, F.get(F.col(keys), i + 1)))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> counts of each whole text, computed in the JVM row by row, without a shuffle.

    Windows are sorted by hash and place in 64 bits, of which the place takes as many as the number of words needs, so that
    arrays of plain numbers are sorted. Windows whose shortened hashes meet are a superset of the repeated ones; they alone
    are sorted again, by their full 64-bit hashes: the result doesn't depend on how many bits a long text leaves.
    """
    text = filled(F.col("text"))
    base = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \t-\r]"))
    base = base.withColumn("lines", lines).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    counted = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
        (F.ceil(F.log2(F.size("w") + F.lit(2))) + SPARE_BITS).cast("int").alias("place_bits"),
        "h",
    )
    place = F.when(F.size("h") < WINDOW, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("h") - WINDOW))
    keyed = counted.withColumn("keys", F.sort_array(F.transform(place, _key)))
    short = F.transform(_met("keys", lambda k: _shift(k, F.col("place_bits"))), lambda k: _place(k).cast("int"))
    again = keyed.withColumn("keys", F.sort_array(F.transform(short, lambda i: F.struct(_window(i).alias("k"), i.cast("long").alias("p")))))
    again = again.withColumn("again", F.sort_array(F.transform(_met("keys", lambda x: x["k"]), lambda x: x["p"]))).drop("keys", "h", "place_bits")
    gaps = F.zip_with("again", F.slice("again", 2, F.greatest(F.size("again") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW).cast("long")), F.lit(WINDOW).cast("long")))
    return again.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)).drop("again")


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """A column for each rule: 1 good, -1 bad, 0 abstains."""
    return [F.expr(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end").alias(f"vote_{r.name}") for r in rules]


def estimate(patterns: dict[tuple[int, ...], int], prior: float = 0.8, rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counted vote patterns: (share of good texts, for each rule the chance of each vote given
    a good and given a bad text, posterior of each pattern).

    Votes are independent given the class; abstaining is a third vote with chances of its own, since most rules speak of one
    class only. It starts from the majority of votes (0.9 or 0.1; a draw has the prior), chances are smoothed by one
    imagined vote of each kind, and a rule's good votes are kept at least as likely under good as under bad and its bad
    votes the other way round, so that the classes cannot swap their names.
    """
    m = len(next(iter(patterns), ()))
    total = sum(patterns.values())
    weight = {x: 0.9 if sum(x) > 0 else 0.1 if sum(x) < 0 else prior for x in patterns}
    good, chances = prior, []
    for _ in range(rounds):
        mass = sum(weight[x] * n for x, n in patterns.items())
        good = (mass + 10 * prior) / (total + 10)
        chances = []
        for j in range(m):
            own = {}
            for v in (-1, 0, 1):
                seen = [(weight[x] * n, (1 - weight[x]) * n) for x, n in patterns.items() if x[j] == v]
                p, q = (sum(g for g, _ in seen) + 1) / (mass + 3), (sum(b for _, b in seen) + 1) / (total - mass + 3)
                own[v] = ((p + q) / 2,) * 2 if v * (p - q) < 0 else (p, q)
            chances.append(own)
        for x in patterns:
            log = math.log(good / (1 - good)) + sum(math.log(chances[j][v][0] / chances[j][v][1]) for j, v in enumerate(x))
            weight[x] = 1 / (1 + math.exp(-max(-60.0, min(60.0, log))))
    return good, chances, weight


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality).

    quality is the posterior probability that the text is good; kept needs it to reach ``threshold`` and base_failed to be
    false. Only the counts of vote patterns, at most 3 to the number of rules whatever the input, reach the driver; the
    estimate covers every row. Null and empty texts have no words and fail the base. Repeated rows each come back; an
    empty table gives no rows; other columns are ignored.
    """
    names = [f"vote_{r.name}" for r in rules]
    counted = stash(features(docs).select("*", *votes(rules)), "quality")
    pattern = sum((F.col(n) + 1) * 3**i for i, n in enumerate(names)).cast("int")
    coded = counted.withColumn("pattern", pattern)
    counts = {tuple((r.pattern // 3**i) % 3 - 1 for i in range(len(names))): r.n for r in coded.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    _, _, posteriors = estimate(counts)
    dense = ",".join(repr(posteriors.get(tuple(i // 3**j % 3 - 1 for j in range(len(names))), "")).strip("'") for i in range(3 ** len(names)))
    judged = coded.withColumn("quality", F.get(F.split(F.lit(dense), ",").cast("array<string>"), F.col("pattern")).cast("double"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")

