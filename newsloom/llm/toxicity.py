"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import id_text, stash, uniform

#: Rows of each class that a fit samples.
SAMPLE_ROWS = 10_000
#: Least toxic texts with a learned term, least log odds and least likelihood ratio of one.
LEAST_TEXTS, LEAST_WEIGHT, LEAST_RATIO = 3, 2.0, 15.0
#: Lengths of word beginnings that are learned as well as words, written with a star; inflected words share them.
STEMS = (4, 5, 6, 7)
MOST_WEIGHT = 6.0
#: Insults known beforehand, all of weight SEED_WEIGHT.
SEEDS = ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "bastard", "asshole", "bitch", "shithead", "dumbass")
SEED_WEIGHT = 4.0
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "sore loser", "stupid simple", "idiot proof", "pathetic fallacy")
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгдезикмнорстухіјѕԁԛԝһαβγεηικνορτυχωıℓ", "a6brдe3иkmhopctyxijsdqwhabyenikvoptuxwil", strict=True))
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_TOKEN = re.compile(r"[^\W_]+")
_MATCHERS: dict[int, Matcher] = {}


def _table() -> dict[int, str | None]:
    """Folding of single characters: Latin letters to their base letter, full-width forms to ASCII, look-alikes to Latin,
    digits to letters, l to i (both are written 1), invisible characters to nothing, and all that parts words to a blank."""
    table: dict[int, str | None] = {c: " " for c in (*range(0x250), *range(0x2000, 0x2070), *range(0x3000, 0x3004)) if not chr(c).isalnum()}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        base = unicodedata.normalize("NFKD", chr(code)).lower()
        if base[:1].isascii():
            table[code] = base[:1]
    table |= {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a): b for a, b in SUBSTITUTES.items()} | dict.fromkeys((*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    table |= {k: table.get(ord(v[0]), v) for k, v in table.items() if v} | {ord("l"): "i"}
    return {k: "i" if v == "l" else v for k, v in table.items()}


_FOLD = _table()


def fold(text: str) -> str:
    """The folded text, its words parted by single blanks whatever stood between them."""
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return " ".join(text.translate(_FOLD).split())


class Model(NamedTuple):
    """Folded terms with weights, folded exception phrases, and the coefficients of the score."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]


class Matcher:
    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.model, self.stems = model, {}
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        for term, weight in model.terms:
            bare = term.rstrip("*")
            self.automaton.add_word(term, (len(bare), weight)) if bare == term else self.stems.setdefault(bare, weight)
        for stem, weight in self.stems.items():
            whole = self.automaton.get(stem, (0, 0.0))[1]
            self.automaton.add_word(stem, (-len(stem), max(weight, whole or 0.0)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """(summed weight, matches, words) of a whole text. A match is a whole word or phrase, or the start of a word for
        a stem, outside exceptions; of matches that start together the weightiest counts."""
        if not text:
            return 0.0, 0, 0
        folded = fold(text)
        found, spared = [], []
        for end, (n, weight) in self.automaton.iter(folded) if len(self.automaton) else ():
            start = end - abs(n) + 1
            if (start and folded[start - 1].isalnum()) or (n > 0 and folded[end + 1 : end + 2].isalnum()):
                continue
            if weight is None:
                spared.append((start, end))
            else:
                found.append((start, end, weight))
        if spared:
            spared.sort()
            starts, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            # the exceptions that start no later than a match cover it if the one that ends last does
            found = [f for f in found if not ((k := bisect_right(starts, f[0])) and ends[k - 1] >= f[1])]
        best: dict[int, float] = {}
        for start, _, weight in found:
            best[start] = max(weight, best.get(start, 0.0))
        return sum(best.values()), len(best), folded.count(" ") + bool(folded)

    def score(self, text: str | None) -> float:
        c0, c1, c2 = self.model.coefficients
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, c0 + c1 * (x := shape(*self.weigh(text)))[0] + c2 * x[1]))))


def shape(weight: float, matches: int, words: int) -> tuple[float, float]:
    """What the score is made of: the weight, and the weight for each hundred words, both damped."""
    del matches
    return math.log1p(weight), math.log1p(100 * weight / max(words, 1))


def matcher(model: Model) -> Matcher:
    if (key := hash(model)) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(model)
    return _MATCHERS[key]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients of a weighted logistic regression, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), x.T @ (w * (y - p)) - ridge * c)
        c += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return c


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of docs (doc_id, text) that labels (doc_id, toxic 0/1) mark.

    At most about ``rows`` texts of each class are sampled by a hash of the id; equal texts count once. The weight of a
    word or stem is the log ratio of its smoothed shares of toxic and clean texts; all that have LEAST_TEXTS, LEAST_WEIGHT and
    LEAST_RATIO join the seeds, so the sample bounds the lexicon. The sample is written once and read again. The score is a logistic regression on the sample, reweighted
    to the classes' true shares. Without labels of both classes, the seeds decide: any match scores over one half.
    """
    seeds = {fold(s): SEED_WEIGHT for s in SEEDS}
    spared = tuple(sorted({fold(e) for e in EXCEPTIONS}))
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    plain = Model(tuple(sorted(seeds.items())), spared, (-2.0, 2.0, 1.0))
    if len(sizes) < 2:
        return plain
    shares = {c: min(1.0, rows / n) for c, n in sizes.items()}
    drawn = marked.where(uniform(F.lit(3), F.col("doc_id")) < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    sample = docs.select("doc_id", F.col("text").alias("text")).where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "toxic").groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"))
    sample = stash(sample, "toxicity-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {0: Counter(), 1: Counter()}
        texts = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                own = set(_TOKEN.findall(fold(text)))
                seen[toxic].update(own | {f"{t[:n]}*" for t in own for n in STEMS if len(t) > n})
                texts[toxic] += 1
        yield pd.DataFrame([("", texts[1], texts[0]), *((t, seen[1][t], seen[0][t]) for t in seen[0].keys() | seen[1].keys())], columns=["term", "bad", "good"])

    counted = sample.select("text", "toxic").mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = stash(counted, "toxicity-terms")
    total = counted.where("term = ''").first()
    if not total or not total.bad or not total.good:
        return plain
    n1, n0 = float(total.bad), float(total.good)
    weight = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("good") + 0.5) / (n0 + 1))
    both = F.col("bad") + F.col("good")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), both * n1 / (n1 + n0)) + part(F.col("good"), both * n0 / (n1 + n0)))
    learned = counted.where(F.length("term") > 1).withColumns({"weight": weight, "ratio": ratio}).where((F.col("bad") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_WEIGHT) & (F.col("ratio") >= LEAST_RATIO))
    terms = seeds | {r.term: min(MOST_WEIGHT, r.weight) for r in learned.collect()}
    model = Model(tuple(sorted(terms.items())), spared, (0.0, 0.0, 0.0))

    @F.pandas_udf("a double, b double")
    def shapes(texts: pd.Series) -> pd.DataFrame:
        own = matcher(model)
        return pd.DataFrame([shape(*own.weigh(t)) for t in texts], columns=["a", "b"])

    points = sample.select(shapes("text").alias("s"), "toxic").groupBy(F.round("s.a", 2).alias("a"), F.round("s.b", 2).alias("b"), "toxic").agg(F.count("*").alias("n")).toPandas()
    weights = points["n"] * points["toxic"].map({c: 1 / s for c, s in shares.items()})
    order = np.lexsort((points["toxic"], points["b"], points["a"]))
    c = logistic(points[["a", "b"]].to_numpy(float)[order], points["toxic"].to_numpy(float)[order], weights.to_numpy(float)[order])
    return model._replace(coefficients=tuple(map(float, c)))


def held_out(doc_id, of: int = 5, which: int = 0):  # noqa: ANN001, ANN201
    return F.crc32(id_text(doc_id)) % of == which


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1), in one pass over whole texts without a shuffle; null and empty texts score as a text without
    a match. A column of that name is replaced; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = matcher(Model(*sent.value))
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    kept = [c for c in docs.columns if c.lower() != "score"]
    return docs.select(*kept, scored("text").alias("score"))
