"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases win."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import id_text, uniform

#: Labelled rows of each language that a fit samples, and characters of running text that their passages fill.
SAMPLE_ROWS = 512
SAMPLE_CHARS = 65_536
#: Characters of all automata together: with many languages each gets less, so that a worker's memory stays bounded.
MODEL_CHARS = 1 << 20
#: Bytes after which a phrase ends in any case, so that a long text is parsed in as many lanes at once.
BLOCK = 512
#: Bytes of text that are parsed at once.
AT_ONCE = 4 << 20
#: Bits by which a language must be longer for its odds to halve.
SOFTNESS = 8.0
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")
_PARSERS: dict[int, Parser] = {}


class Model(NamedTuple):
    """Languages in code point order, and for each the running text of its automaton."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]


def plain(text: str) -> str:
    """The lower-cased text with one blank for all between two runs of letters, and one at either end."""
    return f" {' '.join(_RUN.findall(text.lower()))} "


def automaton(text: bytes) -> list[dict[int, int]]:
    """The suffix automaton of a text, as the transitions of each state; state 0 starts."""
    nexts: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for ch in text:
        new = len(nexts)
        nexts.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nexts[p]:
            nexts[p][ch] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][ch]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and nexts[p].get(ch) == q:
                    nexts[p][ch] = twin
                    p = link[p]
        last = new
    return nexts


def phrases(nexts: list[dict[int, int]], text: bytes, block: int = BLOCK) -> int:
    """Phrases of the cross-parsing of text, one step at a time: each the longest match that the automaton has, one byte at
    least, ended by a multiple of ``block``. What Parser counts in lanes."""
    n, at = 0, 0
    while at < len(text):
        state, to, end = 0, at, min(len(text), (at // block + 1) * block)
        while to < end and (step := nexts[state].get(text[to])) is not None:
            state, to = step, to + 1
        at, n = max(to, at + 1), n + 1
    return n


class Parser:
    """Phrase counts of many texts at once. A text's bytes are cut into lanes of ``block``; all lanes take a step together through
    an automaton's dense table, in which a byte that doesn't go on from a state leads where it leads from the start, marked as
    the first of a new phrase."""

    def __init__(self, model: Model, block: int = BLOCK) -> None:
        self.block, texts = block, [t.encode() for t in model.texts]
        known = sorted(set(b"".join(texts)))
        self.classes = np.zeros(256, np.uint8)
        self.classes[known] = np.arange(1, len(known) + 1)
        self.tables = [self.table(t, len(known) + 1) for t in texts]
        #: A phrase names a place of the automaton's text.
        self.bits = np.array([math.log2(len(t) + 2) for t in texts])

    def table(self, text: bytes, width: int) -> np.ndarray:
        """Of each state and class: the next state's row times two, plus one where a phrase begins."""
        nexts = automaton(text)
        size = 2 * width * len(nexts)
        wide = np.int32 if size < 1 << 31 else np.int64
        rows = np.repeat(np.arange(len(nexts)), [len(n) for n in nexts])
        chars = self.classes[np.fromiter((c for n in nexts for c in n), np.int64, len(rows))]
        to = 2 * width * np.fromiter((s for n in nexts for s in n.values()), np.int64, len(rows))
        start = np.ones(width, wide)
        start[chars[rows == 0]] += to[rows == 0].astype(wide)
        table = np.tile(start, (len(nexts), 1))
        table[rows[rows > 0], chars[rows > 0]] = to[rows > 0]
        return table.ravel()

    def count(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): phrases of each."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // self.block)
        owner = np.repeat(np.arange(len(texts)), lanes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(sizes) - sizes, lanes) + within * self.block
        length = np.minimum(np.repeat(sizes, lanes) - within * self.block, self.block)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        # lanes that are still going at each step
        going = len(length) - np.searchsorted(length[::-1], np.arange(self.block), side="right")
        out = np.zeros((len(texts), len(self.tables)))
        counts = [np.zeros(len(owner), np.int32) for _ in self.tables]
        states = [np.zeros(len(owner), t.dtype) for t in self.tables]
        for step in range(int(length.max(initial=0))):
            n = going[step]
            codes = data[begin[:n] + step].astype(np.int32)
            for table, state, count in zip(self.tables, states, counts, strict=True):
                now = state[:n]
                np.right_shift(now, 1, out=now)
                np.add(now, codes, out=now)
                np.take(table, now, out=now, mode="clip")
                count[:n] += now & 1
        for k, count in enumerate(counts):
            out[:, k] = np.bincount(owner, count, minlength=len(texts))
        return out

    def predict(self, texts: list[str | None], languages: tuple[str, ...]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out, held, size = [(UNKNOWN, 0.0)] * len(texts), [], 0
        for i, text in enumerate(texts):
            if languages and text and any(map(str.isalpha, text)):
                held.append((i, plain(text).encode()))
                size += len(held[-1][1])
            if held and (size > AT_ONCE or i == len(texts) - 1):
                cost = self.count([t for _, t in held]) * self.bits
                best = cost.argmin(1)
                scores = 1 / np.exp2((cost.min(1, keepdims=True) - cost) / SOFTNESS).sum(1)
                for (at, _), k, score in zip(held, best.tolist(), scores.tolist(), strict=True):
                    out[at] = languages[k], score
                held, size = [], 0
        return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of the labelled rows (text, lang) of docs; null langs and texts teach nothing.

    For each language at most ``rows`` distinct texts are sampled by a hash of the text. Each gives a passage of running text,
    begun where the hash points and long enough that they fill ``chars`` characters together; joined, they are the text of the
    language's automaton, in their own order of words. All languages get texts of about one length.
    """
    known = docs.where("lang is not null and text is not null")
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * rows) / F.count("*")).alias("share"))
    shares = {r.lang: r.share for r in share.collect()}
    if not shares:
        return Model((), ())
    chars = min(chars, MODEL_CHARS // len(shares))
    wanted = F.create_map(*(F.lit(x) for pair in sorted(shares.items()) for x in pair))
    drawn = known.withColumn("u", uniform(F.lit(5), F.col("text"))).where(F.col("u") < wanted[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("u")
    sample = drawn.select("lang", "text", "u").dropDuplicates(["lang", "u"]).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows)
    size = F.ceil(F.lit(float(chars)) / F.count("*").over(Window.partitionBy("lang"))).cast("int")
    begin = (F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - F.col("size") + 1, F.lit(1)))).cast("int") + 1
    passages = sample.withColumn("size", size).select("lang", "u", F.substring("text", begin, F.col("size")).alias("text"))
    found: dict[str, list[str]] = {}
    for r in passages.orderBy("lang", "u").collect():
        found.setdefault(r.lang, []).append(plain(r.text).strip())
    names = tuple(sorted(n for n, texts in found.items() if any(texts)))
    return Model(names, tuple(f" {' '.join(filter(None, found[n]))} " for n in names))


def held_out(doc_id, of: int = 4, which: int = 2):  # noqa: ANN001, ANN201
    return F.crc32(id_text(doc_id)) % of == which


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, in one pass without a shuffle.

    A text is priced in each language by its phrases times the bits that name a phrase; the cheapest wins, the first by
    code point of equal ones. score is the winner's share of the languages' odds. Null texts and texts without a letter are
    ``und`` with score 0, as is every text if no language was learned. Columns of these two names are replaced. Repeated rows
    each come back; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # MODEL_CHARS bound it
    key = hash(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        own = Model(*sent.value)
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(own)
        return pd.DataFrame(_PARSERS[key].predict(list(texts), own.languages), columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*kept, predicted("text").alias("__p")).select(*kept, "__p.lang_pred", "__p.score")
