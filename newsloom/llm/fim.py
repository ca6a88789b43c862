"""Fill-in-middle transformation: texts as ropes, split at two unit ranks, rearranged with sentinels, and split again to invert."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import filled, id_text

#: Units that tile a text: lines with their end, or single code points.
LINES = r"[^\n]*\n|[^\n]+"
CHARS = r"(?s:.)"
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, percent of those in which the suffix comes first, seed of the draws.
RATE, SPM, DRAW_SEED = 100, 50, 7
#: Code points in a leaf of a rope at most.
LEAF = 2048


class Rope:
    """A text as a balanced binary tree. A leaf holds a piece of the text and the places where units end in it; every node
    keeps its units (ends of units in it), its code points and its height. Nodes never change, so ropes share subtrees:
    a split or a concatenation makes a number of nodes in proportion to the height."""

    __slots__ = ("text", "ends", "left", "right", "units", "chars", "height")

    def __init__(self, text: str = "", ends: tuple[int, ...] = (), left: Rope | None = None, right: Rope | None = None):
        self.text, self.ends, self.left, self.right = text, ends, left, right
        if left is None or right is None:
            self.units, self.chars, self.height = len(ends), len(text), 0
        else:
            self.units, self.chars, self.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)

    @staticmethod
    def of(text: str, unit: str | None = None, leaf: int = LEAF) -> Rope:
        """The rope of a text. unit: a pattern whose matches, from left to right, are the units; without one there are none."""
        ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()] if unit else []
        leaves = []
        for at in range(0, max(1, len(text)), leaf):
            inside = ends[bisect_left(ends, at + 1) : bisect_left(ends, at + leaf + 1)]
            leaves.append(Rope(text[at : at + leaf], tuple(e - at for e in inside)))
        return _tree(leaves, 0, len(leaves))

    def joined(self, other: Rope) -> Rope:
        """This rope and then the other, balanced: the taller one is opened on its inner side down to the other's height."""
        if not self.chars:
            return other
        if not other.chars:
            return self
        if self.height > other.height + 1:
            return _balanced(self.left, self.right.joined(other))
        if other.height > self.height + 1:
            return _balanced(self.joined(other.left), other.right)
        return Rope("", (), self, other)

    def split_chars(self, at: int) -> tuple[Rope, Rope]:
        """The first ``at`` code points, and the rest."""
        if at <= 0:
            return Rope(), self
        if at >= self.chars:
            return self, Rope()
        if self.left is None:
            cut = bisect_left(self.ends, at + 1)
            return Rope(self.text[:at], self.ends[:cut]), Rope(self.text[at:], tuple(e - at for e in self.ends[cut:]))
        if at <= self.left.chars:
            a, b = self.left.split_chars(at)
            return a, b.joined(self.right)
        a, b = self.right.split_chars(at - self.left.chars)
        return self.left.joined(a), b

    def split_units(self, rank: int) -> tuple[Rope, Rope]:
        """The first ``rank`` units, and the rest."""
        return self.split_chars(self.end_of(rank))

    def end_of(self, rank: int) -> int:
        """The code points up to the end of unit number ``rank``, from 1; 0 for rank 0."""
        node, at = self, 0
        if rank <= 0:
            return 0
        if rank > node.units:
            return node.chars
        while node.left is not None:
            if rank <= node.left.units:
                node = node.left
            else:
                rank, at, node = rank - node.left.units, at + node.left.chars, node.right
        return at + node.ends[rank - 1]

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                out.append(node.text)
            else:
                todo += [node.right, node.left]
        return "".join(out)


def _tree(leaves: list[Rope], at: int, to: int) -> Rope:
    if to - at == 1:
        return leaves[at]
    return Rope("", (), _tree(leaves, at, (at + to) // 2), _tree(leaves, (at + to) // 2, to))


def _balanced(left: Rope, right: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most, rotated where they do."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Rope("", (), left.left, Rope("", (), left.right, right))
        return Rope("", (), Rope("", (), left.left, left.right.left), Rope("", (), left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Rope("", (), Rope("", (), left, right.left), right.right)
        return Rope("", (), Rope("", (), left, right.left.left), Rope("", (), right.left.right, right.right))
    return Rope("", (), left, right)


def rearrange(text: str, draws: tuple[int, int, int, int], rate: int = RATE, spm: int = SPM, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text under four drawn numbers."""
    rope = Rope.of(text, unit)
    n, (one, two, third, fourth) = rope.units, draws
    if not text or third % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    prefix, rest = rope.split_units(low)
    middle, suffix = rest.split_units(high - low)
    p, s, m = map(Rope, sentinels)
    form = "spm" if fourth % 100 < spm else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = parts[0]
    for part in parts[1:]:
        out = out.joined(part)
    return n, form, prefix.chars, middle.chars, str(out)


def rebuild(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    p, s, m = sentinels
    marks = (s, p, m) if form == "spm" else (p, s, m)
    rope, taken, parts = Rope.of(output), 0, []
    for mark, following in zip(marks, (*marks[1:], None), strict=True):
        rope = rope.split_chars(len(mark))[1]
        taken += len(mark)
        end = len(output) if following is None else output.index(following, taken)
        part, rope = rope.split_chars(end - taken)
        parts.append(part)
        taken = end
    prefix, middle, suffix = (parts[1], parts[2], parts[0]) if form == "spm" else (parts[0], parts[2], parts[1])
    return str(prefix.joined(middle).joined(suffix))


def _without(df: DataFrame, *names: str) -> list:
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = DRAW_SEED, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text and any others) with n, form, prefix_chars, middle_chars and output, a row for each row of docs.

    n counts the units of the whole text: matches of ``unit`` from left to right; what no unit covers after the last one
    belongs to the suffix. The draws are the first four groups of eight hex digits of the sha256 of ``seed:doc_id``. The
    prefix ends after the smaller of two drawn ranks, the middle after the larger; the rest is the suffix. form is "psm"
    (prefix, suffix, middle, a sentinel before each), "spm" (suffix, prefix, middle), or "plain" (the text itself, and
    null lengths) for texts that are empty or contain a sentinel and for the rest of ``rate`` percent. Null texts count
    as empty, a null doc_id as no digits. Repeated rows come out alike; columns of the new names are replaced; an empty
    table gives no rows. Texts are never cut: a rope's leaves share the text's pieces.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id"))), 256)
    drawn = F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def made(texts: pd.Series, draws: pd.Series) -> pd.DataFrame:
        rows = [rearrange(t, tuple(map(int, d)), rate, spm, unit, sentinels) for t, d in zip(texts, draws, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = _without(docs, *names)
    return docs.select(*kept, made(filled(F.col("text")), drawn).alias("__made")).select(*kept, *(F.col(f"__made.{c}").alias(c) for c in names))


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made (output, form and any others) with restored: the text each output was made from, rebuilt from these two
    columns alone. A null output or form gives null. A sentinel that is missing from an output of form psm or spm raises
    an error; an empty table gives no rows."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rebuild(o, f, sentinels) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    kept = _without(made, "restored")
    return made.select(*kept, back("output", "form").alias("restored"))
