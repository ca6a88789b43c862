"""Chat formatting: reply trees to conversations with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import filled, stash

#: The template's control strings. A turn is OPEN role MID text CLOSE; inside roles and texts each control string, and the
#: escape character itself, gets the escape character in front.
OPEN, MID, CLOSE, ESCAPE = "### ", ": ", " </turn>\n", "\\"
_GUARDED = (ESCAPE, "###", "</turn>", ":")
_HIDE = re.compile("|".join(map(re.escape, (ESCAPE, "###", "</turn>"))))
_HIDE_ROLE = re.compile("|".join(map(re.escape, _GUARDED)))
_SHOW = re.compile(re.escape(ESCAPE) + "(" + "|".join(map(re.escape, _GUARDED)) + ")")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*?): ((?:\\.|[^\\])*?) </turn>\n", re.S)
#: A tree deeper than two to this power is taken for a cycle.
MAX_ROUNDS = 40


def hide(text: str, role: bool = False) -> str:
    return (_HIDE_ROLE if role else _HIDE).sub(lambda m: ESCAPE + m[0], text)


def show(text: str) -> str:
    return _SHOW.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int], list[int]]:
    """(formatted, starts, ends): the loss mask covers the text of each turn of the role ``learn``, in code points."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{OPEN}{hide(role, True)}{MID}", hide(text)
        if role == learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), starts, ends


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of format_turns()."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn starts at {at}")
        turns.append((show(m[1]), show(m[2])))
        at = m.end()
    return turns


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """Reply trees (tree, node, parent, score) to chosen root-to-leaf paths (tree, branch, depth, node).

    Iterative self-joins that double their reach: round k joins every node's ancestor 2**k steps up to that ancestor's own,
    so a tree of depth d takes log2(d) rounds, gives every leaf its depth and summed score, and leaves a table of jumps.
    The chosen leaves then gather their ancestors by the same jumps, longest first. Texts never move; each round is
    written to the shared folder, in proportion to the nodes so deep. Paths of a tree are ranked by summed score (null
    scores are 0), then by length, then by leaf, greater first for the first two; ``keep`` of them stay, branch 1 the best.
    A node whose parent is null or absent is a root; a cycle raises after MAX_ROUNDS; repeated (tree, node) rows are one
    node, the one with the best score and least parent.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = stash(nodes.groupBy("tree", "node").agg(F.max_by(F.struct("parent", "score"), F.struct("score", -F.coalesce("parent", F.lit(-1)))).alias("x")).select("tree", "node", "x.parent", "x.score"), "replies")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    linked = nodes.join(known, ["tree", "parent"], "left")
    state = linked.select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.when(F.col("found"), 1).otherwise(0).cast("long").alias("depth"), "score")
    jumps, done = [], []
    while True:
        state = stash(state, "replies-round")
        done.append(state.where("up is null").select("tree", "node", "depth", "score"))
        far = state.where("up is not null")
        if far.isEmpty():
            break
        if len(jumps) == MAX_ROUNDS:
            raise ValueError("the replies contain a cycle")
        jumps.append(far.select("tree", "node", "up"))
        # nodes whose way to the root is complete are looked up as well
        above = far.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("score").alias("gain"))
        for d in done:
            above = above.unionByName(d.select("tree", F.col("node").alias("up"), F.lit(None).cast("long").alias("next"), F.col("depth").alias("more"), F.col("score").alias("gain")))
        state = far.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("gain")).alias("score"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct() if jumps else whole.limit(0).select("tree", "node")
    ranked = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node")
    front = whole.join(inner, ["tree", "node"], "left_anti").withColumn("branch", F.row_number().over(ranked)).where(F.col("branch") <= keep).select("tree", "branch", "node")
    for jump in reversed(jumps):
        front = stash(front, "replies-path")
        front = front.unionByName(front.join(jump, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node")))
    return front.join(whole.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "branch", "depth", "node")


def chain(conversations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Conversations by turn as reply trees with texts: (tree, node, parent, score, role, text); a turn answers the one before.

    Turns are taken in the order of turn, role and text; a null conv_id is one conversation of its own; null texts and
    roles are empty. Equal rows are separate turns.
    """
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", filled(F.col("role")).alias("role"), filled(F.col("text")).alias("text"))
    if extra is not None:
        rows = rows.unionByName(extra.select(F.col("conv_id").alias("tree"), "turn", "role", "text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long") - 1
    return rows.withColumn("node", place).select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def conversations(messages: DataFrame, keep: int = 1, learn: str = "assistant") -> DataFrame:
    """Messages (tree, node, parent, score, role, text) to (tree, branch, formatted, starts, ends), a row for each chosen path.

    Nulls in tree are a tree of their own. Repeated (tree, node) rows keep one role and text, the least. Texts join by key
    after the paths are known. An empty table gives no rows.
    """
    key = F.coalesce(F.col("tree").cast("string"), F.lit("\x00"))
    keyed = stash(messages.select("tree", key.alias("k"), "node", "parent", "score", "role", "text"), "messages")
    chosen = paths(keyed.select(F.col("k").alias("tree"), "node", "parent", "score"), keep)
    texts = keyed.groupBy("k", "node").agg(F.min(F.struct(filled(F.col("role")).alias("role"), filled(F.col("text")).alias("text"))).alias("x"), F.first("tree").alias("id"))
    joined = chosen.join(texts.withColumnRenamed("k", "tree"), ["tree", "node"])
    turns = F.array_sort(F.collect_list(F.struct("depth", "x.role", "x.text")))
    whole = joined.groupBy("tree", "branch").agg(F.first("id").alias("id"), turns.alias("turns"))

    @F.pandas_udf("formatted string, starts array<long>, ends array<long>")
    def formatted(all_turns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([format_turns([(t["role"], t["text"]) for t in turns], learn) for turns in all_turns], columns=["formatted", "starts", "ends"])

    return whole.select(F.col("id").alias("tree"), "branch", formatted("turns").alias("f")).select("tree", "branch", "f.formatted", "f.starts", "f.ends")


def digests(formatted: DataFrame) -> DataFrame:
    """Formatted conversations read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(batch["tree"], batch["formatted"], batch["starts"], batch["ends"], strict=True):
                turns = parse_turns(text)
                loss = "".join(show(text[s:e]) for s, e in zip(starts, ends, strict=True))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.astype({"conv_id": "Int64"})

    return formatted.select("tree", "formatted", "starts", "ends").mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
