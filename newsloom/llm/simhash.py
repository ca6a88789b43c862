"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import discard, stash
from newsloom.llm.components import components

SHINGLE = 4
RADIUS = 4
BITS = 64
SEED = 42
TILE = 1024
#: Bits summed at once, so that a very long text needs little memory.
_BLOCK = 1 << 15


def fingerprint_of(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned integer: a bit is 1 if it is set in over half the shingle hashes."""
    split = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six blanks separate
    if not split:
        return 0
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    if len(split) <= width:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, split), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)), np.uint64, len(split) - width + 1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """docs with a column fp: the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", simhash(F.coalesce(F.col(text), F.lit(""))))


def _stars(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list, list]:
    """A star for each connected component of the links between two tiles: every fingerprint with the component's least."""
    a, b = [], []
    todo = near.any(1)
    while todo.any():
        rows, cols = np.zeros(len(left), bool), np.zeros(len(right), bool)
        front = np.zeros(len(left), bool)
        front[np.argmax(todo)] = True
        while front.any():
            rows |= front
            reached = near[front].any(0) & ~cols
            cols |= reached
            front = near[:, reached].any(1) & ~rows if reached.any() else np.zeros(len(left), bool)
        members = np.unique(np.concatenate([left[rows], right[cols]]))
        a.append(members[1:])
        b.append(np.full(len(members) - 1, members[0]))
        todo &= ~rows
    return a, b


def compare(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of fingerprints (signed 64-bit), as stars: exclusive-or and bit counts, tile by tile; a pair
    of tiles whose population counts differ beyond the radius is skipped."""
    tiles = []
    for side in (left, right):
        counts = np.bitwise_count(side.view(np.uint64))
        order = np.argsort(counts, kind="stable")
        side, counts = side[order], counts[order].astype(np.int64)
        tiles.append([(side[i : i + TILE], counts[i], counts[min(i + TILE, len(side)) - 1]) for i in range(0, len(side), TILE)])
    same = left is right
    a, b = [], []
    for i, (x, x_low, x_high) in enumerate(tiles[0]):
        for y, y_low, y_high in tiles[1][i if same else 0 :]:
            if y_low - x_high > radius or x_low - y_high > radius:
                continue
            near = np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= radius
            more_a, more_b = _stars(near, x, y)
            a += more_a
            b += more_b
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one unit together; rows come sorted by unit."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch["unit"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            piece = batch.iloc[at:to]
            if held and held[0]["unit"].iloc[0] != piece["unit"].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp) distinct -> (a, b): edges that connect exactly what pairs within the radius connect.

    Two fingerprints within the radius agree on one of radius + 1 bands of bits, so only fingerprints that share a band
    are compared, and all of those are. Fingerprints of a band value form one unit up to ``tile`` of them. A larger one is
    laid out by population count and cut into tiles of about that size, and each pair of tiles whose population counts come within
    the radius is a unit of its own: no task ever holds more than two tiles. A unit returns stars, not pairs.
    """
    bands = radius + 1
    cut = [round(i * BITS / bands) for i in range(bands + 1)]
    keys = F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col("fp"), cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)).alias("key")) for i in range(bands)))
    banded = prints.select("fp", F.bit_count("fp").alias("ones"), F.inline(keys))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    pops = banded.groupBy("band", "key", "ones").agg(F.count("*").alias("m"))
    sized = banded.join(sizes, ["band", "key"])
    small = sized.where(F.col("n") <= tile).select(F.xxhash64("band", "key").alias("unit"), F.lit(0).alias("side"), "fp")
    # a large band value is laid out by population count, then by hash, and cut into tiles
    large = sizes.where(F.col("n") > tile)
    start = F.sum("m").over(Window.partitionBy("band", "key").orderBy("ones")) - F.col("m")  # over 65 counts at most
    laid = pops.join(large.select("band", "key"), ["band", "key"]).withColumn("start", start)
    spans = laid.select("band", "key", "ones", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("start") + F.col("m") - 1) / tile))).alias("t"))
    tiles = spans.groupBy("band", "key", "t").agg(F.min("ones").alias("low"), F.max("ones").alias("high"))
    own = tiles.select("band", "key", F.col("t").alias("t_a"), F.col("high").alias("high_a"))
    other = tiles.select("band", "key", F.col("t").alias("t_b"), F.col("low").alias("low_b"))
    pairs = own.join(other, ["band", "key"]).where((F.col("t_a") <= F.col("t_b")) & (F.col("low_b") - F.col("high_a") <= radius))
    # a tile compared with itself has side 0; else the two have sides 1 and 2
    end = lambda side, t: F.struct(F.lit(side).alias("side"), F.col(t).alias("t"))
    ends = pairs.select("band", "key", F.xxhash64("band", "key", "t_a", "t_b").alias("unit"), F.inline(F.when(F.col("t_a") == F.col("t_b"), F.array(end(0, "t_a"))).otherwise(F.array(end(1, "t_a"), end(2, "t_b")))))
    parted = banded.join(laid, ["band", "key", "ones"]).withColumn("t", F.floor((F.col("start") + F.pmod(F.xxhash64("fp"), F.col("m"))) / tile))
    tiled = parted.join(ends, ["band", "key", "t"]).select("unit", "side", "fp")
    units = small.unionByName(tiled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in _units(batches):
            fp, side = unit["fp"].to_numpy(), unit["side"].to_numpy()
            if side[0] == 0:
                a, b = compare(fp, fp, radius)
            else:
                a, b = compare(fp[side == 1], fp[side == 2], radius)
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})

    # an explicit number: units are few bytes and many pairs, so their tasks must not be merged by bytes
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(tasks, "unit").sortWithinPartitions("unit").mapInPandas(run, "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, root, component_id), a row for each row of docs; root names the component, whatever ids
    its documents have. See near_duplicates()."""
    prints = stash(fingerprints(docs.select("doc_id", "text"), "text", width).select("doc_id", "fp"), "simhash")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = stash(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    discard(nodes)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the least doc_id that links of at most ``radius`` differing bits
    reach, the document's own included. Null and empty texts, and texts of blanks, have fingerprint 0 and are linked like
    any other; a text shorter than ``width`` words is one shingle. Repeated rows each come back. A null doc_id takes the
    component of its fingerprint, null if no id is in it. Other columns are ignored; an empty table gives no rows.
    Equal fingerprints are one node, so copies never make pairs.
    """
    return grouped(docs, radius, width).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
