"""Nearest neighbours by inner product: shards of bounded size, each with a vantage-point tree, and queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import discard, stash

K = 20
#: How much of the distance bound counts when a subtree or shard is judged: 1 is exact, less skips more.
FACTOR = 1.0
#: Vectors of a shard and queries of a block at most, about; centres of shards at most; vectors of a leaf.
SHARD, BLOCK, CENTRES, LEAF = 4096, 65_536, 256, 256
#: Queries that go down a tree together.
_TOGETHER = 512
#: Allowance for rounding in bounds on distances, in units of the greatest norm.
_SLACK = 1e-6
#: And in inner products, in units of the squared norm.
_ROUNDING = 1e-12


class Tree:
    """A vantage-point tree over vectors that are lifted to one sphere, so that the least distance is the largest inner product.

    A vector x gets one more component, the root of R^2 - |x|^2, with R the greatest norm; a query is stretched to norm R and gets 0.
    Then the squared distance is 2 R^2 - 2 q.x. A node holds a vantage point and, for each half, the least and greatest distance from it:
    by the triangle inequality a half is no nearer to a query than the query's own distance from the vantage point lies outside
    of that range.
    """

    def __init__(self, vectors: np.ndarray, radius: float, leaf: int = LEAF):
        self.x, self.radius = vectors, radius
        self.lift = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(1), 0.0))
        self.root = self._grow(np.arange(len(vectors)), max(2, leaf))

    def _apart(self, one: int, others: np.ndarray) -> np.ndarray:
        dots = self.x[others] @ self.x[one] + self.lift[others] * self.lift[one]
        return np.sqrt(np.maximum(2 * self.radius**2 - 2 * dots, 0.0))

    def _grow(self, rows: np.ndarray, leaf: int):
        """A leaf is an array of rows; a node is (vantage point, [(least, greatest distance, child)] * 2). Halves are cut by rank, so
        that equal distances split too and the depth is the logarithm of the rows."""
        if len(rows) <= leaf:
            return rows
        point = rows[np.argmax(self._apart(rows[0], rows))]
        far = self._apart(point, rows)
        order = np.argsort(far, kind="stable")
        halves = []
        for part in np.array_split(order, 2):
            halves.append((far[part].min(), far[part].max(), self._grow(rows[part], leaf)))
        return point, halves

    def search(self, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query row, vector row, inner product, distances computed) of the k nearest found for each query, ties at the k-th place
        included. floor: an inner product per query below which nothing matters."""
        to_sphere = self.radius / np.sqrt((queries**2).sum(1))  # a query's length does not matter
        asked = queries * to_sphere[:, None]
        bound = np.full(len(queries), -np.inf) if floor is None else floor * to_sphere
        top = np.full((len(queries), k), -np.inf)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slack, rounding, work = _SLACK * self.radius, _ROUNDING * self.radius**2, 0

        def distance(dots: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2 * self.radius**2 - 2 * dots, 0.0))

        def visit(node, active: np.ndarray) -> None:
            nonlocal work
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                work += len(active) * len(node)
                dots = asked[active] @ self.x[node].T
                q, at = np.nonzero(dots >= bound[active, None] - rounding)
                met.append((active[q], node[at], dots[q, at]))
                both = np.concatenate([top[active], dots], axis=1)
                top[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                bound[active] = np.maximum(bound[active], top[active].min(1))
                return
            point, halves = node
            work += len(active)
            away = distance(asked[active] @ self.x[point])
            least = [np.maximum(np.maximum(low - away, away - high), 0.0) for low, high, _ in halves]
            first = least[0] <= least[1]
            for mine, near in ((first, 0), (~first, 1)):
                for side in (near, 1 - near):
                    visit(halves[side][2], active[mine & (least[side] <= factor * distance(bound[active]) + slack)])

        visit(self.root, np.arange(len(queries)))
        if not met:
            return *(np.empty(0, np.int64),) * 2, np.empty(0), work
        q, at, dots = (np.concatenate(x) for x in zip(*met, strict=True))
        keep = dots >= bound[q] - 2 * rounding
        q, at = q[keep], at[keep]
        return q, at, exact(queries[q], self.x[at]), work


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up in the order of the components, as a plain loop does: the same to the last
    bit whatever block a row is in, so equal vectors tie."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) -> (vec_id, x) in double precision, without null ids, null or zero vectors and those that hold null or
    non-finite components."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & finite & F.exists("x", lambda v: v != 0))


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows (x, score, vec_id) of each group, with their rank. Each task keeps k of a group before rows are shuffled."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """(rows of one unit and side, whether they are queries) of rows sorted by unit and side: vectors of a unit come whole, as
    SHARD bounds them; queries as the batches cut them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        unit, asks = batch["unit"].to_numpy(), batch["asks"].to_numpy()
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]) | (asks[1:] != asks[:-1])) + 1), len(unit)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            piece = batch.iloc[at:to]
            if held and (asks[at] or held[0]["unit"].iloc[0] != unit[at]):
                yield pd.concat(held), False
                held = []
            if asks[at]:
                yield piece, True
            else:
                held.append(piece)


def _search(units: DataFrame, k: int, factor: float, radius: float, tasks: int) -> DataFrame:
    """(unit, asks, id, x, floor) -> (query_id, vec_id, score): vectors and queries of equal unit meet in one tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = ids = unit = None
        for rows, asks in _units(batches):
            if not asks:
                tree, ids, unit = Tree(np.stack(rows["x"].to_numpy()), radius), rows["id"].to_numpy(), rows["unit"].iloc[0]
                continue
            if unit != rows["unit"].iloc[0]:  # no vector is in this unit
                continue
            for at in range(0, len(rows), _TOGETHER):
                part = rows.iloc[at : at + _TOGETHER]
                asked = part["id"].to_numpy()
                q, found, score, _ = tree.search(np.stack(part["x"].to_numpy()), k, factor, part["floor"].to_numpy(float))
                order = np.lexsort((ids[found], -score, q))
                q, found, score = q[order], found[order], score[order]
                starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
                place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
                keep = place < k
                yield pd.DataFrame({"query_id": asked[q[keep]], "vec_id": ids[found[keep]], "score": score[keep]})

    # units are few bytes and much work, so their tasks must not be merged by bytes
    return units.repartition(tasks, "unit").sortWithinPartitions("unit", "asks").mapInPandas(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) each -> (query_id, rank, vec_id, score): for each query the k vectors of largest inner product found
    under another vec_id, nearest first, ties to the smaller vec_id; all of them where there are fewer.

    Nulls, zero vectors and vectors with a null or non-finite component take no part on either side, nor do rows without an id. Vectors
    of different length are never compared. Equal rows count once; a query id with several vectors asks with the least of them. Other columns
    are ignored. No queries, or no vectors, give no rows; an unrelated ``queries`` table is allowed.

    Every vector is indexed, in the shard of the nearest of at most CENTRES centres, which are drawn by hash of the vectors
    (the one bounded sample); a centre with more than SHARD vectors is dealt to several shards by hash. Of equal vectors only
    the k + 1 least ids can be among k neighbours, and equal queries are asked once, so copies fill neither. Each query first searches one shard
    of its own centre; the k-th score found bounds all further search, and shards whose ball lies beyond it are not sent
    the query. A task holds one tree and 512 queries at a time; shards are repeated for each BLOCK of queries. With
    ``factor`` 1 the triangle inequality skips only what cannot be among the k: the result is exact. A lower factor multiplies the
    bound, both in trees and for shards, and skips more.
    """
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = usable(vectors, vector).distinct()
    copies = Window.partitionBy("x").orderBy("vec_id")
    kept = stash(every.withColumn("i", F.row_number().over(copies)).where(F.col("i") <= k + 1).drop("i").select("vec_id", "x", F.size("x").alias("dim")), "neighbours-vectors")
    asked = stash(usable(queries, vector).groupBy("vec_id").agg(F.min("x").alias("x")), "neighbours-asked")
    single = stash(asked.groupBy("x").agg(F.min("vec_id").alias("id")).withColumn("dim", F.size("x")), "neighbours-queries")
    whole = kept.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).alias("r"), F.count("*").alias("n")).first()
    radius, blocks = (whole.r or 0.0) * (1 + 1e-12), max(1, ceil(single.count() / BLOCK))
    drawn = kept.select("x", "dim").distinct().orderBy(F.xxhash64("x"), "x").limit(min(CENTRES, ceil(whole.n / SHARD))).collect()
    centres = {d: np.array([r.x for r in drawn if r.dim == d]) for d in {r.dim for r in drawn}}

    def distances(x: np.ndarray, dim: int, lifts: bool) -> np.ndarray:
        """From vectors, or queries of norm R, to the centres of their length, on the sphere that trees use."""
        c = centres[dim]
        lifted = np.sqrt(np.maximum(radius**2 - (x**2).sum(1), 0.0)) if lifts else np.zeros(len(x))
        return np.sqrt(np.maximum(2 * radius**2 - 2 * (x @ c.T + np.outer(lifted, np.sqrt(np.maximum(radius**2 - (c**2).sum(1), 0.0)))), 0.0))

    @F.pandas_udf("centre int, away double")
    def placed(xs: pd.Series) -> pd.DataFrame:
        """The nearest centre of a vector and the distance to it; -1 where no centre has its length."""
        centre, away, size = np.full(len(xs), -1), np.zeros(len(xs)), xs.map(len).to_numpy(int)
        for d in np.unique(size):
            if d in centres:
                apart = distances(np.stack(xs[size == d].to_numpy()), d, True)
                centre[size == d], away[size == d] = apart.argmin(1), apart.min(1)
        return pd.DataFrame({"centre": centre.astype(np.int32), "away": away})

    home = stash(kept.withColumn("p", placed("x")).select("vec_id", "x", "dim", "p.centre", "p.away"), "neighbours-home")
    discard(kept)
    balls = home.groupBy("dim", "centre").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
    # at most CENTRES balls, and one more for each length that has no centre of its own
    balls = [(r.dim, r.centre, ceil(r.n / SHARD), r.low, r.high) for r in balls.collect()]
    shards = spark.createDataFrame(balls, "dim int, centre int, parts int, low double, high double")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    unit = lambda b: F.xxhash64("dim", "centre", "part", b).alias("unit")
    part_of = home.join(F.broadcast(shards), ["dim", "centre"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    held = part_of.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(unit("b"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "x", F.lit(0.0).alias("floor"))

    @F.pandas_udf("array<struct<centre: int, part: int>>")
    def near_shards(xs: pd.Series, ids: pd.Series, floors: pd.Series, first: pd.Series) -> pd.Series:
        """The shards that a query visits: in the first round one part of the centre nearest to it, in the second all others
        within reach."""
        out, size = [[] for _ in xs], xs.map(len).to_numpy(int)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            x = np.stack(xs.iloc[at].to_numpy())
            stretch = radius / np.sqrt((x**2).sum(1))
            mine = [b for b in balls if b[0] == d]
            if not mine:
                continue
            apart = distances(x * stretch[:, None], d, False)[:, [b[1] for b in mine]] if d in centres else np.zeros((len(x), len(mine)))
            best, limit = apart.argmin(1), factor * np.sqrt(np.maximum(2 * radius**2 - 2 * floors.iloc[at].to_numpy() * stretch, 0.0)) + _SLACK * radius
            low, high = (np.array([b[i] for b in mine]) for i in (3, 4))
            within = np.maximum(low - apart, apart - high) <= limit[:, None]
            for row, i in enumerate(at):
                start = int(ids.iloc[i]) % mine[best[row]][2]
                if first.iloc[i]:
                    out[i] = [{"centre": mine[best[row]][1], "part": start}]
                else:
                    out[i] = [{"centre": mine[j][1], "part": p} for j in np.flatnonzero(within[row]) for p in range(mine[j][2]) if (j, p) != (best[row], start)]
        return pd.Series(out, dtype=object)

    def ask(these: DataFrame, first: bool) -> DataFrame:
        to = these.withColumn("to", F.explode(near_shards("x", "id", "floor", F.lit(first)))).select("id", "x", "dim", "floor", "to.centre", "to.part")
        return to.withColumn("b", block).select(unit("b"), F.lit(True).alias("asks"), "id", "x", "floor")

    start = single.withColumn("floor", F.lit(float("-inf")))
    found = stash(_top(_search(held.unionByName(ask(start, True)), k + 1, factor, radius, tasks), ["query_id"], k + 1), "neighbours-found")
    # the k + 1-th score found, if there are so many, bounds what a query still looks for
    floors = found.where(F.col("rank") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    onward = single.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = _search(held.unionByName(ask(onward, False)), k + 1, factor, radius, tasks)
    best = stash(_top(found.select("query_id", "vec_id", "score").unionByName(more), ["query_id"], k + 1).drop("rank"), "neighbours-best")
    discard(found, home)
    named = asked.withColumnRenamed("vec_id", "query_id").join(single.select("x", "id"), "x").select("query_id", "id")
    pairs = named.join(best.withColumnRenamed("query_id", "id"), "id").where(F.col("query_id") != F.col("vec_id"))
    return _top(pairs.select("query_id", "vec_id", "score"), ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
