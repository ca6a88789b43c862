"""Density clustering of vectors and sequential assignment to clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.scratch import written

#: Distances that a clustering task holds at once, about: rows are taken in blocks of so many pairs.
BLOCK_PAIRS = 4_000_000

#: Rows of a block. Tables of more rows are clustered by pairs of lots of blocks, a task each.
TILE = 2048

#: Blocks of a lot at most: a task holds the vectors of two lots. A group has LOTS lots, if it has as many blocks.
FOREST_FAN, LOTS = 16, 10

#: Others that are listed for a point at least, the nearest; and points that are held against a block at once.
NEAREST, STRIP = 8, 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b. Those that a product of matrices would round away are taken from the
    differences, so that equal rows are 0 apart."""
    total = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]
    d = total - 2 * a @ b.T
    i, j = np.nonzero(d <= 1e-6 * total)
    for at in range(0, len(i), 65_536):
        p, q = i[at : at + 65_536], j[at : at + 65_536]
        d[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(d)


def spanning_tree(n: int, reach: Callable[[int], np.ndarray]) -> list[tuple[float, int, int]]:
    """Edges (length, a, b), a < b, of the minimum spanning tree, the least by (length, a, b), so that it is the only one.
    ``reach`` gives the lengths from one point to all."""
    places = np.arange(n)
    best, todo = reach(0), np.ones(n, bool)
    edge = places.copy()  # a * n + b of the edge that is best
    todo[0] = False
    edges = []
    for _ in range(n - 1):
        open_ = np.flatnonzero(todo)
        near = open_[best[open_] == best[open_].min()]
        j = int(near[np.argmin(edge[near])])
        edges.append((float(best[j]), *divmod(int(edge[j]), n)))
        todo[j] = False
        d, e = reach(j), np.minimum(places, j) * n + np.maximum(places, j)
        closer = todo & ((d < best) | ((d == best) & (e < edge)))
        best[closer], edge[closer] = d[closer], e[closer]
    return edges


class Sets:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.top = list(range(n))

    def find(self, a: int) -> int:
        top = self.top
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.top[b] = a
        return a != b


class Lot:
    """Points of some blocks, each with the nearest others found so far: lengths, codes and copies. A length is the distance, or the
    greatest of it and both points' ``core``. Only lengths under a point's ``bound`` count."""

    def __init__(self, x: np.ndarray, code: np.ndarray, copies: np.ndarray, k: int, core: np.ndarray | None = None, part: np.ndarray | None = None, bound: np.ndarray | None = None) -> None:
        n = len(x)
        self.x, self.code, self.copies, self.part = x, code, copies, part
        self.core = np.zeros(n) if core is None else core
        self.bound = np.full(n, np.inf) if bound is None else bound.copy()
        self.length, self.other, self.many = np.full((n, k), np.inf), np.full((n, k), -1), np.zeros((n, k), int)

    def least(self, s: np.ndarray, at: slice, scale: float, slack: float) -> np.ndarray:
        """The scores, minus half the squared distance over the scale, that the points ``at`` (rows of s) take notice of."""
        low, k = (-((self.bound[at] / scale) ** 2) / 2 - slack).astype(s.dtype), self.length.shape[1]
        new = np.flatnonzero(np.isinf(low))
        if len(new) and s.shape[1] > k:
            low[new] = np.partition(s[new], -k, axis=1)[:, -k] - slack
        return low

    def offer(self, at: np.ndarray, length: np.ndarray, code: np.ndarray, copies: np.ndarray) -> None:
        good = length < self.bound[at]
        if not good.any():
            return
        at, length, code, copies = at[good], length[good], code[good], copies[good]
        rows, k = np.unique(at), self.length.shape[1]
        at = np.concatenate([np.repeat(rows, k), at])
        length, code, copies = (np.concatenate([old[rows].ravel(), new]) for old, new in ((self.length, length), (self.other, code), (self.many, copies)))
        order = np.lexsort((code, length, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, rank = order[rank < k], at[rank < k], rank[rank < k]
        self.length[at, rank], self.other[at, rank], self.many[at, rank] = length[order], code[order], copies[order]
        self.bound[rows] = np.minimum(self.bound[rows], self.length[rows, -1])


def meet(a: Lot, b: Lot, both: bool) -> None:
    """Offer the points of b to those of a and, if ``both``, those of a to b's. A product of matrices tells which pairs may count,
    in single precision unless that leaves many; their lengths are taken from the differences. Points of one ``part`` don't meet."""
    middle = b.x.mean(0)
    scale = np.sqrt(max(((v.x - middle) ** 2).sum(1).max() for v in (a, b))) or 1.0
    p, q = (a.x - middle) / scale, (b.x - middle) / scale
    pp, qq = (p**2).sum(1), (q**2).sum(1)
    p, q = np.column_stack([p, np.ones(len(p)), -pp / 2]), np.column_stack([q, -qq / 2, np.ones(len(q))])
    tries = [(p.astype(np.float32), q.astype(np.float32), 4e-7 * p.shape[1]), (p, q, 2e-12)]  # with what rounding may hide
    for i in range(0, len(p), STRIP):
        for j in range(0, len(q), TILE):
            rows, columns = slice(i, min(i + STRIP, len(p))), slice(j, min(j + TILE, len(q)))
            for left, right, slack in tries:
                s = left[rows] @ right[columns].T
                if a is b:
                    same = np.arange(max(i, j), max(i, j, min(rows.stop, columns.stop)))
                    s[same - i, same - j] = -np.inf
                if a.part is not None:
                    s[a.part[rows, None] == b.part[None, columns]] = -np.inf
                hits = s > a.least(s, rows, scale, slack)[:, None]
                if both:
                    hits |= s > b.least(s.T, columns, scale, slack)[None, :]
                if np.count_nonzero(hits) < hits.size / 32:
                    break
            found = np.flatnonzero(hits)
            for at in range(0, len(found), 65_536):
                r, c = np.divmod(found[at : at + 65_536], s.shape[1])
                r, c = r + i, c + j
                length = np.maximum(np.sqrt(((a.x[r] - b.x[c]) ** 2).sum(1)), np.maximum(a.core[r], b.core[c]))
                a.offer(r, length, b.code[c], b.copies[c])
                if both:
                    b.offer(c, length, a.code[r], a.copies[r])


def grow(part: np.ndarray, radius: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, chosen, bound) of points and listed edges (w, a, b) in order. Each part in turn takes its shortest edge to another,
    if no point of it has a radius under that: edges that are not listed are at least that long, so it is an edge of a least
    spanning tree. ``part`` is a point of each point's part, ``chosen`` tells the edges taken, ``bound`` is the shortest listed
    edge out of each point's part."""
    n, chosen, live = len(part), np.zeros(len(w), bool), np.arange(len(w))
    while True:
        p, q = part[a[live]], part[b[live]]
        live, p, q = live[p != q], p[p != q], q[p != q]
        first = np.full(n, len(live))
        np.minimum.at(first, p, np.arange(len(live)))
        np.minimum.at(first, q, np.arange(len(live)))
        least = np.full(n, np.inf)
        np.minimum.at(least, part, radius)
        out = np.append(w[live], np.inf)[first]
        sure = np.flatnonzero((first < len(live)) & (out <= least))
        if not len(sure):
            return part, chosen, out[part]
        edge = first[sure]
        chosen[live[edge]] = True
        up = np.arange(n)
        up[sure] = np.where(p[edge] == sure, q[edge], p[edge])
        top = (up[up] == np.arange(n)) & (np.arange(n) < up)  # of two that chose one edge
        up[top] = np.flatnonzero(top)
        while (up[up] != up).any():
            up = up[up]
        part = up[part]


def cut_tree(n: int, edges: list[tuple[float, int, int]], min_cluster_size: int) -> np.ndarray:
    """Labels of n points from the edges of their spanning tree, in order: condensed tree, excess of mass. Merges of one height
    are one merge of many, so the order of ties does not matter. Memory grows with the points."""
    labels = np.full(n, -1)
    if n < max(2, min_cluster_size):
        return labels
    # single-linkage tree: nodes n.. are merges
    sets, children, size, height = Sets(2 * n - 1), {}, [1] * n + [0] * (n - 1), [0.0] * (2 * n - 1)
    node = n
    for w, a, b in edges:
        a, b = sets.find(a), sets.find(b)  # noqa: PLW2901
        if a == b:
            continue
        sets.top[a] = sets.top[b] = node
        children[node], size[node], height[node] = (a, b), size[a] + size[b], w
        node += 1

    def parts(node: int) -> list[int]:
        out, stack = [], list(children[node])
        while stack:
            c = stack.pop()
            if c >= n and height[c] == height[node]:
                stack += children[c]
            else:
                out.append(c)
        return out

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            c = stack.pop()
            out += [c] if c < n else []
            stack += children.get(c, ())
        return out

    # condensed tree: clusters with birth, the points that left at which density, and true splits
    density = lambda h: 1 / max(h, 1e-12)
    births, stability, splits, nodes = [0.0], [0.0], [[]], [2 * n - 2]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            continue
        rate = density(height[node])
        large = [k for k in parts(node) if size[k] >= min_cluster_size]
        if len(large) > 1:
            stability[c] += (rate - births[c]) * size[node]
            for k in large:
                births.append(rate)
                stability.append(0.0)
                splits.append([])
                nodes.append(k)
                splits[c].append(len(births) - 1)
                stack.append((k, len(births) - 1))
        else:
            gone = size[node] - sum(size[k] for k in large)
            stability[c] += (rate - births[c]) * gone
            stack += [(k, c) for k in large]
    chosen, mass = set(), list(stability)
    for c in range(len(births) - 1, 0, -1):
        below = sum(mass[k] for k in splits[c])
        if splits[c] and below > stability[c]:
            mass[c] = below
        else:
            chosen.add(c)
    picked, stack = [], list(splits[0])
    while stack:
        c = stack.pop()
        if c in chosen:
            picked.append(sorted(points(nodes[c])))
        else:
            stack += splits[c]
    for number, members in enumerate(sorted(picked)):
        labels[members] = number
    return labels


def hdbscan(x: np.ndarray, min_cluster_size: int = 3, min_samples: int = 2) -> np.ndarray:
    """Labels of the rows (-1: noise) by hierarchical density clustering: mutual reachability, minimum spanning tree,
    condensed tree, excess of mass. A point is its own first neighbour. Clusters are numbered by their first member. Memory
    grows with the rows, not with their pairs: distances are made in blocks, and again for each point as the tree takes it."""
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    k, core = min(min_samples, n) - 1, np.empty(n)
    for a in range(0, n, block := max(1, BLOCK_PAIRS // n)):
        core[a : a + block] = np.partition(distances(x[a : a + block], x), k, axis=1)[:, k]
    reach = lambda j: np.maximum(distances(x[j : j + 1], x)[0], np.maximum(core[j], core))
    return cut_tree(n, sorted(spanning_tree(n, reach)), min_cluster_size)


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    if rows["x"].isna().any():
        raise ValueError("a vector is null; encode all rows first")
    return np.stack(rows["x"].to_numpy()).astype(float)


def cluster(vectors: DataFrame, group: str | None = None, id_: str = "vec_id", vector: str = "embedding", min_cluster_size: int = 3, min_samples: int = 2) -> DataFrame:
    """(group, id, cluster) of every vector, all at once or each group (a window, a topic) clustered apart; -1 is noise. A null
    vector raises. If a group has more than TILE rows, neighbours are found by pairs of lots; otherwise a task clusters a
    group. The results are the same."""
    rows = vectors.select((F.col(group).cast("string") if group else F.lit("")).alias("group"), F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > TILE:
        return _cluster_lots(rows, min_cluster_size, min_samples)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"group": rows["group"], "id": rows["id"], "cluster": hdbscan(_vectors(rows), min_cluster_size, min_samples)})

    return rows.groupBy("group").applyInPandas(run, "group string, id long, cluster int")


def _numbers(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _lot(blocks: pd.DataFrame, k: int) -> Lot:
    x = np.concatenate([np.frombuffer(r.x).reshape(r.n, -1) for r in blocks.itertuples()])
    code = np.concatenate([(r.block << 31) + np.arange(r.n) for r in blocks.itertuples()])
    return Lot(x, code, np.concatenate([np.frombuffer(r.copies, int) for r in blocks.itertuples()]), k)


def _cluster_lots(rows: DataFrame, min_cluster_size: int, min_samples: int) -> DataFrame:
    """cluster() of groups of any size. Equal vectors are one point with copies. Points are dealt to blocks of about TILE, and those
    to lots; each pair of lots gives the nearest points of its points. A least spanning tree grows from these lists as far as they
    are sure to hold the edge that is next, see grow(); parts that are left, but for the largest, look for others outside, until
    one is left. Vectors meet by two lots only; the tasks of a whole group hold ids and listed edges, no vectors."""
    k = max(NEAREST, 2 * min_samples)
    rows = rows.withColumn("group", F.coalesce(F.concat(F.lit("="), "group"), F.lit("")))
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    sizes = sizes.withColumn("fan", F.greatest(F.lit(1), F.least(F.lit(FOREST_FAN), F.floor(F.col("blocks") / LOTS)))).withColumn("lots", F.ceil(F.col("blocks") / F.col("fan")))
    dealt = rows.groupBy("group", "x").agg(F.min("id").alias("id"), F.count("*").alias("copies")).join(sizes, "group")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.col("blocks"))).withColumn("lot", F.floor(F.col("block") / F.col("fan")))
    place = F.row_number().over(Window.partitionBy("group", "block").orderBy("id", "x")) - 1
    points = written(dealt.withColumn("code", F.shiftleft("block", 31) + place).select("group", "id", "x", "copies", "block", "lot", "lots", "code"), "points")

    def pack(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("code")
        x = _vectors(points)
        if not (np.abs(x) < 1e150).all():
            raise ValueError("a component of a vector is not finite, or too large to be squared")
        packed, copies = _numbers(x, points["copies"].to_numpy(int))
        return points.iloc[:1][["group", "block", "lot", "lots"]].assign(n=len(points), x=packed, copies=copies)

    blocks = written(points.groupBy("group", "block").applyInPandas(pack, "group string, block long, lot long, lots long, n long, x binary, copies binary"), "blocks")

    def listed(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("block")
        first, within = pair["lot"] == pair["i"], pair["i"].iat[0] == pair["j"].iat[0]
        sides = [s for s in (pair[first], pair[~first]) if len(s)]
        lots = [_lot(s, k) for s in sides]
        if within:
            meet(lots[0], lots[0], False)
        elif len(lots) > 1:
            meet(*lots, True)
        out = []
        for side, lot in zip(sides, lots, strict=True):
            at = 0
            for r in side.itertuples():
                out.append((r.group, r.block, r.copies, *_numbers(*(v[at : at + r.n] for v in (lot.length, lot.other, lot.many)))))
                at += r.n
        return pd.DataFrame(out, columns=["group", "block", "copies", "length", "other", "many"])

    def nearest(lists: pd.DataFrame) -> pd.DataFrame:
        length, other, many = (np.concatenate([np.frombuffer(v, t).reshape(-1, k) for v in lists[c]], axis=0).reshape(len(lists), -1, k).swapaxes(0, 1) for c, t in (("length", float), ("other", int), ("many", int)))
        length, other, many = (v.reshape(len(v), -1) for v in (length, other, many))
        order = np.lexsort((other, length), axis=1)[:, :k]
        length, other, many = (np.take_along_axis(v, order, axis=1) for v in (length, other, many))
        counted = np.frombuffer(lists["copies"].iat[0], int)[:, None] + np.pad(many, ((0, 0), (1, 0))).cumsum(1)
        there = np.isfinite(length).sum(1)
        core = np.pad(length, ((0, 0), (1, 0)))[np.arange(len(length)), np.minimum((counted < min_samples).sum(1), there)]
        block = lists["block"].iat[0]
        return pd.DataFrame({"group": lists["group"].iat[0], "code": (block << 31) + np.arange(len(length)), "core": core, "radius": length[:, -1], "near": [list(o[:m]) for o, m in zip(other, there, strict=True)], "length": [list(o[:m]) for o, m in zip(length, there, strict=True)]})

    tasks = blocks.select("group", "lots").distinct().agg(F.sum(F.col("lots") * (F.col("lots") + 1))).first()[0]  # two for a pair, as hashes put several pairs into one
    met = blocks.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).withColumns({"i": F.least("lot", "to"), "j": F.greatest("lot", "to")})
    found = met.repartition(tasks, "group", "i", "j").groupBy("group", "i", "j").applyInPandas(listed, "group string, block long, copies binary, length binary, other binary, many binary")
    lists = written(found.groupBy("group", "block").applyInPandas(nearest, "group string, code long, core double, radius double, near array<long>, length array<double>"), "lists")

    ends = [F.least("code", "near").alias("a"), F.greatest("code", "near").alias("b")]
    cores = lists.select("group", F.col("code").alias("near"), F.col("core").alias("its"))
    edges = lists.select("group", "code", "core", F.explode(F.arrays_zip("near", "length")).alias("e")).select("group", "code", "core", "e.near", "e.length")
    edges = written(edges.join(cores, ["group", "near"]).select("group", F.greatest("length", "core", "its").alias("w"), *ends).distinct(), "edges")
    reach, taken = lists.select("group", "code", "radius"), None

    def spread(key: tuple, table: pa.Table) -> pa.Table:
        kind, w, a, b, radius = (table[c].to_numpy() for c in ("kind", "w", "a", "b", "radius"))
        order = np.argsort(a[kind == 0])
        code, radius = a[kind == 0][order], radius[kind == 0][order]
        part = np.arange(len(code))
        for wanted in (2, 1):  # edges taken before, then the listed ones
            e = np.flatnonzero(kind == wanted)
            e = e[np.lexsort((b[e], a[e], w[e]))]
            part, chosen, bound = grow(part, radius if wanted == 1 else np.full(len(code), np.inf), w[e], np.searchsorted(code, a[e]), np.searchsorted(code, b[e]))
            kept = e if wanted == 2 else np.concatenate([kept, e[chosen]])  # noqa: F821
        size = np.bincount(part, minlength=len(code))
        ask = (part != size.argmax()) & (radius < bound)
        n, m = len(code), len(kept)
        columns = {"kind": np.repeat(np.array([0, 2], np.int32), [n, m]), "w": np.append(np.where(ask, bound, 0.0), w[kept]), "a": np.append(code, a[kept]), "b": np.append(code[part], b[kept]), "radius": np.append(radius, np.zeros(m)), "ask": np.append(ask, np.zeros(m, bool))}
        return pa.table({"group": pa.array([key[0].as_py()] * (n + m)), **{c: pa.array(v) for c, v in columns.items()}})

    def asked(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"group": np.empty(0, object), "code": np.empty(0, int), "near": np.empty(0, int), "w": np.empty(0)})
        sides = [Lot(_vectors(s), s["code"].to_numpy(), np.ones(len(s), int), k, s["core"].to_numpy(), s["part"].to_numpy(), bound) for s, bound in ((left, left["w"].to_numpy()), (right, None))]
        meet(*sides, False)
        at, rank = np.nonzero(np.isfinite(sides[0].length))
        return pd.DataFrame({"group": key[0], "code": sides[0].code[at], "near": sides[0].other[at, rank], "w": sides[0].length[at, rank]})

    none = F.lit(0.0)
    while True:
        parts = reach.select("group", F.lit(0).alias("kind"), none.alias("w"), F.col("code").alias("a"), F.col("code").alias("b"), "radius")
        parts = parts.unionByName(edges.select("group", F.lit(1).alias("kind"), "w", "a", "b", none.alias("radius")))
        parts = parts.unionByName(taken.select("group", "kind", "w", "a", "b", "radius")) if taken is not None else parts
        state = written(parts.groupBy("group").applyInArrow(spread, "group string, kind int, w double, a long, b long, radius double, ask boolean"), "parts")
        taken = state.where("kind = 2")
        open_ = state.where("ask").count()
        if not open_:
            break
        known = points.join(state.where("kind = 0").select("group", F.col("a").alias("code"), F.col("b").alias("part"), "w", "radius", "ask"), ["group", "code"]).join(lists.select("group", "code", "core"), ["group", "code"])
        known = written(known.select("group", "code", "x", "core", "part", "lot", "lots", "w", "radius", "ask"), "known")
        several = F.lit(-(-open_ // (TILE * FOREST_FAN))).cast("long")
        asking = written(known.where("ask"), "asking")
        left = asking.withColumn("i", F.pmod(F.xxhash64("code"), several)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
        right = known.join(asking.select(F.col("group").alias("its")).distinct(), F.col("group") == F.col("its"), "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), several - 1))).withColumn("j", F.col("lot"))
        keys, shown = ["group", "i", "j"], ["group", "i", "j", "code", "x", "core", "part", "w"]
        heard = left.select(*shown).groupBy(*keys).cogroup(right.select(*shown).groupBy(*keys)).applyInPandas(asked, "group string, code long, near long, w double")
        heard = written(heard, "heard")
        edges = edges.unionByName(heard.select("group", "w", *ends))
        kth = F.get(F.sort_array(F.collect_list(heard["w"])), F.lit(k - 1))
        farther = heard.groupBy("group", "code").agg(kth.alias("kth"))
        reach = known.join(farther, ["group", "code"], "left").select("group", "code", F.when(F.col("ask"), F.least("w", "kth")).otherwise(F.col("radius")).alias("radius"))

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        named, edges = rows[rows["kind"] == 0].sort_values(["id", "a"]), rows[rows["kind"] == 2]
        code, first, at = np.unique(named["a"].to_numpy(), return_index=True, return_inverse=True)
        w, own = named["w"].to_numpy(), np.arange(len(named))
        copy = own != first[at]  # as near as their core to the first of their kind
        w = np.append(edges["w"].to_numpy(), w[copy])
        a, b = (np.append(first[np.searchsorted(code, edges[c].to_numpy())], v[copy]) for c, v in (("a", first[at]), ("b", own)))
        order = np.lexsort((b, a, w))
        listed = list(zip(w[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True))
        return pd.DataFrame({"group": named["group"], "id": named["id"], "cluster": cut_tree(len(named), listed, min_cluster_size)})

    single = points.where("copies = 1").select("group", F.lit(0).alias("kind"), none.alias("w"), F.col("code").alias("a"), F.lit(0).cast("long").alias("b"), "id")
    repeated = points.where("copies > 1").join(lists.select("group", "code", "core"), ["group", "code"]).select("group", "x", "code", "core")
    repeated = rows.join(repeated, ["group", "x"]).select("group", F.lit(0).alias("kind"), F.col("core").alias("w"), F.col("code").alias("a"), F.lit(0).cast("long").alias("b"), "id")
    whole = single.unionByName(repeated).unionByName(taken.select("group", "kind", "w", "a", "b", F.lit(0).cast("long").alias("id")))
    out = whole.groupBy("group").applyInPandas(label, "group string, id long, cluster int")
    return out.select(F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias("group"), "id", "cluster")


def update_clusters(new: DataFrame, existing: DataFrame, partition: str, threshold: float = 0.85, min_cluster_size: int = 3, min_samples: int = 2) -> DataFrame:
    """Sequential assignment: (part, id, cluster, similarity) of each new vector (id, ts, embedding) in order of time and id.

    A vector joins the most similar cluster (cluster, centroid, size) if that reaches the threshold, and moves its centroid,
    as a running mean, before the next one is judged. What joins none is clustered by density at the end; such clusters are
    numbered on from the greatest of the part, their similarity is 0, and noise is -1. The fold is inherently serial, so one task
    makes it for each value of ``partition`` (a topic or section, a column of both tables); it reads the part in order, batch by batch,
    and holds its clusters alone. What it leaves goes to cluster(), in order of arrival.
    """
    part = F.coalesce(F.col(partition).cast("string"), F.lit(""))
    rows = new.select(part.alias("part"), "id", "ts", F.col("embedding").cast("array<double>").alias("x"), F.lit(0).cast("long").alias("n"))
    seeds = existing.select(part.alias("part"), F.col("cluster").cast("long").alias("id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("centroid").alias("x"), F.col("size").cast("long").alias("n"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names, sums, at = None, [], None, 0
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.part != now:
                    now, names, sums, at = r.part, [], [], 0
                if r.x is None:
                    raise ValueError("a vector is null; encode all rows first")
                x, found, best = np.asarray(r.x, float), -1, 0.0
                if r.n > 0:
                    names.append(r.id)
                    sums.append(x * r.n)
                    continue
                if at == 0:
                    sums = np.stack(sums) if sums else None
                if sums is not None:
                    lengths = np.linalg.norm(sums, axis=1) * np.linalg.norm(x)
                    similar = np.divide(sums @ x, lengths, out=np.zeros(len(sums)), where=lengths > 0)
                    i = int(np.argmax(similar))
                    if similar[i] > 0 and similar[i] >= threshold:
                        found, best = int(names[i]), float(similar[i])
                        sums[i] += x
                out.append((r.part, at, r.id, found, best, None if found >= 0 else r.x, max(names, default=-1) + 1))
                at += 1
            yield pd.DataFrame(out, columns=["part", "at", "id", "cluster", "similarity", "x", "top"])

    ordered = rows.unionByName(seeds).repartition("part").sortWithinPartitions("part", F.col("n") == 0, F.asc_nulls_last("ts"), F.asc_nulls_last("id"))
    folded = written(ordered.mapInPandas(fold, "part string, at long, id long, cluster long, similarity double, x array<double>, top long"), "folded")
    left = folded.where("x is not null")
    found = cluster(left.select("part", "at", "x"), "part", "at", "x", min_cluster_size, min_samples)
    found = found.select(F.col("group").alias("part"), F.col("id").alias("at"), F.col("cluster").cast("long").alias("label"))
    numbered = left.join(found, ["part", "at"]).withColumn("cluster", F.when(F.col("label") >= 0, F.col("top") + F.col("label")).otherwise(-1))
    shown = ["part", "id", "cluster", "similarity"]
    return folded.where("x is null").select(*shown).unionByName(numbered.select(*shown))
