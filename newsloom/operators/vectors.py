"""Vectors: similarity, centroids, coherence, similar clusters, assignment, text encoding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.arrays import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n != 0, n))


def long_form(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    return vectors.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(vectors: DataFrame, key: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, dim, value): the mean of each dimension."""
    return long_form(vectors, key, vector).groupBy(key, "dim").agg(F.avg("x").alias("value"))


def as_arrays(cells: DataFrame, key: str, value: str = "value", out: str = "centroid") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("dim", value)))
    return cells.groupBy(key).agg(F.transform(ordered, lambda c: c[value]).alias(out))


def unit_cells(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(keys, dim, x): the dimensions of each vector over its length; a zero vector has zeros. The length is computed once for
    a vector and carried beside its dimensions."""
    lengths = vectors.select(*keys, F.col(vector).alias("v"), norm(F.col(vector)).alias("length"))
    return lengths.select(*keys, "length", F.posexplode("v").alias("dim", "x")).select(*keys, "dim", F.when(F.col("length") == 0, 0.0).otherwise(F.col("x").cast("double") / F.when(F.col("length") != 0, F.col("length"))).alias("x"))


def coherence(vectors: DataFrame, key: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, coherence): the mean cosine of all pairs, 1 for a single vector. With unit vectors u, k of them non-zero, it is
    (|sum u|^2 - k) / (n (n - 1)): linear in the vectors, and in their width."""
    sums = unit_cells(vectors, [key], vector).groupBy(key, "dim").agg(F.sum("x").alias("s")).groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    sizes = vectors.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.exists(vector, lambda x: x != 0)).alias("k"))
    pairs = F.col("n") * (F.col("n") - 1)
    return sizes.join(sums, key).select(key, F.when(F.col("n") < 2, 1.0).otherwise((F.col("sq") - F.col("k")) / F.when(pairs != 0, pairs)).alias("coherence"))


#: Centroids that are held against a vector at once, and bytes of them that are broadcast at once.
CENTERS_AT_ONCE = 4096
CENTERS_BYTES = 64 << 20


def shape_of(vectors: DataFrame, key: str, vector: str) -> tuple[int, int]:
    """(number of keys, width), from one narrow scan."""
    size = vectors.agg(F.count_distinct(key).alias("n"), F.max(F.size(vector)).alias("d")).first()
    return size.n, size.d or 0


def center_blocks(centers: DataFrame, key: str, extra: tuple[str, ...], shape: tuple[int, int]) -> list[DataFrame]:
    """centers (key, centroid, extra) as tables of rows ``centers``, arrays of at most about CENTERS_AT_ONCE structs (k, c,
    length, extra); no table is larger than CENTERS_BYTES, so each can be broadcast."""
    rows, tables = max(1, -(-shape[0] // CENTERS_AT_ONCE)), max(1, -(-shape[0] * shape[1] * 8 // CENTERS_BYTES))
    one = F.struct(F.col(key).alias("k"), F.col("centroid").alias("c"), norm(F.col("centroid")).alias("length"), *extra)
    dealt = centers.select(F.pmod(F.xxhash64(key), F.lit(max(rows, tables))).alias("block"), one.alias("x")).groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("centers"))
    return [dealt.where(F.col("block") % tables == t).select("centers") for t in range(tables)]


def against(rows: DataFrame, centers: DataFrame, key: str, take: Callable[[Column], Column], shape: tuple[int, int], extra: tuple[str, ...] = ()) -> DataFrame:
    """rows with ``taken``, what ``take`` gives for an array of centroids, a row for each block of them; a stated set of
    centroids against all rows, in blocks."""
    parts = [rows.join(F.broadcast(t)).withColumn("taken", take(F.col("centers"))).drop("centers") for t in center_blocks(centers, key, extra, shape)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cosine_to(vector: Column, length: Column, x: Column) -> Column:
    """Cosine of a vector to a centroid struct, both lengths known."""
    both = length * x["length"]
    return F.when(both == 0, 0.0).otherwise(dot(vector, x["c"]) / F.when(both != 0, both))


def similar_clusters(vectors: DataFrame, key: str = "label", threshold: float = 0.8, vector: str = "embedding") -> DataFrame:
    """(a, b, similarity): pairs of clusters whose centroids are at least so similar. Each centroid is held against blocks of
    centroids; only pairs that reach the threshold become rows. More than CENTERS_AT_ONCE centroids go to similar_pairs(), which
    compares fewer and finds the same."""
    c = as_arrays(centroids(vectors, key, vector), key)
    shape = shape_of(vectors, key, vector)
    if shape[0] > CENTERS_AT_ONCE and threshold > 0:
        return similar_pairs(c, key, threshold)
    similar = lambda length: lambda x: F.struct(x["k"].alias("b"), cosine_to(F.col("centroid"), length, x).alias("similarity"))
    take = lambda centers: let(norm(F.col("centroid")), lambda n: F.filter(F.transform(F.filter(centers, lambda x: x["k"] > F.col(key)), similar(n)), lambda x: x["similarity"] >= threshold))
    return against(c, c, key, take, shape).select(F.col(key).alias("a"), F.explode("taken").alias("x")).select("a", "x.b", "x.similarity")


#: Pivots of similar_pairs() at most.
PIVOTS = 256


def near_candidates(centers: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, u, v): the pairs (key, centroid) that the triangle inequality cannot tell to be less similar than ``threshold``, over 0.

    The angle is a metric on directions. Each centroid belongs to the nearest of at most PIVOTS of them, drawn by hash. Two within the
    angle of the threshold differ by no more than it in their angles to any pivot, so the second lies within the first's
    group's radius and that angle of the group's pivot; it is held against these groups alone. A pair meets once, in the group of its
    lesser key. Zero centroids are similar to none.
    """
    within = math.acos(min(1.0, threshold)) + 1e-7  # for rounding: the similarity itself decides
    some = centers.select(F.col(key).alias("k"), F.col("centroid").alias("c")).where(F.exists("c", lambda x: x != 0))
    n = some.count()
    drawn = some.orderBy(F.xxhash64("c"), "k").limit(min(PIVOTS, max(1, math.isqrt(n)))).collect()
    pivots = np.array([r.c for r in drawn] or [[1.0]], float)  # without rows any pivot does
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True).clip(1e-300)

    @F.pandas_udf("array<double>")
    def angles(cs: pd.Series) -> pd.Series:
        x = np.stack(cs.to_numpy())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(np.arccos(np.clip(x @ pivots.T, -1, 1))))

    told = some.withColumn("g", angles("c")).withColumn("near", F.array_min("g")).withColumn("home", F.array_position("g", F.col("near")).cast("int") - 1)
    radius = dict(told.groupBy("home").agg(F.max("near").alias("r")).collect())  # a row for each pivot
    reach = F.array(*(F.lit(radius.get(i, -math.inf) + within) for i in range(len(pivots))))
    groups = F.filter(F.sequence(F.lit(0), F.lit(len(pivots) - 1)), lambda i: F.col("g")[i] <= reach[i])
    guests = told.select(F.col("k").alias("b"), F.col("c").alias("v"), "g", F.explode(groups).alias("home")).select("b", "v", "home", F.col("g")[F.col("home")].alias("angle"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("near") - F.col("angle")) <= within)
    return told.select(F.col("k").alias("a"), F.col("c").alias("u"), "home", "near").join(guests, "home").where(near).select("a", "b", "u", "v")


def similar_pairs(centers: DataFrame, key: str = "label", threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity): the pairs of (key, centroid) whose cosine reaches ``threshold``, over 0; exact, see near_candidates()."""
    return near_candidates(centers, key, threshold).select("a", "b", cosine(F.col("u"), F.col("v")).alias("similarity")).where(F.col("similarity") >= threshold)


def nearest_centroid(vectors: DataFrame, centers: DataFrame, id_: str = "vec_id", key: str = "label", threshold: float = 0.85, vector: str = "embedding") -> DataFrame:
    """(id, key, similarity): the most similar frozen centroid if it reaches the threshold, ties to the least key. centers
    (key, centroid) are held against the vectors in blocks; lengths are computed once on both sides."""
    best = lambda centers: let(norm(F.col(vector)), lambda n: F.array_max(F.transform(centers, lambda x: F.struct(cosine_to(F.col(vector), n, x).alias("s"), (-x["k"]).alias("nk")))))
    shape = shape_of(centers, key, "centroid")
    b = against(vectors.select(F.col(id_).alias("id"), vector), centers, key, best, shape).select("id", F.col("taken").alias("b"))
    if shape[0] > CENTERS_AT_ONCE:
        b = b.groupBy("id").agg(F.max("b").alias("b"))
    return b.select("id", (-F.col("b.nk")).alias(key), F.col("b.s").alias("similarity")).where(F.col("similarity") >= threshold)


def top_k(vectors: DataFrame, query: list[float], k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors most similar to a query vector (exact), ties to the lesser id."""
    q = F.array(*map(F.lit, map(float, query)))
    return vectors.select(F.col(id_).alias("id"), cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def hashed_encoder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder that needs no model: signed hashed counts of words, of length 1."""
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = crc32(word.encode())
                out[row, h % dim] += 1 if h >> 31 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths == 0, 1, lengths)

    return encode


def embed(rows: DataFrame, text: str = "text", encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_encoder, batch: int = 32) -> DataFrame:
    """rows with embedding (array<double>). ``encoder`` builds the encoder, once for each task; null texts are empty."""

    @F.pandas_udf("array<double>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            filled = texts.fillna("").tolist()
            yield pd.Series([list(v) for at in range(0, len(filled), batch) for v in encode(filled[at : at + batch])])

    return rows.withColumn("embedding", encoded(F.col(text)))
