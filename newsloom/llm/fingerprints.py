"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import filled, words

SHINGLE = 5
#: Hashes kept. A likeness j is estimated with a standard error of sqrt(j (1 - j) / K): 0.044 at most.
K = 128
#: Order buckets for each shuffle partition when documents are put in sequence.
BUCKETS = 2


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, width: int = SHINGLE, k: int = K) -> Column:
    """The k least hashes of the distinct word shingles, in order, from the hashes of the words.

    A text with fewer words than a shingle is one shingle; one without words has an empty sketch. ``hashes`` must be a
    materialised column, since every shingle reads it ``width`` times.
    """
    n = F.size(hashes)
    whole = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width))))
    few = F.array(F.xxhash64(F.array_join(hashes.cast("array<string>"), " ")))
    shingles = F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, few).otherwise(whole)
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets of shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Estimated resemblance (0 to 1), from two materialised columns; exact where the union fits a sketch. Two empty
    sketches are alike (1)."""
    union = merge(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(float(1 << 63)) + 1) / F.lit(float(1 << 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (0 to 1); 1 where a is empty."""
    both = likeness(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, sketch) -> (keys, sketch): the sketch of the union of each group's shingles, from the sketches of its parts.

    Hashes are ranked one row each and cut to k before and after the shuffle, so a hot group moves k hashes from each task
    and no group is gathered. Null keys are a group; a group of empty sketches has an empty one; an empty table gives none.
    """
    hashes = sketches.select(*keys, F.explode_outer("sketch").alias("__h")).distinct()
    least = Window.partitionBy(*keys).orderBy(F.col("__h").asc_nulls_last())
    return hashes.withColumn("__i", F.row_number().over(least)).where(F.col("__i") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias("sketch"))


def encode(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def fingerprint(docs: DataFrame, text: str = "text", width: int = SHINGLE, k: int = K) -> DataFrame:
    """docs with a column sketch (array<bigint>); null texts are empty; no shuffle."""
    hashed = docs.withColumn("__hashes", word_hashes(F.col(text)))
    return hashed.withColumn("sketch", sketch_of(F.col("__hashes"), width, k)).drop("__hashes")


def in_sequence(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs (doc_id, text, ...) dealt so that descending ids lie side by side: (rows with b and ghost, partitioning, order).

    Ids are cut at approximate quantiles to buckets, and each bucket gets a ghost, the first document of the next non-empty
    bucket (of the first, after the last): so every document finds its successor inside its own bucket and no task sees
    more than one bucket. Equal ids stand in the order of their texts; null ids come last.
    """
    spark = docs.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("__id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    cuts = docs.agg(F.percentile_approx("__id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted(set(cuts))
    step = math.isqrt(len(bounds)) + 1
    ids = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    upto = lambda array: F.size(F.filter(array, lambda c: c <= F.col("__id")))
    whole = upto(ids(bounds[step - 1 :: step]))  # runs of bounds that lie at or below the id; then its place in the next run
    bucket = whole * step + upto(F.slice(ids(bounds), whole * step + 1, step))
    dealt = docs.withColumn("b", bucket)
    heads = {r.b: r.head for r in dealt.groupBy("b").agg(F.max("__id").alias("head")).collect()}  # n rows at most
    order = sorted(heads, reverse=True)
    following = dict(zip(order, [*order[1:], *order[:1]], strict=True))
    ghosts = dealt.limit(0).withColumn("ghost", F.lit(True))
    if order:
        wanted = spark.range(len(order)).select(F.col("id").cast("int").alias("i"))
        pick = lambda values, t: F.get(F.array(*map(F.lit, values)).cast(f"array<{t}>"), F.col("i"))
        wanted = wanted.select(pick([heads[following[b]] for b in order], "bigint").alias("__id"), pick(order, "int").alias("to"))
        first = Window.partitionBy("to").orderBy("text")
        ghosts = dealt.join(F.broadcast(wanted), "__id").withColumn("rank", F.row_number().over(first)).where("rank = 1").withColumn("b", F.col("to")).select(*dealt.columns).withColumn("ghost", F.lit(True))
    # ranges of buckets, as hashes of so few would put several into one task; what is grouped by b needs no further shuffle
    rows = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartitionByRange(n // BUCKETS, "b")
    return rows, F.col("b"), [F.col("ghost"), F.col("__id").desc(), F.col("text")]


def edited_fingerprints(docs: DataFrame, width: int = SHINGLE, k: int = K) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, containment,
    n_shingles), a row for each row of docs.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document's, by descending doc_id, after the last the first. Null texts are empty; a text without words has an empty
    sketch, alike (1) only to another empty one. Of rows with equal ids, the one with the lesser text comes first; a sole
    document follows itself. An empty table gives no rows; other columns are ignored.
    """
    plain = docs.select("doc_id", filled(F.col("text")).alias("text"))
    rows, by, order = in_sequence(plain)
    w = Window.partitionBy(by).orderBy(*order)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.lead("text").over(w), F.lit(1), cut))
    both = rows.withColumn("edited", edited)
    both = both.withColumn("__h", word_hashes(F.col("text"))).withColumn("__e", word_hashes(F.col("edited")))
    sketched = both.select("doc_id", "__id", "b", "ghost", "text", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sketch_of(F.col("__h"), width, k).alias("s"), sketch_of(F.col("__e"), width, k).alias("e"))
    followed = sketched.withColumn("next", F.lead("s").over(w)).where(~F.col("ghost"))
    a, e, following = F.col("s"), F.col("e"), F.col("next")
    return followed.select("doc_id", "n_chars", "edited_sha256", encode(a).alias("fingerprint"), encode(e).alias("edited_fingerprint"), likeness(a, e, k).alias("near_edited"), likeness(a, following, k).alias("near_next"), containment(a, e, k).alias("contained_in_edited"), distinct_shingles(a, k).alias("n_shingles"))

