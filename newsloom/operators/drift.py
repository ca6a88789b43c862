"""Drift between a baseline and a current window of documents and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.vectors import long_form

TINY = 1e-6


def dims(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, mean, std): population statistics of each dimension."""
    return vectors.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def embedding_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    """One row from two dims() tables: distance of the means, relative change of the mean variance, cosine distance."""
    j = base.join(current.select("dim", F.col("mean").alias("m"), F.col("std").alias("s")), "dim")
    a = j.agg(*(F.sum(x).alias(n) for n, x in (("d2", (F.col("m") - F.col("mean")) ** 2), ("ab", F.col("m") * F.col("mean")), ("aa", F.col("mean") ** 2), ("bb", F.col("m") ** 2))), F.avg(F.col("std") ** 2).alias("v0"), F.avg(F.col("s") ** 2).alias("v1"))
    return a.select(F.sqrt("d2").alias("mean_shift"), (F.abs(F.col("v1") - F.col("v0")) / (F.col("v0") + TINY)).alias("variance_change"), (1 - F.col("ab") / (F.sqrt("aa") * F.sqrt("bb") + TINY)).alias("cosine_distance"))


def topics(docs: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(topic, p): share of all documents in each cluster; noise (-1) counts in the total alone."""
    n = docs.groupBy(F.col(cluster).alias("topic")).agg(F.count("*").alias("n"))
    total = F.broadcast(docs.agg(F.count("*").alias("total")))
    return n.where("topic >= 0").join(total).select("topic", (F.col("n") / F.col("total")).alias("p"))


def topic_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    """One row: Jensen-Shannon distance of the smoothed distributions (natural logarithm), and the shares of new and gone
    topics; zeros if there is no current topic."""
    j = base.join(current.withColumnRenamed("p", "q"), "topic", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    s = F.broadcast(j.agg(F.sum(F.col("p") + 1e-10).alias("sp"), F.sum(F.col("q") + 1e-10).alias("sq"), F.count_if(F.col("q") > 0).alias("now"), F.count_if(F.col("p") > 0).alias("then")))
    n = j.join(s).select("now", "then", "p", "q", ((F.col("p") + 1e-10) / F.col("sp")).alias("a"), ((F.col("q") + 1e-10) / F.col("sq")).alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    js = 0.5 * F.col("a") * F.log(F.col("a") / m) + 0.5 * F.col("b") * F.log(F.col("b") / m)
    r = n.agg(F.sqrt(F.greatest(F.sum(js), F.lit(0.0))).alias("js"), F.count_if((F.col("p") == 0) & (F.col("q") > 0)).alias("new"), F.count_if((F.col("p") > 0) & (F.col("q") == 0)).alias("gone"), F.first("now").alias("now"), F.first("then").alias("then"))
    some = F.coalesce(F.col("now"), F.lit(0)) > 0
    return r.select(F.when(some, F.col("js")).otherwise(0.0).alias("js_distance"), F.when(some, F.col("new") / F.greatest("now", F.lit(1))).otherwise(0.0).alias("new_topics"), F.when(some, F.col("gone") / F.greatest("then", F.lit(1))).otherwise(0.0).alias("gone_topics"))


def volume_baseline(windows: DataFrame) -> DataFrame:
    """One row from counts (n): mean and population deviation; a deviation of 0 or no window gives 1."""
    return windows.agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_volume"), F.coalesce(F.nullif(F.stddev_pop("n"), F.lit(0.0)), F.lit(1.0)).alias("std_volume"))


def volume_drift(base: DataFrame, n: Column | int) -> DataFrame:
    v = n if isinstance(n, Column) else F.lit(n)
    return base.select(((v - F.col("avg_volume")) / (F.col("avg_volume") + TINY)).alias("volume_change"), ((v - F.col("avg_volume")) / (F.col("std_volume") + TINY)).alias("volume_z"))


def ratio_baseline(clusters: DataFrame) -> DataFrame:
    """One row from clusters (size, coordination_ratio): statistics over sizes above 1, with 1 and 0.5 as defaults."""
    return clusters.where("size > 1").agg(F.coalesce(F.avg("coordination_ratio"), F.lit(1.0)).alias("avg_ratio"), F.coalesce(F.nullif(F.stddev_pop("coordination_ratio"), F.lit(0.0)), F.lit(0.5)).alias("std_ratio"))


def ratio_drift(base: DataFrame, clusters: DataFrame) -> DataFrame:
    j = clusters.where("size > 1").join(F.broadcast(base))
    r = j.agg(F.avg("coordination_ratio").alias("now"), F.avg((F.col("coordination_ratio") > F.col("avg_ratio") + 2 * F.col("std_ratio")).cast("double")).alias("rate"), F.first("avg_ratio").alias("a"), F.first("std_ratio").alias("s"))
    return r.select(F.coalesce(F.abs(F.col("now") - F.col("a")) / (F.col("s") + TINY), F.lit(0.0)).alias("ratio_change"), F.coalesce("rate", F.lit(0.0)).alias("alert_rate"))


def overall(measures: DataFrame, cosine: float = 0.15, js: float = 0.2, z: float = 3.0, ratio: float = 0.5) -> DataFrame:
    """measures (cosine_distance, js_distance, volume_z, ratio_change) with score, the greatest share of a threshold, and
    severity: high from 1.5, medium from 1, low from 0.7."""
    score = F.greatest(F.col("cosine_distance") / cosine, F.col("js_distance") / js, F.abs("volume_z") / z, F.col("ratio_change") / ratio)
    return measures.withColumn("score", score).withColumn("severity", F.when(F.col("score") >= 1.5, "high").when(F.col("score") >= 1.0, "medium").when(F.col("score") >= 0.7, "low").otherwise("none"))


def should_retrain(history: DataFrame, last: int = 3) -> DataFrame:
    """One row (retrain, reason) from history (seq, severity, cosine_distance, js_distance): the newest ``last`` rows decide."""
    h = history.orderBy(F.desc("seq")).limit(last)
    a = h.agg(F.count("*").alias("n"), F.every(F.col("severity").isin("medium", "high")).alias("a"), F.every(F.col("cosine_distance") > 0.12).alias("b"), F.every(F.col("js_distance") > 0.16).alias("c"))
    enough = F.col("n") >= last
    reason = F.when(~enough, "Not enough data").when(F.col("a"), "consistent drift").when(F.col("b"), "embedding drift").when(F.col("c"), "topic drift").otherwise("no drift")
    return a.select((enough & (F.col("a") | F.col("b") | F.col("c"))).alias("retrain"), reason.alias("reason"))


def smooth(base: DataFrame, current: DataFrame, decay: float = 0.1) -> DataFrame:
    """dims() of the baseline moved towards the current ones."""
    c = current.select("dim", F.col("mean").alias("m"), F.col("std").alias("s"))
    return base.join(c, "dim").select("dim", ((1 - decay) * F.col("mean") + decay * F.col("m")).alias("mean"), ((1 - decay) * F.col("std") + decay * F.col("s")).alias("std"))


def first_cluster(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster_id): the first cluster (by ord) that a document is a member of, -1 without one. members (cluster_id, ord,
    id) has a row for each membership, so no cluster's documents are gathered."""
    first = members.groupBy("id").agg(F.min_by("cluster_id", "ord").alias("cluster_id"))
    return docs.select("id").join(first, "id", "left").select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def centroid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return long_form(vectors.withColumn("__all", F.lit(0)), "__all", vector).groupBy("dim").agg(F.avg("x").alias("value"))
