"""The replay: articles in windows of time, each clustered apart, with its signals and what changed since the window before.

All windows are computed side by side in one plan; nothing loops over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.time_windows import parse_window
from newsloom.operators import clustering, metrics, signals, vectors, windows
from newsloom.sources.articles import write_json


def windowed(articles: DataFrame, size: str = "4h", step: str | None = None, cluster: str | None = None) -> DataFrame:
    """articles in each window that holds them: w, lo (start of the first window), the cluster within the window (-1: noise) and
    key, which names both. ``cluster`` is a column of articles to take instead of clustering by density."""
    placed = windows.assign(articles, "published_at", size, step)
    if cluster is None:
        labels = clustering.cluster(placed.select("w", "id", "embedding"), "w", "id")
        placed = placed.join(labels.select(F.col("group").cast("long").alias("w"), "id", F.col("cluster").alias("__c")), ["w", "id"])
    else:
        placed = placed.withColumn("__c", F.col(cluster))
    return placed.withColumn("__c", F.col("__c").cast("long")).withColumn("key", F.concat_ws(":", F.col("w").cast("string"), F.col("__c").cast("string")))


def found(placed: DataFrame) -> DataFrame:
    """(w, name, signal_type, severity): the signals of each window's clusters, by key, and the transitions of each topic since
    the last window that isn't empty, all clusters of a topic in a window taken together."""
    inside = placed.where("__c >= 0")
    fired = signals.detect(metrics.cluster_metrics(inside, "key"), inside, vectors.coherence(inside, "key"), "key")
    own = fired.select(F.split("key", ":")[0].cast("long").alias("w"), F.col("key").alias("name"), "signal_type", "severity")
    told = inside.where(F.length("pattern_topic") > 0).withColumn("story", F.struct("w", F.col("pattern_topic").alias("topic")))
    changed = signals.transitions(metrics.cluster_metrics(told, "story").select("story.w", "story.topic", "stage", "velocity"))
    return own.unionByName(changed.select("w", F.col("topic").alias("name"), "signal_type", "severity"))


def details(placed: DataFrame, signals_: DataFrame, size: str = "4h", step: str | None = None) -> DataFrame:
    """(w, window_start, window_end, articles, clusters, signals) of each window that isn't empty."""
    size_us, step_us = parse_window(size), parse_window(step or size)
    start = F.col("lo") + F.col("w") * step_us
    per = placed.groupBy("w", "lo").agg(F.count("*").alias("articles"), F.count_distinct(F.when(F.col("__c") >= 0, F.col("__c"))).alias("clusters"))
    n = signals_.groupBy("w").agg(F.count("*").alias("signals"))
    return per.join(n, "w", "left").select("w", windows.at(start).alias("window_start"), windows.at(start + size_us).alias("window_end"), "articles", "clusters", F.coalesce("signals", F.lit(0)).alias("signals"))


def run(articles: DataFrame, out: str, size: str = "4h", step: str | None = None) -> dict[str, int]:
    """Replay articles into ``out``/members, signals, windows and summary; only the summary's three numbers reach the driver."""
    spark = articles.sparkSession
    windowed(articles, size, step).drop("embedding").write.mode("overwrite").parquet(f"{out}/members")
    members = spark.read.parquet(f"{out}/members")
    vectors_ = articles.select("id", "embedding")
    found(members.join(vectors_, "id")).repartition("w").write.mode("overwrite").partitionBy("w").json(f"{out}/signals")
    fired = spark.read.schema("name string, signal_type string, severity string, w long").json(f"{out}/signals")
    write_json(details(members, fired, size, step), f"{out}/windows")
    told = spark.read.schema("articles long, clusters long, signals long").json(f"{out}/windows")
    summary = told.agg(F.count("*").alias("windows_processed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("clusters", "signals")))
    write_json(summary, f"{out}/summary")
    return summary.first().asDict()
