"""The batch run: articles to clusters, signals and a summary, written as JSON in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import clustering, metrics, signals, vectors
from newsloom.settings import Settings
from newsloom.sources.articles import write_json


def assigned(articles: DataFrame, min_cluster_size: int = 3, min_samples: int = 2) -> DataFrame:
    """articles (id, embedding, ...) with cluster_id by density, -1 for noise; a cluster_id that was there is replaced."""
    labels = clustering.cluster(articles.select("id", "embedding"), None, "id", "embedding", min_cluster_size, min_samples)
    return articles.drop("cluster_id").join(labels.select("id", F.col("cluster").cast("long").alias("cluster_id")), "id")


def clusters(members: DataFrame) -> DataFrame:
    """A row for each cluster of members: metrics, topic, dominant pattern, frame and headline; noise is left out."""
    inside = members.where("cluster_id >= 0")
    order = ("published_at", "id")
    table = metrics.cluster_metrics(inside)
    for part in (metrics.headline(inside).drop("first_seen", "last_seen"), metrics.first_mode(inside, "cluster_id", "pattern_topic", order, "topic"), metrics.first_mode(inside, "cluster_id", "pattern_type", order, "dominant_pattern"), metrics.common_frame(inside)):
        table = table.join(part, "cluster_id", "left")
    return table


def records(table: DataFrame, members: DataFrame) -> DataFrame:
    """Signals of clusters() in full: id, title, description, headline, topic, metrics, pattern, stage, frame, and the fields of
    a review, empty."""
    inside = members.where("cluster_id >= 0")
    fired = signals.detect(table, inside, vectors.coherence(inside, "cluster_id"))
    c = F.col
    about = table.select("cluster_id", c("headline"), "topic", F.struct(c("size").alias("cluster_size"), "unique_outlets", "source_diversity", F.round("velocity", 2).alias("velocity"), F.round("bias_spread", 3).alias("bias_spread")).alias("metrics"), c("dominant_pattern").alias("detected_pattern"), c("stage").alias("narrative_stage"), c("common_frame").alias("frame_text"))
    named = F.initcap(F.regexp_replace("signal_type", "_", " "))
    title = F.when(F.length("topic") > 0, F.concat(named, F.lit(": "), "topic")).otherwise(named)
    described = F.format_string("%d articles of %d outlets, %s an hour.", c("metrics.cluster_size"), c("metrics.unique_outlets"), c("metrics.velocity").cast("string"))
    return fired.join(about, "cluster_id").select(c("signal_id").alias("id"), "cluster_id", "signal_type", "severity", title.alias("title"), described.alias("description"), "headline", "topic", "metrics", "detected_pattern", "narrative_stage", "frame_text", F.lit(False).alias("reviewed"), F.lit(None).cast("string").alias("analyst_notes"), F.lit(None).cast("boolean").alias("false_positive"))


def run(articles: DataFrame, out: str) -> dict[str, int]:
    """Cluster articles, detect signals, and write ``out``/members, clusters, signals and summary. Each is written once and read
    again by the next; only the summary's five numbers reach the driver."""
    spark = articles.sparkSession
    settings = Settings.of(spark)
    assigned(articles, settings.min_cluster_size, settings.min_samples).select("id", "cluster_id").write.mode("overwrite").parquet(f"{out}/members")
    members = articles.drop("cluster_id").join(spark.read.parquet(f"{out}/members"), "id")
    table = clusters(members)
    write_json(table, f"{out}/clusters")
    write_json(records(spark.read.schema(table.schema).json(f"{out}/clusters"), members), f"{out}/signals")
    count = spark.read.parquet(f"{out}/members").agg(F.count("*").alias("total_articles"), F.count_if(F.col("cluster_id") < 0).alias("noise_articles"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("total_clusters"))
    fired = spark.read.schema("severity string").json(f"{out}/signals").agg(F.count("*").alias("total_signals"), F.count_if(F.col("severity").isin("high", "critical")).alias("urgent_signals"))
    summary = count.join(fired)  # one row each
    write_json(summary, f"{out}/summary")
    return summary.first().asDict()
