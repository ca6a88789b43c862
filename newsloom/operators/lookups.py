"""Lookups of clusters and signals, as a service or a dashboard asks for them. What doesn't exist gives no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.articles import iso
from newsloom.operators import vectors


def cluster_articles(table: DataFrame, articles: DataFrame, cluster_id: int) -> DataFrame:
    """The articles of one cluster in order of time, each beside the cluster's topic, size and stage. The filter reaches the scan
    of both sides; no article is gathered into an array."""
    about = table.where(F.col("cluster_id") == cluster_id).select("cluster_id", F.coalesce("topic", F.lit("Unknown")).alias("topic"), "size", "stage")
    inside = articles.where(F.col("cluster_id") == cluster_id)
    rows = inside.join(F.broadcast(about), "cluster_id")  # one row
    return rows.orderBy("published_at", "id").select("cluster_id", "topic", "size", "stage", "id", "outlet", "outlet_type", "outlet_bias", "title", iso(F.col("published_at")).alias("published_at"), "wire_source")


def nearest_members(members: DataFrame, cluster_id: int, limit: int = 20, id_: str = "id", key: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """(id, similarity): the members of one cluster most similar to its centroid, ties to the lesser id; ``limit`` is the
    feature."""
    inside = members.where(F.col(key) == cluster_id).select(id_, key, vector)
    center = vectors.as_arrays(vectors.centroids(inside, key, vector), key)
    near = inside.join(F.broadcast(center), key).select(id_, vectors.cosine(F.col(vector), F.col("centroid")).alias("similarity"))  # one row
    return near.orderBy(F.desc("similarity"), id_).limit(limit)


def overview(table: DataFrame) -> DataFrame:
    """(cluster_id, topic, size, outlets, stage, velocity, bias_spread, duration_hours) of each cluster."""
    return table.select("cluster_id", F.coalesce("topic", F.lit("Unknown")).alias("topic"), "size", F.col("unique_outlets").alias("outlets"), "stage", "velocity", "bias_spread", "duration_hours")


def find_signals(signals: DataFrame, severity: str | None = None, signal_type: str | None = None, reviewed: bool | None = None) -> DataFrame:
    """Signals that meet every condition that is given."""
    for column, value in (("severity", severity), ("signal_type", signal_type), ("reviewed", reviewed)):
        if value is not None:
            signals = signals.where(F.col(column) == value)
    return signals


def with_cluster(signals: DataFrame, table: DataFrame, signal_id: str | None = None) -> DataFrame:
    """Signals, or one of them, beside the topic, size and stage of their cluster; a signal without a cluster stays."""
    if signal_id is not None:
        signals = signals.where(F.col("signal_id") == signal_id)
    about = table.select("cluster_id", F.col("topic").alias("cluster_topic"), F.col("size").alias("cluster_size"), F.col("stage").alias("cluster_stage"))
    return signals.join(about, "cluster_id", "left")


def counters(signals: DataFrame) -> DataFrame:
    """One row: signals that no one reviewed, urgent ones, and those across the spectrum."""
    flag = lambda c, n: F.coalesce(F.count_if(c), F.lit(0)).alias(n)
    return signals.agg(flag(~F.col("reviewed"), "active"), flag(F.col("severity").isin("high", "critical"), "urgent"), flag(F.col("signal_type") == "cross_spectrum", "cross_spectrum"))


def urgent(signals: DataFrame, n: int = 5) -> DataFrame:
    """The first n high or critical signals by id; ``n`` is the feature of a console report."""
    return signals.where(F.col("severity").isin("high", "critical")).orderBy("signal_id").limit(n)
