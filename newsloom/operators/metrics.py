"""Metrics of clusters and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.articles import bias_numeric, has_frame, hours, is_pr_origin, is_wire_origin
from newsloom.operators.windows import places


def stage(outlets: Column, diversity: Column, duration: Column) -> Column:
    return F.when((outlets <= 2) & (duration < 6), "nascent").when(outlets <= 5, "emerging").when(diversity < 3, "spreading").otherwise("established")


def cluster_metrics(articles: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One row for each cluster: size, distinct outlets and types, bias, span, velocity, origins and stage. Outlets are counted
    distinct after a shuffle by cluster and outlet, so a cluster's outlets are never gathered; types are a fixed few."""
    bias = bias_numeric(F.col("outlet_bias"))
    agg = articles.groupBy(key).agg(
        F.count("*").alias("size"),
        F.count_distinct("outlet").alias("unique_outlets"),
        F.sort_array(F.collect_set("outlet_type")).alias("types"),
        F.coalesce(F.stddev_samp(bias), F.lit(0.0)).alias("bias_spread"),
        F.coalesce(F.avg(bias), F.lit(0.0)).alias("bias_mean"),
        F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("last_seen"),
        F.avg(is_wire_origin(F.col("wire_source")).cast("double")).alias("wire_origin_ratio"),
        F.avg(is_pr_origin(F.col("wire_source"), F.col("pr_source")).cast("double")).alias("pr_origin_ratio"),
        F.max(has_frame(F.col("coordinated_frame"))).alias("has_coordinated"),
        F.max(has_frame(F.col("convergent_frame"))).alias("has_convergent"),
    )
    agg = agg.withColumn("duration_hours", hours(F.col("last_seen"), F.col("first_seen"))).withColumn("source_diversity", F.size("types").cast("long"))
    velocity = F.when(F.col("duration_hours") == 0, F.col("size").cast("double")).otherwise(F.col("size") / F.when(F.col("duration_hours") != 0, F.col("duration_hours")))
    return agg.withColumn("velocity", velocity).withColumn("stage", stage(F.col("unique_outlets"), F.col("source_diversity"), F.col("duration_hours")))


def summary(metrics: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Rounded metrics as they are reported."""
    return metrics.select(key, "size", "unique_outlets", F.array_join("types", ",").alias("outlet_types"), "source_diversity", *(F.round(c, 6).alias(c) for c in ("bias_spread", "bias_mean", "duration_hours", "velocity", "wire_origin_ratio", "pr_origin_ratio")), "stage")


def first_mode(df: DataFrame, key: str, value: str, order: tuple[str, ...], out: str) -> DataFrame:
    """(key, out): the most frequent non-empty value of each key, ties to the value met first. Two aggregations: the second
    sees a row for each distinct value."""
    counted = df.where(F.coalesce(F.length(value) > 0, F.lit(False))).groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(out))


def common_frame(articles: DataFrame, key: str = "cluster_id", order: tuple[str, ...] = ("published_at", "id")) -> DataFrame:
    """The most frequent coordinated frame, or without one the most frequent convergent frame."""
    keys = articles.select(key).distinct()
    a = first_mode(articles, key, "coordinated_frame", order, "a")
    b = first_mode(articles, key, "convergent_frame", order, "b")
    return keys.join(a, key, "left").join(b, key, "left").select(key, F.coalesce("a", "b").alias("common_frame"))


def headline(articles: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The title of the earliest article of wire origin, else of the earliest."""
    wire = is_wire_origin(F.col("wire_source"))
    return articles.groupBy(key).agg(F.min_by("title", F.struct(~wire, "published_at", "id")).alias("headline"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))


def keyword_counts(articles: DataFrame, key: str = "cluster_id", top: int = 10) -> DataFrame:
    """The most frequent keywords of each cluster, ties to the one met first (article, then place)."""
    words = articles.select(key, "published_at", "id", F.posexplode("keywords").alias("place", "keyword"))
    counted = words.groupBy(key, "keyword").agg(F.count("*").alias("n"), F.min(F.struct("published_at", "id", "place")).alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(key, "rank", "keyword", "n")


def timeline(articles: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Articles with their place in time within the cluster."""
    return places(articles.select(key, "id", "published_at", "outlet", "title"), key, "published_at", ("id",)).select(key, "place", "id", "published_at", "outlet", "title")


def dataset_stats(articles: DataFrame) -> DataFrame:
    """One row about all articles; empty strings are skipped, an empty input has zeros and empty texts."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",").alias(f"{c}_list")
    flag = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return articles.agg(
        F.count("*").alias("total"),
        F.count_distinct("outlet").alias("outlets"),
        *map(listed, ("outlet_type", "outlet_bias", "section", "pattern_topic", "pattern_type")),
        F.min("published_at").alias("first_ts"),
        F.max("published_at").alias("last_ts"),
        flag(is_wire_origin(F.col("wire_source"))).alias("wire"),
        flag(is_pr_origin(F.col("wire_source"), F.col("pr_source"))).alias("pr"),
        flag(has_frame(F.col("coordinated_frame"))).alias("coordinated"),
        flag(has_frame(F.col("convergent_frame"))).alias("convergent"),
    )


def distribution(df: DataFrame, column: str, domain: tuple[str, ...] = ()) -> DataFrame:
    """Counts by value, null as ``unknown``; values of the domain that don't occur count zero."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    if not domain:
        return counts
    spine = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias("value"))
    return spine.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def distribution_by(df: DataFrame, key: str, column: str, domain: tuple[str, ...]) -> DataFrame:
    """(key, value, n): counts of each value of the domain for each key, those that don't occur zero."""
    counts = df.groupBy(key, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    spine = df.select(key).distinct().withColumn("value", F.explode(F.array(*map(F.lit, domain))))
    return spine.join(counts, [key, "value"], "left").select(key, "value", F.coalesce("n", F.lit(0)).alias("n"))
