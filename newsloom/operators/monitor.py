"""The drift monitor's state: a baseline as small tables, its update, and the history of measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import drift, windows

#: Measures that are kept of the past, and those that a decision to retrain looks at.
HISTORY = 100
MEASURES = "seq bigint, at timestamp_ntz, cosine_distance double, js_distance double, volume_z double, ratio_change double, score double, severity string"
PARTS = ("dims", "topics", "volume", "ratio")


@dataclass(frozen=True)
class Baseline:
    """dims (dim, mean, std), topics (topic, p), and a row each of volume (avg_volume, std_volume, n_documents, n_windows) and
    ratio (avg_ratio, std_ratio). The number of topics may grow, so they stay a table."""

    dims: DataFrame
    topics: DataFrame
    volume: DataFrame
    ratio: DataFrame

    def write(self, path: str) -> None:
        """Write all parts into ``path``, which must not be the one they were read from."""
        for part in PARTS:
            getattr(self, part).write.mode("overwrite").parquet(f"{path}/{part}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Baseline:
        return Baseline(*(spark.read.parquet(f"{path}/{part}") for part in PARTS))


def baseline(docs: DataFrame, clusters: DataFrame, size: str = "4h", ts: str = "ts", vector: str = "embedding", cluster: str = "cluster_id") -> Baseline:
    """From documents (ts, embedding, cluster_id, -1 for noise) and clusters (size, coordination_ratio). Windows of ``size`` begin
    with the first document and before the last one; without any the volume is 0 with deviation 1."""
    per = windows.counts(docs.select(ts), ts, size, strict=True)
    counted = docs.agg(F.count("*").alias("n_documents")).join(per.agg(F.count("*").alias("n_windows")))  # one row each
    return Baseline(drift.dims(docs, vector), drift.topics(docs, cluster), drift.volume_baseline(per).join(counted), drift.ratio_baseline(clusters))


def current_topics(docs: DataFrame, members: DataFrame, id_: str = "id", cluster: str = "cluster_id") -> DataFrame:
    """(topic, p): the share of each cluster in the memberships (cluster_id, id) of these documents. A document of two clusters
    counts in both; clusters without one of them are left out."""
    inside = members.join(docs.select(id_).distinct(), id_, "left_semi").select(cluster, id_).distinct()
    n = inside.groupBy(F.col(cluster).alias("topic")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("topic", (F.col("n") / F.col("total")).alias("p"))


def measure(base: Baseline, docs: DataFrame, members: DataFrame, clusters: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: cosine_distance, js_distance, volume_z, ratio_change, score and severity of a window against the baseline; no row
    for a window without documents, which is neither judged nor remembered."""
    count = F.broadcast(docs.agg(F.count("*").alias("__n")))
    parts = (drift.topic_drift(base.topics, current_topics(docs, members)), drift.volume_drift(base.volume.join(count), F.col("__n")), drift.ratio_drift(base.ratio, clusters))
    row = drift.embedding_drift(base.dims, drift.dims(docs, vector)).join(count)
    for part in parts:
        row = row.join(F.broadcast(part))  # one row each
    return drift.overall(row.where("__n > 0")).select("cosine_distance", "js_distance", "volume_z", "ratio_change", "score", "severity")


def updated(base: Baseline, docs: DataFrame, clusters: DataFrame, decay: float = 0.1, vector: str = "embedding") -> Baseline:
    """The baseline moved towards a window by exponential smoothing: means and deviations of dimensions, mean volume and, if a
    cluster has more than one member, mean ratio. Topics and the deviations of volume and ratio stay; no document, no change."""
    now = F.broadcast(docs.agg(F.count("*").alias("n")))
    ratio = F.broadcast(clusters.where("size > 1").agg(F.avg("coordination_ratio").alias("now")).join(now))
    move = lambda old, new: (1 - decay) * F.col(old) + decay * new
    dims = base.dims.join(drift.dims(docs, vector).select("dim", F.col("mean").alias("m"), F.col("std").alias("s")), "dim", "left")
    dims = dims.select("dim", *(F.coalesce(move(c, F.col(n)), c).alias(c) for c, n in (("mean", "m"), ("std", "s"))))
    some = F.col("n") > 0
    volume = base.volume.join(now).select(F.when(some, move("avg_volume", F.col("n"))).otherwise(F.col("avg_volume")).alias("avg_volume"), "std_volume", (F.col("n_documents") + F.col("n")).alias("n_documents"), (F.col("n_windows") + some.cast("long")).alias("n_windows"))
    moved = F.when(some, move("avg_ratio", F.col("now")))
    return Baseline(dims, base.topics, volume, base.ratio.join(ratio).select(F.coalesce(moved, F.col("avg_ratio")).alias("avg_ratio"), "std_ratio"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """The newest HISTORY measures that were remembered; none if nothing was."""
    try:
        kept = spark.read.schema(MEASURES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], MEASURES)
    return recent(kept, HISTORY)


def remember(measures: DataFrame, path: str) -> None:
    """Append measures with their seq and time to the history. streaming.monitoring keeps HISTORY of them on disk and no more."""
    shaped(measures).write.mode("append").parquet(path)


def shaped(measures: DataFrame) -> DataFrame:
    """The columns of MEASURES alone, in their types."""
    return measures.selectExpr(*(f"CAST({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in MEASURES.split(", ")))


def recent(measures: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """The trend: the newest n measures."""
    return measures.orderBy(F.desc(order)).limit(n)


def export(base: Baseline, measures: DataFrame, size: str = "4h", thresholds: tuple[float, float, float, float] = (0.15, 0.2, 3.0, 0.5)) -> DataFrame:
    """One row with ``state``, JSON of the settings, of the baseline without its topics, and of how many measures there are."""
    by_dim = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    vectors = base.dims.agg(*(by_dim.getField(c).alias(f"embedding_{c}") for c in ("mean", "std")))
    row = vectors.join(base.volume).join(base.ratio).join(recent(measures, HISTORY).agg(F.count("*").alias("n_history")))  # one row each
    limits = F.struct(*(F.lit(v).alias(n) for n, v in zip(("embedding", "topic", "volume_zscore", "coordination"), thresholds, strict=True)))
    about = F.struct("embedding_mean", "embedding_std", "avg_volume", F.col("avg_ratio").alias("avg_coordination"), "n_documents")
    return row.select(F.to_json(F.struct(F.lit(size).alias("window_size"), limits.alias("thresholds"), about.alias("baseline"), "n_history")).alias("state"))
