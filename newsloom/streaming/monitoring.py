"""The drift monitor on a stream: each micro-batch is held against a baseline that moves with the batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from newsloom.operators import monitor
from newsloom.sources.store import Store

_NOW = "now"


def baseline(spark: SparkSession, path: str, version: int | None = None) -> monitor.Baseline | None:
    """The baseline in the store at ``path`` as of a version, the newest by default; None before the first documents."""
    store = Store(spark, path)
    version = max(store.versions(), default=0) if version is None else version
    parts = [store.read(part, version) for part in monitor.PARTS]
    return None if parts[0] is None else monitor.Baseline(*parts)


def history(spark: SparkSession, path: str) -> DataFrame:
    """The measures that were remembered, HISTORY at most: the store holds no more of them."""
    kept = Store(spark, path).read("measures")
    return spark.createDataFrame([], monitor.MEASURES) if kept is None else kept


def sink(path: str, clusters: Callable[[DataFrame], DataFrame], ts: str = "ts", id_: str = "id", cluster: str = "cluster_id", vector: str = "embedding", size: str = "4h", decay: float = 0.1, name: str = "monitor") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over documents (id, ts, embedding, cluster_id, -1 or null for noise).

    The first batch with documents becomes the baseline, and is neither judged nor remembered. Each later one is measured, then moves the
    baseline by ``decay``. ``clusters`` makes (size, coordination_ratio) of a batch's documents. An empty batch changes nothing.
    The baseline, the measures and the batch's number are published at once: a batch that is run again after a crash
    starts from the baseline before it, and one that has been published is left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, path)
        if store.last(name) >= number:
            return
        docs = batch.withColumn(cluster, F.coalesce(F.col(cluster), F.lit(-1))).persist()
        try:
            if docs.isEmpty():
                return
            base, found = baseline(spark, path), clusters(docs)
            if base is None:
                after, told = monitor.baseline(docs, found, size, ts, vector, cluster), {}
            else:
                members = docs.where(F.col(cluster) >= 0).select(F.col(cluster).alias("cluster_id"), F.col(id_).alias("id"))
                row = monitor.measure(base, docs.withColumnRenamed(id_, "id"), members, found, vector)
                row = row.join(F.broadcast(docs.agg(F.max(ts).alias("at")))).withColumn("seq", F.lit(number))  # one row each
                told = {("measures", _NOW): monitor.recent(history(spark, path).unionByName(monitor.shaped(row)), monitor.HISTORY)}
                after = monitor.updated(base, docs, found, decay, vector)
            store.put({(part, _NOW): getattr(after, part) for part in monitor.PARTS} | told, (name, number))
        finally:
            docs.unpersist()

    return write


def follow(stream: DataFrame, out: str, checkpoint: str, clusters: Callable[[DataFrame], DataFrame], **about: Any) -> StreamingQuery:
    """Monitor what a stream has, from where ``checkpoint`` stands; ``about`` goes to sink()."""
    return stream.writeStream.foreachBatch(sink(out, clusters, **about)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
