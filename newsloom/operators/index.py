"""An inverted file over vectors: lists by coarse centroid in a partitioned table, of which a search reads a few."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.vectors import cosine

#: Rows that the centroids are fitted on, drawn by hash; lists at most. Both bound what the driver holds.
SAMPLE, LISTS = 50_000, 4096
#: The list of vectors that have no direction: zero ones, and those of another width.
REST = -1


def build(vectors: DataFrame, path: str, lists: int | None = None, id_: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> int:
    """Write ``path``/lists (id, vector, partitioned by list) and ``path``/centroids (list, centroid); return the number of lists.

    Every row is listed, under the centroid of largest cosine. Centroids are the spherical k-means of at most ``sample`` vectors, drawn by
    hash of the vector; ``lists`` is the root of the number of rows, LISTS at most, where it isn't given. Vectors that are null or hold a null
    are left out, as they have no similarity; zero vectors and vectors of another width than most are in the list REST.
    """
    good = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.forall("v", lambda x: x.isNotNull()))
    some = F.exists("v", lambda x: x != 0)
    by_width = good.where(some).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = by_width.orderBy(F.desc("n"), "d").first()
    fits = some & (F.size("v") == (most.d if most else 0))
    if most is None:
        good.withColumn("list", F.lit(REST)).write.partitionBy("list").parquet(f"{path}/lists")
        good.sparkSession.createDataFrame([], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
        return 0
    k = min(LISTS, lists or ceil(sqrt(most.n)))
    drawn = good.where(fits).orderBy(F.xxhash64("v", F.lit(seed))).limit(sample).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, k), distanceMeasure="cosine", seed=seed, maxIter=10).fit(drawn)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    good.sparkSession.createDataFrame(centers, "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    placed = model.transform(good.where(fits).withColumn("features", array_to_vector("v"))).select("id", vector_to_array("features").alias("v"), F.col("prediction").alias("list"))
    everything = placed.unionByName(good.where(~fits).withColumn("list", F.lit(REST)))
    everything.repartition("list").write.partitionBy("list").parquet(f"{path}/lists")
    return len(centers)


def search(spark: SparkSession, path: str, query: list[float], k: int = 10, probe: int | None = 8) -> DataFrame:
    """(id, similarity): the k vectors of largest cosine among the ``probe`` lists nearest to the query, ties to the lesser id; with
    None, or as many as there are lists, among all vectors, which is exact. Only the probed partitions are read, and ranked by the
    vectors themselves. A query without a direction, and vectors of REST, have similarity 0 and count only if all lists are probed."""
    kept = spark.read.schema("id long, v array<double>, list int").parquet(f"{path}/lists")
    if probe is not None:
        rows = spark.read.parquet(f"{path}/centroids").collect()  # LISTS at most
        q = np.array(query, float)
        near = sorted(rows, key=lambda r: -float(q @ np.array(r.centroid)) / (np.linalg.norm(r.centroid) or 1.0) if len(r.centroid) == len(q) else 0.0)
        if probe < len(rows):
            kept = kept.where(F.col("list").isin([r.list for r in near[:probe]]))
    same = F.size("v") == len(query)
    similarity = F.when(same, cosine(F.col("v"), F.array(*map(F.lit, map(float, query))))).otherwise(0.0)
    return kept.select("id", similarity.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)
