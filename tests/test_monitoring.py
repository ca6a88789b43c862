"""The monitor over a stream of files against the same steps over tables, and batches that are run again."""

import numpy as np
import pytest
from newsloom.operators import monitor
from newsloom.sources.store import Store
from newsloom.streaming import monitoring
from pyspark.sql import functions as F

SCHEMA = "id long, ts timestamp, embedding array<double>, cluster_id int"


def batches(spark, n=3):
    draw = np.random.default_rng(3)
    for b in range(n):
        rows = [(100 * b + i, 1_704_067_200 + 7200 * (10 * b + i), [float(v) for v in draw.normal(size=3) + b], [None, -1, 0, 1, 2][i % 5] if b else i % 3) for i in range(12 + b)]
        yield spark.createDataFrame(rows, "id long, s long, embedding array<double>, cluster_id int").select("id", F.timestamp_seconds("s").alias("ts"), "embedding", "cluster_id")


def clusters(docs):
    return docs.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg(F.col("id") % 7).alias("coordination_ratio"))


def stepwise(spark):
    """The baseline and the measures after each batch, from the tables."""
    base, told = None, []
    for docs in batches(spark):
        docs = docs.fillna({"cluster_id": -1})
        if base is None:
            base = monitor.baseline(docs, clusters(docs))
        else:
            members = docs.where("cluster_id >= 0").select("cluster_id", "id")
            told.append(monitor.measure(base, docs, members, clusters(docs)).first())
            base = monitor.updated(base, docs, clusters(docs))
    return base, told


def numbers(base):
    dims = [(d.dim, d["mean"], d["std"]) for d in base.dims.orderBy("dim").collect()]
    return np.array([*np.ravel(dims), *base.volume.select("avg_volume", "std_volume", "n_documents", "n_windows").first(), *base.ratio.select("avg_ratio", "std_ratio").first()], float)


def judged(spark, at):
    return [tuple(r) for r in monitoring.history(spark, at).orderBy("seq").select("cosine_distance", "js_distance", "volume_z", "ratio_change", "score", "severity").collect()]


def test_a_stream_agrees_with_the_steps(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, docs in enumerate(batches(spark)):
        docs.coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
        query = monitoring.follow(stream, out, str(tmp_path / "state"), clusters)
        query.awaitTermination(200)
        assert query.exception() is None
    base, told = stepwise(spark)
    np.testing.assert_allclose(numbers(monitoring.baseline(spark, out)), numbers(base))
    got = judged(spark, out)
    np.testing.assert_allclose([r[:5] for r in got], [tuple(r)[:5] for r in told])
    assert [r[5] for r in got] == [r.severity for r in told]


def test_batches_that_are_run_again(spark, tmp_path, monkeypatch):
    out, given = str(tmp_path), list(batches(spark))
    write = monitoring.sink(out, clusters)
    write(given[0].limit(0), 0)
    assert monitoring.baseline(spark, out) is None and judged(spark, out) == []
    write(given[0], 1)
    assert judged(spark, out) == []  # the first documents only set the baseline
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            write(given[1], 2)
    for number in (2, 2, 1, 3, 2):
        write(given[number - 1], number)
    base, told = stepwise(spark)
    np.testing.assert_allclose(numbers(monitoring.baseline(spark, out)), numbers(base))
    assert len(judged(spark, out)) == 2 == len(told)


def test_the_history_is_bounded_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitor, "HISTORY", 2)
    out, given = str(tmp_path), list(batches(spark))
    write = monitoring.sink(out, clusters)
    for number in range(5):
        write(given[number % 3], number)
    assert [r.seq for r in monitoring.history(spark, out).orderBy("seq").collect()] == [3, 4]
    assert sum(len(f) for f in Store(spark, out).manifest().tables["measures"]["parts"].values()) == 1
