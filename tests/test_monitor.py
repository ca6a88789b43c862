"""The drift monitor's state, the replay, calibration and cross-validation over time."""

import datetime as dt
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import classifier, evaluation, lookups, monitor, splits
from newsloom.plans import replay, training
from newsloom.sources import articles
from oracle import SMALL

START = dt.datetime(2024, 1, 1)
DOCS = "id int, ts timestamp_ntz, embedding array<double>, cluster_id int"
CLUSTERS = "cluster_id int, size int, coordination_ratio double"


def docs_of(spark, vectors, clusters, hours=1.0):
    return spark.createDataFrame([(i, START + dt.timedelta(hours=i * hours), list(map(float, v)), c) for i, (v, c) in enumerate(zip(vectors, clusters, strict=True))], DOCS)


@pytest.fixture(scope="module")
def past():
    rng = np.random.default_rng(7)
    return rng.normal(size=(20, 4)), [i % 4 - 1 for i in range(20)]


def test_baseline_and_its_update(spark, past, tmp_path):
    x, labels = past
    docs, clusters = docs_of(spark, x, labels), spark.createDataFrame([(0, 5, 2.0), (1, 5, 4.0), (2, 1, 90.0)], CLUSTERS)
    base = monitor.baseline(docs, clusters)
    v = base.volume.first()
    assert (v.n_documents, v.n_windows, v.avg_volume, v.std_volume) == (20, 5, 4.0, 1.0)
    r = base.ratio.first()
    assert (r.avg_ratio, r.std_ratio) == (3.0, 1.0)
    assert {t.topic: t.p for t in base.topics.collect()} == {0: 0.25, 1: 0.25, 2: 0.25}
    base.write(str(tmp_path / "a"))
    base = monitor.Baseline.read(spark, str(tmp_path / "a"))
    new = x[:6] + 3
    after = monitor.updated(base, docs_of(spark, new, labels[:6]), spark.createDataFrame([(0, 3, 7.0)], CLUSTERS))
    dims = after.dims.orderBy("dim").collect()
    np.testing.assert_allclose([d.mean for d in dims], 0.9 * x.mean(0) + 0.1 * new.mean(0))
    np.testing.assert_allclose([d.std for d in dims], 0.9 * x.std(0) + 0.1 * new.std(0))
    assert after.volume.first().n_documents == 26 and abs(after.volume.first().avg_volume - (0.9 * v.avg_volume + 0.6)) < 1e-9
    assert abs(after.ratio.first().avg_ratio - 3.4) < 1e-9
    same = monitor.updated(base, docs_of(spark, [], []), spark.createDataFrame([(0, 3, 7.0)], CLUSTERS))
    assert [tuple(d) for d in same.dims.orderBy("dim").collect()] == [tuple(d) for d in base.dims.orderBy("dim").collect()]
    assert tuple(same.volume.first()) == tuple(base.volume.first()) and same.ratio.first().avg_ratio == 3.0
    alone = monitor.updated(base, docs_of(spark, new, labels[:6]), spark.createDataFrame([(0, 1, 7.0)], CLUSTERS))
    assert alone.ratio.first().avg_ratio == 3.0


def test_measures_history_and_export(spark, past, tmp_path):
    x, labels = past
    docs, clusters = docs_of(spark, x, labels), spark.createDataFrame([(0, 5, 2.0), (1, 5, 4.0)], CLUSTERS)
    base = monitor.baseline(docs, clusters)
    members = docs.where("cluster_id >= 0").select("cluster_id", "id")
    m = monitor.measure(base, docs, members, clusters).first()
    assert abs(m.cosine_distance) < 1e-5 and m.ratio_change == 0 and m.severity in ("medium", "high")  # 20 documents at once
    assert monitor.measure(base, docs.where("false"), members, clusters).count() == 0
    topics = {t.topic: t.p for t in monitor.current_topics(docs, members.union(spark.createDataFrame([(9, 1), (8, 999)], "cluster_id int, id int"))).collect()}
    assert topics == {0: 5 / 16, 1: 5 / 16, 2: 5 / 16, 9: 1 / 16}
    at = str(tmp_path / "history")
    assert monitor.history(spark, at).count() == 0
    for i in range(3):
        monitor.remember(monitor.measure(base, docs, members, clusters).withColumn("seq", F.lit(i)).withColumn("at", F.lit(START)), at)
    assert [r.seq for r in monitor.recent(monitor.history(spark, at), 2).orderBy("seq").collect()] == [1, 2]
    state = json.loads(monitor.export(base, monitor.history(spark, at)).first().state)
    np.testing.assert_allclose(state["baseline"]["embedding_mean"], x.mean(0))
    assert state["n_history"] == 3 and state["thresholds"]["embedding"] == 0.15 and state["baseline"]["n_documents"] == 20


def test_replay_run(spark, tmp_path):
    rows, out = articles.from_tables(spark, SMALL), str(tmp_path / "out")
    summary = replay.run(rows, out, "1d")
    members = spark.read.parquet(f"{out}/members").collect()
    told = {r.w: r for r in spark.read.json(f"{out}/windows").collect()}
    assert sum(r["articles"] for r in told.values()) == rows.count() == len(members)
    by = Counter(r.w for r in members)
    assert {w: r["articles"] for w, r in told.items()} == dict(by)
    for w, r in told.items():
        assert r["clusters"] == len({m["__c"] for m in members if m.w == w and m["__c"] >= 0})
    assert summary["windows_processed"] == len(by) and summary["total_signals"] == sum(r["signals"] for r in told.values())


def test_lookups_of_nothing(spark):
    none = spark.createDataFrame([], "signal_id string, cluster_id int, signal_type string, severity string, reviewed boolean")
    assert tuple(lookups.counters(none).first()) == (0, 0, 0)
    table = spark.createDataFrame([], "cluster_id int, topic string, size long, stage string")
    one = spark.createDataFrame([("s", 1, "x", "low", True)], none.schema)
    assert tuple(lookups.with_cluster(one, table, "s").select("signal_id", "cluster_size").first()) == ("s", None)
    assert lookups.with_cluster(one, table, "t").count() == 0
    assert lookups.find_signals(one, reviewed=False).count() == 0 and lookups.find_signals(one, "low", "x", True).count() == 1


def test_intervals_walk_forward(spark):
    day = lambda d: START + dt.timedelta(days=d)
    rows = spark.createDataFrame([(0, day(0), day(1)), (1, day(8), day(12)), (2, day(12), day(13)), (3, day(20), day(20))], "id int, s timestamp_ntz, e timestamp_ntz")
    out = {(r.fold, r.role, r.id) for r in splits.walk_forward(rows, "s", 10, 4, 3, 1, "e").collect()}
    assert {x for x in out if x[0] == 0} == {(0, "train", 0), (0, "test", 2)}  # row 1 begins before the bound and ends after it


def signal_rows(spark, n):
    rows = [(i, START + dt.timedelta(days=i % 40), 8.0 if i % 3 == 0 else 1.0 + (i % 5) / 10, 0.9 if i % 3 == 0 else 0.1, i % 2, 3, 1.0, 0.0, False, 0.5, 0.5, 10 + i % 7, 5, int(i % 3 == 0)) for i in range(n)]
    schema = "cluster_id long, window_start timestamp_ntz, coordination_ratio double, duplicate_burst_score double, duplicate_groups int, max_duplicate_group_size int, posting_velocity double, velocity_zscore double, burst_detected boolean, semantic_coherence double, topic_concentration double, size int, unique_authors int, label int"
    whole = spark.createDataFrame(rows, schema)
    return classifier.features(whole).join(whole.select("cluster_id", "window_start"), "cluster_id")


def test_calibration(spark):
    rows = signal_rows(spark, 90).drop("window_start").cache()
    model = classifier.fit_calibrated(rows, "logistic")
    out = {r.cluster_id: r for r in classifier.predict_calibrated(model, rows).collect()}
    assert model[1] is not None and all(0 <= r.probability <= 1 for r in out.values())
    assert {i for i, r in out.items() if r.prediction == 1} == {i for i in range(90) if i % 3 == 0}
    assert classifier.fit_calibrated(rows.limit(50), "logistic")[1] is None
    rows.unpersist()


def test_cross_validation_over_time(spark):
    rows = signal_rows(spark, 120).cache()
    out = training.cross_validate(rows, "logistic", folds=2)
    got = {(r.fold, r.metric): r.value for r in out.collect()}
    assert set(got) == {(f, m) for f in (0, 1) for m in training.METRICS} and set(got.values()) == {1.0}
    assert training.cross_validate(rows.where("label = 0"), "logistic", folds=2).count() == 0
    assert {r.metric: r.n for r in evaluation.summarize(out).collect()} == dict.fromkeys(training.METRICS, 2)
    rows.unpersist()


def test_evaluation_of_one_class(spark):
    rows = spark.createDataFrame([(0.2, True), (0.9, True)], "score double, truth boolean")
    one = evaluation.evaluate_classifier(rows, F.col("score") > 0.5).first()
    assert (one.roc_auc, one.average_precision, one.accuracy) == (0.5, 0.0, 0.5)
    none = spark.createDataFrame([], "cluster_id int, alert_time timestamp_ntz"), spark.createDataFrame([], "cluster_id int, peak_time timestamp_ntz")
    assert evaluation.evaluate_alerts(rows, *none).first().average_precision == 1.0
