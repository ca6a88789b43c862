"""What no query reaches: kept models, weights of features, weak labels, encoders, folds, the decision to retrain."""

import datetime as dt

import numpy as np
import pytest
from newsloom.operators import classifier, drift, feedback, splits, vectors
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(1)
    names = [f"f_{n}" for n, _ in classifier.FEATURES]
    x = draw.normal(size=(120, len(names)))
    return spark.createDataFrame([(i, int(v[0] > 0), *map(float, v)) for i, v in enumerate(x)], ", ".join(["cluster_id long", "label int", *(f"{n} double" for n in names)])).cache()


def told(df):
    return {r.cluster_id: (round(r.probability, 9), r.prediction) for r in df.collect()}


@pytest.mark.parametrize("kind", ["logistic", "random_forest"])
def test_a_model_is_kept(spark, rows, tmp_path, kind):
    model = classifier.fit_calibrated(rows, kind)
    assert model[1] is not None
    classifier.save_calibrated(model, str(tmp_path / "m"), spark)
    again = classifier.load_calibrated(str(tmp_path / "m"), spark)
    want = told(classifier.predict_calibrated(model, rows))
    assert told(classifier.predict_calibrated(again, rows)) == want
    assert np.mean([want[r.cluster_id][1] == r.label for r in rows.collect()]) > 0.85
    classifier.save_calibrated((model[0], None), str(tmp_path / "n"), spark)
    assert classifier.load_calibrated(str(tmp_path / "n"), spark)[1] is None
    assert classifier.importance(model[0], 3)[0][0] == "coordination_ratio"
    assert len(classifier.importance(model[0])) == 14


def test_metrics_on_all_rows(rows):
    model = classifier.fit_calibrated(rows, "logistic")
    r = classifier.training_metrics(model, rows).first()
    told_ = told(classifier.predict_calibrated(model, rows))
    right = [told_[x.cluster_id][1] == x.label for x in rows.collect()]
    assert abs(r.accuracy - np.mean(right)) < 1e-9 and 0.8 < r.auc <= 1
    assert r.n_samples == 120 == r.n_positive + r.n_negative


def test_unknown_kinds_raise(rows):
    with pytest.raises(ValueError, match="no such kind"):
        classifier.fit(rows, "oracle")


def test_holdout_by_class(rows):
    parts = {(r.label, r.test): r["count"] for r in classifier.holdout(rows, 0.25).groupBy("label", "test").count().collect()}
    for label in (0, 1):
        whole = parts[label, True] + parts[label, False]
        assert abs(parts[label, True] - 0.25 * whole) <= 1
    assert classifier.holdout(rows).columns == [*rows.columns, "test"]


def test_weak_labels_become_training_rows(spark):
    given = [(i, label, c) for i, (label, c) in enumerate([("organic", 0.9), ("suspicious", 0.6), ("likely_coordinated", 0.8), ("unknown", 0.9), ("organic", 0.4)] * 5)]
    table = spark.createDataFrame(given, "cluster_id int, label string, confidence double")
    kept = classifier.from_weak_labels(table).collect()
    assert sorted((r.cluster_id % 5, r.label, r.weight) for r in kept) == sorted([(0, 0, 0.9), (1, 1, 0.6), (2, 1, 0.8)] * 5)
    with pytest.raises(ValueError, match="ten"):
        classifier.from_weak_labels(table.limit(10))


def test_texts_are_encoded_in_batches(spark):
    given = spark.createDataFrame([(1, "a b"), (2, "B a"), (3, None), (4, "")], "id int, text string")
    out = {r.id: r.embedding for r in vectors.embed(given, encoder=lambda: vectors.hashed_encoder(16), batch=2).collect()}
    assert out[1] == out[2] and abs(np.linalg.norm(out[1]) - 1) < 1e-9
    assert out[3] == out[4] == [0.0] * 16


def test_folds_and_splits(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    table = spark.createDataFrame([(i, day(i), day(i + (40 if i == 5 else 0), 2)) for i in range(61)], "id int, ts timestamp_ntz, stop timestamp_ntz")
    assert splits.n_splits(table) == (60 - 30 - 7 - 1) // 7
    assert splits.n_splits(table, initial=60) == 0 and splits.n_splits(table.limit(0)) == 0
    got = {r.id: r.split for r in splits.time_split(table, end="stop").collect()}
    assert 5 not in got  # it ends after the first part, and begins before the others
    assert got[34] == "train" and 36 not in got and got[37] == "val" and got[60] == "test"


def test_retraining(spark):
    assert [feedback.should_retrain(spark.range(n).selectExpr("'confirmed' as verdict"), 5).first()[0] for n in (4, 5)] == [False, True]


def test_centroid_of_all(spark):
    table = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "embedding array<double>")
    assert {r.dim: r.value for r in drift.centroid(table).collect()} == {0: 2.0, 1: 4.0}
    assert drift.centroid(table.where(F.lit(False))).collect() == []
