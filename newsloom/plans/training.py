"""Training over time: a model for each fold of an expanding window, judged on what came after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import classifier, evaluation, splits

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def cross_validate(rows: DataFrame, kind: str = "gradient_boosting", folds: int = 5, ts: str = "window_start", least: int = 14, test: int = 7, gap: int = 1) -> DataFrame:
    """(fold, metric, value) of features() rows with label and a time. Folds without both classes to learn from are left out, as
    are those without rows on a side. The loop is over ``folds`` models, not over data."""
    dealt = splits.expanding(rows, ts, least, test, folds, gap)
    classes = dealt.where("role = 'train'").groupBy("fold").agg(F.count_distinct("label").alias("n")).where("n > 1")
    out = None
    for fold in sorted(r.fold for r in classes.collect()):
        mine = dealt.where(F.col("fold") == fold)
        model = classifier.fit_calibrated(mine.where("role = 'train'").drop("fold", "role", ts), kind)
        held = mine.where("role = 'test'")
        told = classifier.predict_calibrated(model, held).join(held.select("cluster_id", (F.col("label") == 1).alias("truth")), "cluster_id")
        judged = evaluation.evaluate_classifier(told, F.col("prediction") == 1, "probability")
        long = judged.select(F.lit(fold).alias("fold"), F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))
        out = long if out is None else out.unionByName(long)
    return rows.sparkSession.createDataFrame([], "fold int, metric string, value double") if out is None else out
