"""Classifiers of coordination over 14 features, with MLlib."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.evaluation import confusion, roc_auc

#: (feature, SQL over cluster signals)
FEATURES = (
    ("coordination_ratio", "coordination_ratio"), ("duplicate_burst_score", "duplicate_burst_score"), ("duplicate_groups", "duplicate_groups"), ("max_duplicate_group_size", "max_duplicate_group_size"),
    ("posting_velocity", "posting_velocity"), ("velocity_zscore", "velocity_zscore"), ("burst_detected", "cast(burst_detected as double)"), ("semantic_coherence", "semantic_coherence"),
    ("topic_concentration", "topic_concentration"), ("size", "size"), ("unique_authors", "unique_authors"), ("log_size", "ln(1 + size)"), ("ratio_squared", "coordination_ratio * coordination_ratio"), ("has_body_ratio", "coalesce(has_body_ratio, 0.5e0)"),
)


def features(signals: DataFrame) -> DataFrame:
    base = signals if "has_body_ratio" in signals.columns else signals.withColumn("has_body_ratio", F.lit(0.5))
    return base.select("cluster_id", *(c for c in ("label", "weight") if c in base.columns), *(F.expr(sql).cast("double").alias(f"f_{name}") for name, sql in FEATURES))


def standardize(rows: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Features less their mean over their population deviation (1 where that is 0), and the two of each: 28 numbers."""
    names = [c for c in rows.columns if c.startswith("f_")]
    s = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    scale = {c: (s[f"m_{c}"] or 0.0, s[f"s_{c}"] or 1.0) for c in names}
    return apply_scale(rows, scale), scale


def apply_scale(rows: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def balanced(rows: DataFrame) -> DataFrame:
    """rows with weight: rows / (classes x rows of the class)."""
    n = rows.groupBy("label").agg(F.count("*").alias("__n"))
    t = n.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    return rows.drop("weight").join(F.broadcast(n), "label").join(F.broadcast(t)).withColumn("weight", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def fit(rows: DataFrame, kind: str = "gradient_boosting", seed: int = 42) -> tuple[PipelineModel, dict[str, tuple[float, float]]]:
    """A pipeline over standardised features: gradient_boosting, random_forest or logistic."""
    names = [f"f_{n}" for n, _ in FEATURES]
    if kind != "gradient_boosting" and "weight" not in rows.columns:
        rows = balanced(rows)
    scaled, scale = standardize(rows)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(scaled.withColumn("label", F.col("label").cast("double")))
    weight = {"weightCol": "weight"} if "weight" in data.columns else {}
    if kind == "gradient_boosting":
        model = GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, minInstancesPerNode=2, seed=seed, **weight)
    elif kind == "random_forest":
        model = RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **weight)
    elif kind == "logistic":
        model = LogisticRegression(maxIter=1000, regParam=1 / max(1, rows.count()), elasticNetParam=0.0, **weight)
    else:
        raise ValueError(f"no such kind of model: {kind!r}")
    fitted = model.fit(data)
    return PipelineModel([VectorAssembler(inputCols=names, outputCol="features"), fitted]), scale


def predict(model: tuple[PipelineModel, dict[str, tuple[float, float]]], rows: DataFrame) -> DataFrame:
    """(cluster_id, probability, prediction)"""
    out = model[0].transform(apply_scale(rows, model[1]))
    return out.select("cluster_id", vector_to_array("probability")[1].alias("probability"), F.col("prediction").cast("int").alias("prediction"))


def importance(model: tuple[PipelineModel, dict[str, tuple[float, float]]], top: int = 14) -> list[tuple[str, float]]:
    last = model[0].stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(((n, float(v)) for (n, _), v in zip(FEATURES, values, strict=True)), key=lambda x: (-x[1], x[0]))[:top]


def holdout(rows: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with test: about ``share`` of each class, those of least hash up to a quantile, so no task orders a class."""
    h = F.xxhash64(F.lit(seed), "cluster_id")
    cut = rows.groupBy("label").agg(F.percentile_approx(h, share, 10_000).alias("__cut"))  # a row for each class
    return rows.join(F.broadcast(cut), "label").select(*rows.columns, (h <= F.col("__cut")).alias("test"))


#: A model is calibrated only on more rows than this.
CALIBRATE_ABOVE = 50
Calibrated = tuple[tuple[PipelineModel, dict[str, tuple[float, float]]], IsotonicRegressionModel | None]


def fit_calibrated(rows: DataFrame, kind: str = "gradient_boosting", seed: int = 42) -> Calibrated:
    """A model, and what isotonic regression makes of its probabilities on a fifth of each class that it did not learn from; with
    at most CALIBRATE_ABOVE rows the model learns from all and stays as it is."""
    if len(rows.limit(CALIBRATE_ABOVE + 1).collect()) <= CALIBRATE_ABOVE:
        return fit(rows, kind, seed), None
    parts = holdout(rows, 0.2, seed)
    model = fit(parts.where("not test").drop("test"), kind, seed)
    held = parts.where("test").drop("test")
    told = predict(model, held).join(held.select("cluster_id", F.col("label").cast("double").alias("label")), "cluster_id")
    return model, IsotonicRegression(featuresCol="probability", labelCol="label", predictionCol="calibrated").fit(told)


def predict_calibrated(model: Calibrated, rows: DataFrame) -> DataFrame:
    """(cluster_id, probability, prediction): the calibrated probability, and whether it reaches one half."""
    out = predict(model[0], rows)
    if model[1] is not None:
        out = model[1].transform(out).select("cluster_id", F.col("calibrated").alias("probability"))
    return out.select("cluster_id", "probability", (F.col("probability") >= 0.5).cast("int").alias("prediction"))


def training_metrics(model: Calibrated, rows: DataFrame) -> DataFrame:
    """One row about a model on all rows (cluster_id, label, features) that it was fitted with: accuracy, precision, recall, f1, auc (one
    half if a class is absent), n_samples, n_positive, n_negative."""
    told = predict_calibrated(model, rows).join(rows.select("cluster_id", (F.col("label") == 1).alias("truth")), "cluster_id")
    counts = told.agg(F.count("*").alias("n_samples"), F.count_if("truth").alias("n_positive"), F.count_if(~F.col("truth")).alias("n_negative"))
    judged = confusion(told, F.col("prediction") == 1).select("accuracy", "precision", "recall", "f1")
    return judged.join(roc_auc(told, "probability").withColumnRenamed("roc_auc", "auc")).join(counts)  # one row each


def from_weak_labels(labelled: DataFrame, least: float = 0.5) -> DataFrame:
    """Training rows of weak labels: unknown and unsure ones go, organic is 0, others 1, weighted by confidence; fewer than
    ten rows raise."""
    kept = labelled.where((F.col("label") != "unknown") & (F.col("confidence") >= least))
    if len(kept.limit(10).collect()) < 10:
        raise ValueError("fewer than ten labelled clusters")
    return kept.withColumn("weight", F.col("confidence")).withColumn("label", (F.col("label") != "organic").cast("int"))


def save(model: tuple[PipelineModel, dict[str, tuple[float, float]]], path: str, spark=None) -> None:  # noqa: ANN001
    from pyspark.sql import SparkSession

    model[0].write().overwrite().save(f"{path}/model")
    spark = spark or SparkSession.active()
    spark.createDataFrame([(k, *v) for k, v in model[1].items()], "name string, mean double, std double").coalesce(1).write.mode("overwrite").parquet(f"{path}/scale")


def load(path: str, spark) -> tuple[PipelineModel, dict[str, tuple[float, float]]]:  # noqa: ANN001
    return PipelineModel.load(f"{path}/model"), {r.name: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scale").collect()}


def save_calibrated(model: Calibrated, path: str, spark=None) -> None:  # noqa: ANN001
    """save() with the calibration beside it; a model without one has no such folder."""
    save(model[0], path, spark)
    if model[1] is not None:
        model[1].write().overwrite().save(f"{path}/calibration")


def load_calibrated(path: str, spark) -> Calibrated:  # noqa: ANN001
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/calibration")
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return load(path, spark), IsotonicRegressionModel.load(f"{path}/calibration") if there else None
