"""Analyst feedback: training labels, rates, agreement, and sampling of alerts to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities in the order of diversity sampling; others are not drawn.
ROUND_ROBIN = ("critical", "high", "medium", "low")


def training_labels(feedback: DataFrame) -> DataFrame:
    """(alert_id, label, confidence): the latest verdict of each alert, ties to the one appended first; unsure ones go, after
    the choice. One aggregation."""
    last = feedback.groupBy("alert_id").agg(F.max_by(F.struct("verdict", "confidence"), F.struct("timestamp", -F.col("ord"))).alias("x")).select("alert_id", "x.*")
    return last.where(F.col("verdict").isin("confirmed", "false_positive")).select("alert_id", F.when(F.col("verdict") == "confirmed", 1).otherwise(0).alias("label"), "confidence")


def metrics(feedback: DataFrame, since: Column) -> DataFrame:
    """One row: total, rates, mean confidence, and mean of the times that aren't zero; zeros where there is nothing."""
    rate = lambda *v: F.coalesce(F.avg(F.col("verdict").isin(*v).cast("double")), F.lit(0.0))
    return feedback.where(F.col("timestamp") >= since).agg(
        F.count("*").alias("total"), rate("confirmed").alias("confirm_rate"), rate("false_positive").alias("fp_rate"), rate("needs_review", "unsure").alias("unsure_rate"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.avg(F.nullif(F.col("time_spent_seconds"), F.lit(0))), F.lit(0.0)).alias("avg_seconds"),
    )


def analyst_stats(feedback: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return feedback.groupBy("analyst_id").agg(F.count("*").alias("total"), F.count_if(v == "confirmed").alias("confirmed"), F.count_if(v == "false_positive").alias("false_positive"), F.count_if(~F.coalesce(v.isin("confirmed", "false_positive"), F.lit(False))).alias("unsure"))


def agreement(feedback: DataFrame) -> DataFrame:
    """One row: the share of pairs of verdicts on one alert that agree, 1 without a pair. Counts of pairs, not the pairs."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    per = feedback.groupBy("alert_id", "verdict").agg(F.count("*").alias("n")).groupBy("alert_id").agg(F.sum("n").alias("m"), F.sum(two("n")).alias("same"))
    return per.agg(F.sum("same").alias("a"), F.sum(two("m")).alias("b")).select(F.when(F.coalesce("b", F.lit(0.0)) == 0, 1.0).otherwise(F.col("a") / F.when(F.col("b") != 0, F.col("b"))).alias("agreement"))


def should_retrain(feedback: DataFrame, threshold: int = 100) -> DataFrame:
    return feedback.agg((F.count("*") >= threshold).alias("retrain"))


def unreviewed(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    return alerts.join(feedback.select("alert_id").distinct(), "alert_id", "left_anti")


def uncertainty(confidence: Column) -> Column:
    return 1 - F.abs(F.coalesce(confidence, F.lit(0.5)) - 0.5) * 2


def sample_uncertain(alerts: DataFrame, n: int) -> DataFrame:
    """The n alerts (alert_id, cluster_id, severity, confidence, ord) whose model confidence is nearest to one half."""
    rows = alerts.select("alert_id", "cluster_id", F.coalesce("confidence", F.lit(0.5)).alias("model_confidence"), uncertainty(F.col("confidence")).alias("uncertainty_score"), F.lit("high_uncertainty").alias("selection_reason"), "ord")
    return rows.orderBy(F.desc("uncertainty_score"), "ord").limit(n)


def sample_diverse(alerts: DataFrame, n: int) -> DataFrame:
    """n alerts, one of each severity in turn. A severity is cut to its first n before it is ranked against others."""
    rank = sum((F.when(F.col("severity") == s, i).otherwise(0) for i, s in enumerate(ROUND_ROBIN)), F.lit(0))
    turn = F.row_number().over(Window.partitionBy("severity").orderBy("ord"))
    rows = alerts.where(F.col("severity").isin(*ROUND_ROBIN)).withColumn("turn", turn).where(F.col("turn") <= n)
    rows = rows.orderBy("turn", rank).limit(n)
    return rows.select("alert_id", "cluster_id", F.coalesce("confidence", F.lit(0.5)).alias("model_confidence"), uncertainty(F.col("confidence")).alias("uncertainty_score"), F.concat(F.lit("diversity_"), "severity").alias("selection_reason"), "ord")


def sample_mixed(alerts: DataFrame, n: int) -> DataFrame:
    """Half by uncertainty, the rest by diversity among what is left."""
    half = sample_uncertain(alerts, n // 2)
    rest = alerts.join(half.select("alert_id"), "alert_id", "left_anti")
    return half.unionByName(sample_diverse(rest, n - n // 2))


def select_for_labeling(alerts: DataFrame, feedback: DataFrame, n: int = 10, strategy: str = "uncertainty") -> DataFrame:
    """Alerts to label next, of those no analyst has seen; any strategy but uncertainty and diversity is mixed."""
    open_ = unreviewed(alerts, feedback)
    return {"uncertainty": sample_uncertain, "diversity": sample_diverse}.get(strategy, sample_mixed)(open_, n)
