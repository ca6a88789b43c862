"""Signals of clusters: one pass over a rules table, and transitions between consecutive windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.articles import is_wire_origin, stage_order
from newsloom.schema import SEVERITIES
from newsloom.settings import Settings

def rules(s: Settings) -> tuple[tuple[str, str, str], ...]:
    """(type, condition, severity) in SQL over cluster metrics; the missing detector's rules are our own design."""
    return (
        ("rapid_emergence", f"stage in ('nascent', 'emerging') and velocity >= {s.velocity_spreading}e0", f"case when velocity >= {s.velocity_high}e0 then 'high' else 'medium' end"),
        ("cross_spectrum", f"bias_spread >= {s.bias_spread}e0 and size >= 2", f"case when unique_outlets >= {s.outlets_high} then 'high' else 'medium' end"),
        ("wire_cascade", "first_is_wire and unique_outlets >= 3", "'low'"),
        ("pr_amplification", "pr_origin_ratio > 0 and unique_outlets >= 3", f"case when source_diversity >= {s.diversity} then 'high' else 'medium' end"),
        ("frame_convergence", f"has_convergent and not has_coordinated and coherence >= {s.coherence_loose}e0", "'low'"),
        ("synchronized", f"has_coordinated and coherence >= {s.coherence_tight}e0", f"case when unique_outlets >= {s.outlets_high} or source_diversity >= {s.diversity_high} then 'critical' else 'high' end"),
    )


#: The same over rows with what the narrative was in the window before (p_ columns, null without one).
TRANSITIONS = (
    ("velocity_spike", "p_velocity is not null and velocity >= 3 * p_velocity", "'medium'"),
    ("sustained_momentum", "velocity >= 2 and p_velocity >= 2", "'medium'"),
    ("stage_transition", "p_order is not null and p_order <> stage_order", "case when stage_order < p_order then 'info' else 'low' end"),
    ("narrative_revival", "p_velocity is null and seen_before", "'medium'"),
)


def fire(rows: DataFrame, key: list[str], rules: tuple) -> DataFrame:
    """(key, signal_type, severity): a row for each rule that a row meets."""
    found = F.array(*(F.when(F.expr(c), F.struct(F.lit(t).alias("signal_type"), F.expr(s).alias("severity"))) for t, c, s in rules))
    return rows.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*key, "x.signal_type", "x.severity")


def detect(metrics: DataFrame, articles: DataFrame, coherences: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, signal_type, severity, signal_id); ids depend on the cluster and the type alone."""
    first = articles.groupBy(key).agg(F.min_by(is_wire_origin(F.col("wire_source")), F.struct("published_at", "id")).alias("first_is_wire"))
    rows = metrics.join(first, key).join(coherences, key, "left")
    fired = fire(rows, [key], rules(Settings.of(metrics.sparkSession)))
    return fired.withColumn("signal_id", F.concat_ws("_", F.lit("sig"), "signal_type", F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "signal_type"), 256), 1, 8)))


def transitions(windows: DataFrame, key: str = "topic", order: str = "w") -> DataFrame:
    """(w, topic, signal_type, severity) from metrics by window and narrative (stage, velocity): each is held against the same
    narrative in the last non-empty window before."""
    present = windows.select(order).distinct().withColumn("n", F.row_number().over(Window.orderBy(order)))
    rows = windows.join(F.broadcast(present), order).withColumn("stage_order", stage_order(F.col("stage")))
    own = Window.partitionBy(key).orderBy("n")
    next_to = F.lag("n").over(own) == F.col("n") - 1
    rows = rows.withColumns({"p_velocity": F.when(next_to, F.lag("velocity").over(own)), "p_order": F.when(next_to, F.lag("stage_order").over(own)), "seen_before": F.lag("n").over(own).isNotNull()})
    return fire(rows, [order, key], TRANSITIONS)


def counts(signals: DataFrame) -> DataFrame:
    """(kind, value, n): signals by severity and by type, from one scan."""
    both = F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("signal_type").alias("value"))))
    return signals.select(both.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def review(signals: DataFrame, reviews: DataFrame) -> DataFrame:
    """signals with the latest review of each: reviewed, false_positive if any review gave it, notes if not empty."""
    return with_reviews(signals, review_state(reviews))


def review_state(reviews: DataFrame) -> DataFrame:
    """(signal_id, at, ord, reviewed, false_positive, notes) events -> a row for each signal: the latest of each field that an
    event gave, and when (at, ord); null notes and verdicts, and empty notes, give nothing."""
    given = {"reviewed": F.lit(True), "false_positive": F.col("false_positive").isNotNull(), "notes": F.length("notes") > 0}
    order = {c: F.when(g, F.struct("at", "ord")) for c, g in given.items()}
    return reviews.groupBy("signal_id").agg(*(x for c, o in order.items() for x in (F.max_by(c, o).alias(c), F.max(o).alias(f"{c}_at"))))


def merged_reviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two review_state() tables as one: the later of each field. In any order and however often the same events are merged,
    the result is that of all events at once."""
    both = old.unionByName(new)
    return both.groupBy("signal_id").agg(*(x for c in ("reviewed", "false_positive", "notes") for x in (F.max_by(c, f"{c}_at").alias(c), F.max(f"{c}_at").alias(f"{c}_at"))))


def with_reviews(signals: DataFrame, state: DataFrame) -> DataFrame:
    """signals with reviewed (false without a review), false_positive and analyst_notes of a review_state() table."""
    fields = state.select("signal_id", "reviewed", "false_positive", F.col("notes").alias("analyst_notes"))
    return signals.join(fields, "signal_id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def severity_rank(severity):  # noqa: ANN001, ANN201
    return sum((F.when(severity == s, i).otherwise(0) for i, s in enumerate(reversed(SEVERITIES))), F.lit(0))
