"""Weak labels of clusters: labelling functions as CASE expressions, one weighted vote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels.
ORGANIC, SUSPICIOUS, LIKELY, UNKNOWN = "organic", "suspicious", "likely_coordinated", "unknown"
#: Ties of the vote go to the earlier label.
PRIORITY = (ORGANIC, SUSPICIOUS, LIKELY)


@dataclass(frozen=True)
class Thresholds:
    ratio_suspicious: float = 2.0
    ratio_likely: float = 5.0
    duplicates: float = 0.5
    coherence: float = 0.85
    least_confidence: float = 0.4


def rules(t: Thresholds = Thresholds()) -> dict[str, list[tuple[str, str, float]]]:
    """Each function as (condition, label, weight), the first that holds; conditions are SQL over the cluster's signals.

    Fixed values: the functions' names, bounds and weights.
    """
    return {
        "lf_coordination_ratio": [(f"coordination_ratio > {t.ratio_likely}e0", LIKELY, 1.5), (f"coordination_ratio > {t.ratio_suspicious}e0", SUSPICIOUS, 1.0), ("coordination_ratio < 1.2e0", ORGANIC, 0.8)],
        "lf_duplicate_burst": [("duplicate_burst_score > 0.7e0", LIKELY, 1.3), (f"duplicate_burst_score > {t.duplicates}e0", SUSPICIOUS, 1.0), ("duplicate_burst_score < 0.1e0", ORGANIC, 0.7)],
        "lf_temporal_burst": [("velocity_zscore > 4e0 and semantic_coherence > 0.8e0", LIKELY, 1.2), ("burst_detected and semantic_coherence > 0.7e0", SUSPICIOUS, 0.9)],
        "lf_coherence_diversity": [(f"semantic_coherence > {t.coherence}e0 and coordination_ratio > 1.5e0", SUSPICIOUS, 0.8)],
        "lf_small_cluster": [("size < 10 and coordination_ratio < 1.5e0", ORGANIC, 0.6)],
        "lf_large_diverse": [("size > 50 and coordination_ratio < 1.3e0 and unique_authors > 40", ORGANIC, 1.0)],
    }


def weak_labels(clusters: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """clusters with label, confidence, fired (names, comma-joined) and n_fired. No function fires: unknown, 0; a winner under
    the least confidence: UNKNOWN with its confidence."""
    votes = []
    for name, cases in rules(t).items():
        vote = None
        for condition, label, weight in cases:
            s = F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(weight).alias("weight"))
            vote = F.when(F.expr(condition), s) if vote is None else vote.when(F.expr(condition), s)
        votes.append(vote)
    fired = clusters.withColumn("votes", F.filter(F.array(*votes), lambda v: v.isNotNull()))

    def weight(label: str) -> Column:
        return F.aggregate(F.filter("votes", lambda v: v["label"] == label), F.lit(0.0), lambda s, v: s + v["weight"])

    sums = fired.withColumns({f"w_{i}": weight(label) for i, label in enumerate(PRIORITY)})
    top, total = F.greatest("w_0", "w_1", "w_2"), F.col("w_0") + F.col("w_1") + F.col("w_2")
    winner = F.when(F.col("w_0") == top, ORGANIC).when(F.col("w_1") == top, SUSPICIOUS).otherwise(LIKELY)
    confidence = F.when(total == 0, 0.0).otherwise(top / F.when(total != 0, total))
    label = F.when((F.size("votes") == 0) | (confidence < t.least_confidence), UNKNOWN).otherwise(winner)
    return sums.select(*clusters.columns, label.alias("label"), confidence.alias("confidence"), F.array_join(F.transform("votes", lambda v: v["name"]), ",").alias("fired"), F.size("votes").alias("n_fired"))


def high_confidence(labelled: DataFrame, least: float = 0.7) -> DataFrame:
    return labelled.where((F.col("label") != UNKNOWN) & (F.col("confidence") >= least))
