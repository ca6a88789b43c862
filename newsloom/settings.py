"""Options of a session: fixed defaults, overridden by Spark settings named spark.newsloom.<option>."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.newsloom."


# Thresholds and sizes that results must agree on.
@dataclass(frozen=True)
class Settings:
    """What a run takes where it is not told otherwise. Velocities are articles an hour, outlets and diversities are counts."""

    articles: str = "data/articles.csv"
    embedding_dimension: int = 384
    embedding_batch: int = 32
    min_cluster_size: int = 3
    min_samples: int = 2
    time_window: str = "4h"
    velocity_spreading: float = 2.0
    velocity_high: float = 5.0
    velocity_spike: float = 3.0
    diversity: int = 3
    diversity_high: int = 4
    outlets_high: int = 10
    bias_spread: float = 0.7
    coherence_tight: float = 0.85
    coherence_loose: float = 0.7

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The options of a session. A value that does not fit its option's type raises ValueError; settings of other names
        count for nothing."""
        found = {}
        for f in fields(cls):
            text = spark.conf.get(PREFIX + f.name, None)
            if text is not None:
                found[f.name] = {"int": int, "float": float}.get(str(f.type), str)(text)
        return cls(**found)
