"""Domains, schemas and settings."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the data model.
OUTLET_TYPES = ("wire_service", "major_national", "local_regional", "independent")
BIAS = {"left": -1.0, "center-left": -0.5, "center": 0.0, "center-right": 0.5, "right": 1.0}
PATTERN_STRENGTH = {"wire_echo": "low", "independent_reporting": "low", "pr_amplification": "medium", "narrative_convergence": "medium", "synchronized_messaging": "high"}
STAGE_ORDER = {"nascent": 0, "emerging": 1, "spreading": 2, "established": 3, "declining": 4, "dormant": 5}
SEVERITIES = ("info", "low", "medium", "high", "critical")
WIRE_SOURCES = ("Reuters", "AP", "AFP", "Original", "Press Release", "Unknown")
WIRE_ORIGINS = ("Reuters", "AP", "AFP")
LABELS = ("organic", "suspicious", "likely_coordinated", "unknown")

#: A raw CSV row: everything is text until it is validated.
RAW_COLUMNS = ("id", "outlet", "outlet_type", "outlet_bias", "title", "body", "author", "url", "section", "published_at", "wire_source", "pattern_type", "pattern_topic", "keywords", "pr_source", "convergent_frame", "coordinated_frame")
RAW_ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

FEEDBACK = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("analyst_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("notes", T.StringType()),
        T.StructField("time_spent_seconds", T.IntegerType()),
    ]
)

