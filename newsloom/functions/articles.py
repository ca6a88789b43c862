"""Derived columns of articles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.schema import BIAS, PATTERN_STRENGTH, STAGE_ORDER, WIRE_ORIGINS


def lookup(values: dict, key: Column) -> Column:
    """A fixed table as one CASE expression; keys outside it give null."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def combined_text(title: Column, body: Column) -> Column:
    return F.when(F.length(body) > 0, F.concat(title, F.lit("\n\n"), body)).otherwise(title)


def bias_numeric(bias: Column) -> Column:
    return lookup(BIAS, bias)


def is_wire_origin(wire_source: Column) -> Column:
    return F.coalesce(wire_source.isin(*WIRE_ORIGINS), F.lit(False))


def is_pr_origin(wire_source: Column, pr_source: Column) -> Column:
    return F.coalesce(wire_source == "Press Release", F.lit(False)) | pr_source.isNotNull()


def has_frame(frame: Column) -> Column:
    return F.coalesce(F.length(frame) > 0, F.lit(False))


def signal_strength(pattern: Column) -> Column:
    return lookup(PATTERN_STRENGTH, pattern)


def stage_order(stage: Column) -> Column:
    return lookup(STAGE_ORDER, stage)


def hours(later: Column, earlier: Column) -> Column:
    """Signed hours between two timestamps."""
    return (micros(later) - micros(earlier)) / 3.6e9


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; timestamps without zone count as UTC (the session's zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def iso(ts: Column) -> Column:
    """ISO 8601 text; microseconds only where they aren't zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros(ts) % 1_000_000 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


# Keywords that name what a campaign wants.
ACTIONS = {"buy": "Buy", "sell": "Sell", "hold": "Hold", "moon": "Pump", "squeeze": "Squeeze", "target": "Target"}


def keyword_label(keywords: Column) -> Column:
    """A name for a story that no generator named, from its first three keywords: a campaign for the first ticker, wanting what
    the first keyword of ACTIONS says; else a campaign named by the first two; with fewer than two, unclassified."""
    three = F.slice(keywords, 1, 3)
    ticker = F.get(F.filter(three, lambda k: k.startswith("$")), F.lit(0))
    action = F.get(F.filter(F.transform(three, lambda k: lookup(ACTIONS, k)), lambda a: a.isNotNull()), F.lit(0))
    named = F.concat(F.coalesce(action, F.lit("Campaign")), F.lit(" Campaign for "), F.upper(ticker))
    two = F.concat(F.lit("Coordinated "), F.initcap(F.array_join(F.slice(keywords, 1, 2), " ")), F.lit(" Campaign"))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) < 2, "Unclassified Coordination Pattern").when(ticker.isNotNull(), named).otherwise(two)
