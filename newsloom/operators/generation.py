"""Labelling of clusters by a text generator that the caller injects: excerpts, prompts, answers and what is read from them.

The generator is any function from a prompt to a text; it is sent to the tasks, once for each row, and may be called again for a
row whose task is repeated. memory.Remembered keeps its answers, so that no stored prompt is asked again. Prompts and answers are read with DataFrame functions; only the calls and strict JSON need Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.articles import keyword_label
from newsloom.operators.memory import Remembered, prompt_key

Generate = Callable[[str], str]

#: What the answers hold; a field of another type counts as absent.
CLAIMS = "templates array<struct<template: string, claim_type: string, frequency: int>>"
STANCE = "stance string, emotions map<string, double>, manipulation_indicators array<string>"
ASSESSMENT = "risk_level string, confidence double, indicators array<string>, counter_indicators array<string>, recommendation string"

ASK_CLAIMS = """Which statements recur in these texts, as patterns rather than as words of one person? Answer with JSON alone:
{"templates": [{"template": text, "claim_type": one of causal, hoax, manipulation, conspiracy, "frequency": number}]}"""
ASK_STANCE = """What stance and which feelings do these texts share, taken together? Answer with JSON alone:
{"stance": one of supportive, opposing, neutral, mixed, "emotions": {name: number from 0 to 1}, "manipulation_indicators": [text]}"""
ASK_ASSESSMENT = """Were these texts coordinated? Name what speaks for it and against it. Answer with JSON alone:
{"risk_level": one of low, medium, high, critical, "confidence": number from 0 to 1, "indicators": [text], "counter_indicators": [text], "recommendation": text}"""
ASK_EXPLANATION = "Explain this alert to the analyst who reviews it: what was found, what shows it, what to do next. Name no person."
ASK_NAME = "Name the story that these texts push, in five to eight words. Answer with the name alone."


def excerpts(docs: DataFrame, key: str = "cluster_id", text: str = "text", order: tuple[str, ...] = ("ord",), posts: int = 10, chars: int = 300) -> DataFrame:
    """(key, posts): the first ``posts`` texts of each key, cut to ``chars`` code points, numbered, a line each; a null text is
    empty. The cut is the feature; rows beyond it are pruned before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = docs.withColumn("__i", place).where(F.col("__i") <= posts)
    lines = first.select(key, "__i", F.concat(F.lit("[Post "), F.col("__i").cast("string"), F.lit("]: "), F.substring(F.coalesce(text, F.lit("")), 1, chars)).alias("__line"))
    listed = F.array_sort(F.collect_list(F.struct("__i", "__line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["__line"]), "\n").alias("posts"))


def json_object(text: Column) -> Column:
    """The JSON object from the first { to the last } of a text, as it stands there, if all of that is one object; else null.
    Strict: what follows an object makes it invalid. What is an object is what Python's reader takes for one: a name may come twice,
    numbers may be NaN, Infinity and -Infinity; but nothing may be nested deeper than 1,000 times.

    Spark's reader stops where an array ends, so the object is read in an array before a seal, its own hash: only a text that
    was read to its end leaves the seal in the second place."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    seal = F.sha2(block.cast("binary"), 256)
    read = F.from_json(F.concat(F.lit("["), block, F.lit(', "'), seal, F.lit('"]')), "array<string>", {"allowSingleQuotes": "false"})
    outside = F.regexp_replace(block, r'"(?:[^"\\]++|\\.)*+"', "")  # without its strings
    whole = (F.size(read) == 2) & (F.get(read, F.lit(1)) == seal) & F.get(read, F.lit(0)).startswith("{")
    return F.when((block != "") & whole & ~outside.rlike(r"INF|\+I"), block)


def answers(prompts: DataFrame, generate: Generate, key: str = "cluster_id") -> DataFrame:
    """(key, response, body) of prompts (key, prompt): what the generator said and the JSON object in it, null without one. A
    Remembered generator answers from its store, and is asked only what is not there."""
    if isinstance(generate, Remembered):
        keyed = prompts.select(key, prompt_key(F.col("prompt")).alias("prompt_key"))
        said = keyed.join(generate.ask(prompts.select("prompt")), "prompt_key", "left")
        return said.select(key, "response", json_object(F.col("response")).alias("body"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [generate(p) for p in batch["prompt"]]
            yield pd.DataFrame({key: batch[key], "response": said})

    said = prompts.select(key, "prompt").mapInPandas(ask, T.StructType([prompts.schema[key], T.StructField("response", T.StringType())]))
    return said.select(key, "response", json_object(F.col("response")).alias("body"))


def _about(question: str, *parts: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(question), *parts)


def _or(field: str, default: Column) -> Column:
    return F.coalesce(F.col(f"x.{field}"), default)


def claims(posts: DataFrame, generate: Generate, key: str = "cluster_id") -> DataFrame:
    """(key, claim_templates) of excerpts(): templates that aren't empty, of an unknown type and met once unless stated; none
    if the answer is no JSON object."""
    said = answers(posts.select(key, _about(ASK_CLAIMS, F.col("posts")).alias("prompt")), generate, key)
    found = F.filter(_or("templates", F.array().cast("array<struct<template: string, claim_type: string, frequency: int>>")), lambda t: F.length(t["template"]) > 0)
    whole = lambda t: F.struct(t["template"].alias("template"), F.coalesce(t["claim_type"], F.lit("unknown")).alias("claim_type"), F.coalesce(t["frequency"], F.lit(1)).alias("frequency"))
    return said.select(key, F.from_json("body", CLAIMS).alias("x")).select(key, F.transform(found, whole).alias("claim_templates"))


def stance(posts: DataFrame, generate: Generate, key: str = "cluster_id") -> DataFrame:
    """(key, stance, emotions, manipulation_indicators) of excerpts(); an unknown stance if the answer is no JSON object."""
    said = answers(posts.select(key, _about(ASK_STANCE, F.col("posts")).alias("prompt")), generate, key)
    none = F.array().cast("array<string>")
    return said.select(key, F.from_json("body", STANCE).alias("x")).select(key, _or("stance", F.lit("unknown")).alias("stance"), _or("emotions", F.create_map().cast("map<string,double>")).alias("emotions"), _or("manipulation_indicators", none).alias("manipulation_indicators"))


def assess(clusters: DataFrame, docs: DataFrame, generate: Generate, key: str = "cluster_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(key, risk_level, confidence, indicators, counter_indicators, recommendation) of every cluster (key, size,
    unique_authors, coordination_ratio, semantic_coherence, window_start, window_end), without documents too; an unknown risk of
    confidence 0 if the answer is no JSON object."""
    c = F.col
    rows = clusters.join(excerpts(docs.join(clusters.select(key), key, "left_semi"), key, order=order), key, "left")
    numbers = F.format_string("%s texts of %s authors, ratio %.2f, coherence %.2f, %s to %s", c("size").cast("string"), c("unique_authors").cast("string"), c("coordination_ratio").cast("double"), c("semantic_coherence").cast("double"), F.date_format("window_start", "yyyy-MM-dd HH:mm"), F.date_format("window_end", "HH:mm"))
    said = answers(rows.select(key, _about(ASK_ASSESSMENT, numbers, c("posts")).alias("prompt")), generate, key)
    none = F.array().cast("array<string>")
    return said.select(key, F.from_json("body", ASSESSMENT).alias("x")).select(key, _or("risk_level", F.lit("unknown")).alias("risk_level"), _or("confidence", F.lit(0.0)).alias("confidence"), _or("indicators", none).alias("indicators"), _or("counter_indicators", none).alias("counter_indicators"), _or("recommendation", F.lit("")).alias("recommendation"))


def explain(alerts: DataFrame, generate: Generate, key: str = "alert_id") -> DataFrame:
    """(key, explanation) of alerts (alert_type, severity, cluster_size, unique_authors, coordination_ratio,
    duplicate_burst_score, evidence: array of texts): the first five of the evidence, 200 code points each, are shown."""
    c = F.col
    shown = F.array_join(F.transform(F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 5), lambda t: F.concat(F.lit("- "), F.substring(t, 1, 200), F.lit("..."))), "\n")
    numbers = F.format_string("%s, %s: %s texts of %s authors, ratio %.2f, duplicates %.0f%%", "alert_type", "severity", c("cluster_size").cast("string"), c("unique_authors").cast("string"), c("coordination_ratio").cast("double"), F.coalesce("duplicate_burst_score", F.lit(0.0)) * 100)
    said = answers(alerts.select(key, _about(ASK_EXPLANATION, numbers, shown).alias("prompt")), generate, key)
    return said.select(key, F.col("response").alias("explanation"))


def _stripped(text: Column, what: str) -> Column:
    return F.regexp_replace(text, f"(?U)^{what}+|{what}+$", "")


def names(posts: DataFrame, generate: Generate, key: str = "cluster_id") -> DataFrame:
    """(key, name) of excerpts() with keywords: the answer without blanks and quotes around it if it has 6 to 99 code points,
    else what keyword_label() makes of the keywords. A generator that fails gives the same as no answer."""

    def safe(prompt: str) -> str | None:  # a Remembered generator keeps its failures itself
        try:
            return generate(prompt)
        except Exception:  # noqa: BLE001  a name is never worth a failed job
            return None

    said = answers(posts.select(key, _about(ASK_NAME, F.col("posts")).alias("prompt")), generate if isinstance(generate, Remembered) else safe, key)
    short = _stripped(_stripped(_stripped(F.col("response"), r"\s"), '"'), r"\s")
    kept = F.when(F.length(short).between(6, 99), short)
    return posts.select(key, "keywords").join(said.select(key, kept.alias("__name")), key, "left").select(key, F.coalesce("__name", keyword_label(F.col("keywords"))).alias("name"))


def label_clusters(clusters: DataFrame, docs: DataFrame, generate: Generate, key: str = "cluster_id", order: tuple[str, ...] = ("ord",), with_claims: bool = True, with_stance: bool = True) -> DataFrame:
    """A row for each cluster: key, assessment, and if asked for claim_templates and stance_emotion. A cluster without documents
    has no claims and an unknown stance, as an empty answer would give."""
    risk = assess(clusters, docs, generate, key, order)
    rows = risk.select(key, F.struct(*(c for c in risk.columns if c != key)).alias("coordination_assessment"))
    posts = clusters.select(key).join(excerpts(docs, key, order=order), key, "left")
    if with_claims:
        rows = rows.join(claims(posts, generate, key), key, "left")
    if with_stance:
        felt = stance(posts, generate, key)
        rows = rows.join(felt.select(key, F.struct(*(c for c in felt.columns if c != key)).alias("stance_emotion")), key, "left")
    return rows
