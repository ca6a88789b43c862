"""A corpus pipeline of five stages over the documents: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import mixing, packing, pii, queries, simhash, toxicity
from newsloom.llm.common import discard, stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score so high or higher are rejected.
TOXIC = 0.5
#: Near duplicates share 0.8 of their five-word shingles. Over five words such pairs differ in up to 14 of 64 bits, a radius that links
#: strangers too; over two words 8 bits hold 0.92 of them, and no pair that shares under 0.2 (all pairs of sf0.1; see the tests).
NEAR_BITS, NEAR_WORDS = 8, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC; the model learns from the labelled documents of the stage's input that are not held
    out. Null texts stay."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id. Documents are linked whose fingerprints over
    NEAR_WORDS words differ in NEAR_BITS bits at most. Rows that repeat an id are one document if
    their texts are of one group, else one of each group stays.

    The ids to keep are joined on doc_id, a row each; only texts of repeated ids are fingerprinted again. Documents without an
    id all stay.
    """
    docs = docs.select(*COLUMNS)
    groups = stash(simhash.grouped(docs, NEAR_BITS, NEAR_WORDS).where("doc_id is not null"), "pipeline-groups")
    mine = groups.where(F.col("doc_id") == F.col("component_id"))
    kept = docs.join(mine.select("doc_id").distinct(), "doc_id", "left_semi")
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    single = kept.join(repeated, "doc_id", "left_anti")
    again = simhash.fingerprints(kept.join(repeated, "doc_id", "left_semi"), width=NEAR_WORDS).join(mine.select("doc_id", "fp", "root").distinct(), ["doc_id", "fp"])
    least = again.groupBy("doc_id", "root").agg(F.min(F.struct(*(F.col(c) for c in COLUMNS[1:]))).alias("x")).select("doc_id", "x.*")
    return single.unionByName(least).unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows."""
    changed = pii.redact(docs.select(*COLUMNS), pii.fit(spark))
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, up to three; others go. Documents without words are in no source's
    target and stay once."""
    return mixing.copies(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, queries.tokenizer_text())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{name}")
            if i:
                discard(before)
    return docs


#: SQL can express neither the fingerprints nor the learned models. Tests hold near_duplicates against all pairs in plain Python, and the
#: other stages against what their operators decide, which have brute-force tests and measured accuracies of their own.
ORACLE_SQL: str | None = None
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
