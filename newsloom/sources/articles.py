"""Articles from CSV, with validation; sinks; and the view of the test tables as articles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import signals
from newsloom.schema import BIAS, FEEDBACK, OUTLET_TYPES, PATTERN_STRENGTH, RAW_ARTICLE, WIRE_SOURCES
from newsloom.settings import Settings
from newsloom.sources import ranges
from newsloom.sources.store import Store


def read_raw(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A CSV file or folder as text columns with the order of reading in ``ord``; limit None or 0 reads all."""
    raw = spark.read.schema(RAW_ARTICLE).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    raw = raw.withColumn("ord", F.monotonically_increasing_id())
    return raw.orderBy("ord").limit(limit) if limit else raw


#: Cells that are read as blank.
BLANKS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _blank(c: Column) -> Column:
    return F.when(c.isNull() | c.isin(*BLANKS), None).otherwise(c)


def validate(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejected). Rows without id, outlet or title, with an unknown outlet type or bias, or with a bad timestamp are
    rejected, with the first reason; in strict mode also rows with a blank optional cell. Unknown pattern types become null,
    unknown wire sources "Unknown", malformed keyword lists empty. Timestamps with an offset are turned to UTC."""
    c = {n: F.col(n) for n in raw.columns}
    ts = F.expr("try_cast(published_at as timestamp)").cast("timestamp_ntz")
    reasons = [
        (_blank(c["id"]).isNull() | _blank(c["outlet"]).isNull() | _blank(c["title"]).isNull(), "missing"),
        (~F.coalesce(c["outlet_type"].isin(*OUTLET_TYPES), F.lit(False)), "outlet_type"),
        (~F.coalesce(c["outlet_bias"].isin(*BIAS), F.lit(False)), "outlet_bias"),
        (ts.isNull(), "published_at"),
    ]
    if strict:
        optional = ("author", "url", "section", "pattern_type", "pattern_topic", "pr_source", "convergent_frame", "coordinated_frame")
        reasons.append((F.lit(False) if not optional else F.array_contains(F.array(*(_blank(c[n]).isNull() for n in optional)), True), "blank"))
    reason = F.coalesce(*(F.when(bad, F.lit(name)) for bad, name in reasons))
    judged = raw.withColumn("reason", reason)
    good = judged.where("reason is null").select(
        "id", "outlet", "outlet_type", "outlet_bias", "title",
        F.coalesce(_blank(c["body"]), F.lit("")).alias("body"),
        *(_blank(c[n]).alias(n) for n in ("author", "url", "section")),
        ts.alias("published_at"),
        F.when(c["wire_source"].isin(*WIRE_SOURCES), c["wire_source"]).otherwise("Unknown").alias("wire_source"),
        F.when(c["pattern_type"].isin(*PATTERN_STRENGTH), c["pattern_type"]).alias("pattern_type"),
        _blank(c["pattern_topic"]).alias("pattern_topic"),
        F.coalesce(F.from_json("keywords", "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>")).alias("keywords"),
        *(_blank(c[n]).alias(n) for n in ("pr_source", "convergent_frame", "coordinated_frame")),
        "ord",
    )
    return good, judged.where("reason is not null")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """What read_raw gives, of files too large for a task each: they are read by byte ranges, as ``sources.ranges`` says. Two
    passes over the files come first, so small ones are better read by read_raw."""
    return ranges.read(spark, path, RAW_ARTICLE)


def load(spark: SparkSession, path: str, limit: int | None = None, strict: bool = False, by_ranges: bool = False) -> DataFrame:
    """Valid articles of a CSV, whose files are read by byte ranges or each by one task; a path that isn't there raises
    AnalysisException. A limit reads the first rows, each file by one task."""
    raw = read_ranges(spark, path) if by_ranges and not limit else read_raw(spark, path, limit)
    return validate(raw, strict)[0]


def stream(spark: SparkSession, path: str, files: int = 1, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of a folder of CSV files as streams, ``files`` new files in a batch at most; row by row what load() and
    validate() give. ``ord`` is null: a stream has no order of reading. The folder must be there."""
    reader = spark.readStream.schema(RAW_ARTICLE).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return validate(reader.option("maxFilesPerTrigger", files).csv(path).withColumn("ord", F.lit(None).cast("long")), strict)


def load_default(spark: SparkSession) -> DataFrame:
    """Valid articles of the session's data set, spark.newsloom.articles; AnalysisException if it isn't there."""
    return load(spark, Settings.of(spark).articles)


def chunks(spark: SparkSession, path: str, size: int = 100, by_ranges: bool = False) -> DataFrame:
    """Valid articles with the number of their chunk of ``size`` rows in reading order. Rows are numbered within the part of
    the scan they came from and moved on by the counts of the parts before, a row each."""
    rows = load(spark, path, by_ranges=by_ranges).withColumn("__part", F.shiftright("ord", 33))
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")  # a row for each part of the scan
    place = F.row_number().over(Window.partitionBy("__part").orderBy("ord")) - 1
    moved = rows.withColumn("__place", place).join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    return moved.withColumn("chunk", F.floor((F.col("__before") + F.col("__place")) / size)).drop("__part", "__place", "__before")


def write_json(df: DataFrame, path: str) -> None:
    """A sink in parts, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], folder: str, name: str) -> str:
    """Write tables as JSON lines, each into a folder of its name, and publish them together as ``folder``/``name`` by one
    rename. A write that fails leaves nothing; a report of that name that is there already raises an error and stays."""
    spark = next(iter(tables.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    draft, final = at(f"{folder}/.{name}-{uuid.uuid4().hex}"), at(f"{folder}/{name}")
    fs = final.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        for table, df in tables.items():
            df.write.json(f"{draft.toString()}/{table}")
        if fs.exists(final) or not fs.rename(draft, final):
            raise FileExistsError(f"{folder}/{name} is there already")
    finally:
        fs.delete(draft, True)
    return final.toString()


def append_feedback(df: DataFrame, path: str, txn: tuple[str, int] | None = None) -> None:
    """Add feedback to the store at ``path``; readers see all of it or nothing. A transaction (writer, number) counts once."""
    columns = {f.name: F.col(f.name).cast(f.dataType) for f in FEEDBACK}
    Store(df.sparkSession, path).append("feedback", df.select(*(c.alias(n) for n, c in columns.items())), txn)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The feedback store; an absent one is empty."""
    kept = Store(spark, path).read("feedback")
    return spark.createDataFrame([], FEEDBACK) if kept is None else kept


def clear_feedback(spark: SparkSession, path: str) -> None:
    """Empty the feedback store, in one step: what was read before stays readable until the store is vacuumed."""
    Store(spark, path).truncate("feedback")


def record_reviews(reviews: DataFrame, path: str, txn: tuple[str, int] | None = None) -> None:
    """Merge review events (signal_id, at, ord, reviewed, false_positive, notes) into the store at ``path``, which keeps a row for each
    signal. Only the buckets of the reviewed signals are rewritten; events that come twice change nothing."""
    Store(reviews.sparkSession, path).merge("reviews", signals.review_state(reviews), ["signal_id"], signals.merged_reviews, txn=txn)


def add_clusters(table: DataFrame, path: str, txn: tuple[str, int] | None = None) -> None:
    """Add clusters to the store at ``path``; they are read by Store.read("clusters") and cleared by Store.truncate("clusters")."""
    Store(table.sparkSession, path).append("clusters", table, txn)


def pick(values: tuple, i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables as articles: embeddings joined to the event and the document of the same number."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), "embedding")
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").alias("published_at"), "user_id", F.col("event_type").alias("outlet_type"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("pattern_topic"), F.col("lang").alias("section"))
    i, u = F.col("id"), F.col("user_id")
    cut = F.instr("text", "\n")
    return e.join(v, "id").join(d, "id").select(
        "id", "cluster_id", "published_at", F.col("user_id").cast("string").alias("outlet"), "outlet_type",
        pick(tuple(BIAS), u % 5).alias("outlet_bias"), pick(WIRE_SOURCES, u % 6).alias("wire_source"),
        F.substring_index("text", "\n", 1).alias("title"), F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).otherwise("").alias("body"),
        pick((*PATTERN_STRENGTH, None), i % 6).alias("pattern_type"), "pattern_topic", "section",
        F.split("text", " ").alias("keywords"),
        F.when(i % 7 == 0, "PRWire").alias("pr_source"),
        F.when(i % 11 == 0, F.concat(F.lit("frame"), (i % 3).cast("string"))).alias("coordinated_frame"),
        F.when(i % 4 == 0, F.concat(F.lit("view"), (i % 2).cast("string"))).alias("convergent_frame"),
        "embedding",
    )


#: from_tables() for DuckDB, to follow WITH.
ARTICLES_SQL = """articles AS (SELECT vec_id AS id, label AS cluster_id, ts AS published_at, CAST(user_id AS VARCHAR) AS outlet, event_type AS outlet_type,
  (['left','center-left','center','center-right','right'])[user_id % 5 + 1] AS outlet_bias,
  (user_id % 5 - 2) * 0.5e0 AS bias,
  (['Reuters','AP','AFP','Original','Press Release','Unknown'])[user_id % 6 + 1] AS wire_source,
  split_part(text, chr(10), 1) AS title, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body,
  (['wire_echo','independent_reporting','pr_amplification','narrative_convergence','synchronized_messaging',NULL])[vec_id % 6 + 1] AS pattern_type,
  source AS pattern_topic, lang AS section, string_split(text, ' ') AS keywords,
  CASE WHEN vec_id % 7 = 0 THEN 'PRWire' END AS pr_source,
  CASE WHEN vec_id % 11 = 0 THEN 'frame' || (vec_id % 3) END AS coordinated_frame,
  CASE WHEN vec_id % 4 = 0 THEN 'view' || (vec_id % 2) END AS convergent_frame,
  embedding
 FROM embeddings JOIN events ON event_id = vec_id JOIN documents ON doc_id = vec_id)"""
