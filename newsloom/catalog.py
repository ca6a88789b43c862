"""The registered queries over the engine's operators, each with its DuckDB counterpart where SQL can express it.

Every query reads its whole tables. Articles are the rows that embeddings, events and documents share by number, since no table
holds all their columns. The SQL is written by hand: it reads no rule or threshold from the operators it is to check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.articles import bias_numeric, combined_text, has_frame, hours, is_pr_origin, is_wire_origin, iso, keyword_label, signal_strength
from newsloom.operators import clustering, drift, evaluation, feedback, labeling, metrics, signals, splits, vectors, windows
from newsloom.sources.articles import ARTICLES_SQL, from_tables, pick

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- adapters of the test tables -------------------------------------------------------------------------------------

#: Events as signals of clusters; the text runs in both engines.
SIGNALS_SQL = """SELECT user_id % 97 AS cluster_id, count(*) AS size, count(DISTINCT user_id) AS unique_authors,
  count(*) * 1e0 / count(DISTINCT user_id) AS coordination_ratio, avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END) * 2e0 AS duplicate_burst_score,
  count(DISTINCT event_type) AS duplicate_groups, max(event_id % 10) AS max_duplicate_group_size, count(*) / 24e0 AS posting_velocity,
  avg((event_id % 100) * 1e0) - 45e0 AS velocity_zscore, max(event_id % 1000) > 985 AS burst_detected,
  avg((event_id % 7) * 1e0) / 3e0 - 0.2e0 AS semantic_coherence, avg(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END) AS topic_concentration,
  min(ts) AS window_start, max(ts) AS window_end FROM {events} GROUP BY user_id % 97"""
SIGNALS_CTE = f"signals AS ({SIGNALS_SQL.format(events='events')})"
_LEVEL = "CASE WHEN coordination_ratio > 5e0 THEN 'likely' WHEN coordination_ratio > 2e0 THEN 'suspicious' ELSE 'organic' END"


def cluster_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SIGNALS_SQL, events=_read(spark, sf_dir, "events"))


VERDICTS = ("confirmed", "false_positive", "needs_review", "unsure")
FEEDBACK_CTE = """feedback AS (SELECT CAST(user_id % 400 AS VARCHAR) AS alert_id, event_type AS analyst_id, ts AS timestamp,
  (['confirmed','false_positive','needs_review','unsure'])[(event_id * 7 + user_id) % 4 + 1] AS verdict, (event_id % 101) / 100e0 AS confidence,
  event_id % 60 AS time_spent_seconds, event_id AS ord FROM events)"""


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return _read(spark, sf_dir, "events").select((u % 400).cast("string").alias("alert_id"), F.col("event_type").alias("analyst_id"), F.col("ts").alias("timestamp"), pick(VERDICTS, (e * 7 + u) % 4).alias("verdict"), ((e % 101) / F.lit(100.0)).alias("confidence"), (e % 60).alias("time_spent_seconds"), e.alias("ord"))


ALERTS_CTE = """alerts AS (SELECT CAST(event_id AS VARCHAR) AS alert_id, user_id % 97 AS cluster_id, (['critical','high','medium','low','info'])[user_id % 5 + 1] AS severity,
  CASE WHEN event_id % 9 <> 0 THEN (event_id * 13 % 97) / 97e0 END AS confidence, (event_id * 31 % 101) / 20e0 AS coordination_ratio, ts AS alert_time, event_id AS ord FROM events)"""


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return _read(spark, sf_dir, "events").select(e.cast("string").alias("alert_id"), (u % 97).alias("cluster_id"), pick(("critical", "high", "medium", "low", "info"), u % 5).alias("severity"), F.when(e % 9 != 0, (e * 13 % 97) / F.lit(97.0)).alias("confidence"), ((e * 31 % 101) / F.lit(20.0)).alias("coordination_ratio"), F.col("ts").alias("alert_time"), e.alias("ord"))


SCORED_CTE = "scored AS (SELECT doc_id, (n_chars * 7 % 211) / 211e0 AS score, quality = 1 AS truth FROM documents JOIN labels USING (doc_id))"


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") * 7 % 211) / F.lit(211.0)).alias("score"))
    return docs.join(_read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")


# --- articles and clusters -------------------------------------------------------------------------------------------

_FLAGS = "wire_source IN ('Reuters','AP','AFP')"
_PR = "(wire_source = 'Press Release' OR pr_source IS NOT NULL)"


@query("dataset_stats", f"""WITH {ARTICLES_SQL} SELECT count(*) AS total, count(DISTINCT outlet) AS outlets,
  {', '.join(f"coalesce(string_agg(DISTINCT {c}, ',' ORDER BY {c}) FILTER ({c} <> ''), '') AS {c}_list" for c in ('outlet_type', 'outlet_bias', 'section', 'pattern_topic', 'pattern_type'))},
  min(published_at) AS first_ts, max(published_at) AS last_ts, count(*) FILTER ({_FLAGS}) AS wire, count(*) FILTER ({_PR}) AS pr,
  count(*) FILTER (length(coordinated_frame) > 0) AS coordinated, count(*) FILTER (length(convergent_frame) > 0) AS convergent FROM articles""")
def dataset_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.dataset_stats(from_tables(spark, sf_dir))


@query("article_projection", f"""WITH {ARTICLES_SQL} SELECT id, length(CASE WHEN length(body) > 0 THEN title || chr(10) || chr(10) || body ELSE title END) AS text_chars,
  bias AS bias_numeric, CASE pattern_type WHEN 'wire_echo' THEN 'low' WHEN 'independent_reporting' THEN 'low' WHEN 'pr_amplification' THEN 'medium' WHEN 'narrative_convergence' THEN 'medium' WHEN 'synchronized_messaging' THEN 'high' END AS strength,
  CASE WHEN microsecond(published_at) % 1000000 = 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f') END AS published FROM articles""")
def article_projection(spark, sf_dir):  # noqa: ANN001, ANN201
    c = F.col
    return from_tables(spark, sf_dir).select("id", F.length(combined_text(c("title"), c("body"))).cast("long").alias("text_chars"), bias_numeric(c("outlet_bias")).alias("bias_numeric"), signal_strength(c("pattern_type")).alias("strength"), iso(c("published_at")).alias("published"))


@query("wire_pr_flags", f"""WITH {ARTICLES_SQL} SELECT id, {_FLAGS} AS wire, {_PR} AS pr, coalesce(length(coordinated_frame) > 0, false) AS coordinated, coalesce(length(convergent_frame) > 0, false) AS convergent FROM articles""")
def wire_pr_flags(spark, sf_dir):  # noqa: ANN001, ANN201
    c = F.col
    return from_tables(spark, sf_dir).select("id", is_wire_origin(c("wire_source")).alias("wire"), is_pr_origin(c("wire_source"), c("pr_source")).alias("pr"), has_frame(c("coordinated_frame")).alias("coordinated"), has_frame(c("convergent_frame")).alias("convergent"))


_HOURS = "(epoch_us(max(published_at)) - epoch_us(min(published_at))) / 3.6e9"
METRICS_CTE = f"""raw AS (SELECT cluster_id, count(*) AS size, count(DISTINCT outlet) AS unique_outlets, string_agg(DISTINCT outlet_type, ',' ORDER BY outlet_type) AS outlet_types,
  count(DISTINCT outlet_type) AS source_diversity, coalesce(stddev_samp(bias), 0e0) AS bias_spread, avg(bias) AS bias_mean, {_HOURS} AS duration_hours,
  avg(CASE WHEN {_FLAGS} THEN 1e0 ELSE 0e0 END) AS wire_origin_ratio, avg(CASE WHEN {_PR} THEN 1e0 ELSE 0e0 END) AS pr_origin_ratio,
  bool_or(coordinated_frame IS NOT NULL) AS has_coordinated, bool_or(convergent_frame IS NOT NULL) AS has_convergent, arg_min({_FLAGS}, (published_at, id)) AS first_is_wire FROM articles GROUP BY cluster_id),
metrics AS (SELECT *, CASE WHEN duration_hours = 0 THEN size ELSE size / duration_hours END AS velocity,
  CASE WHEN unique_outlets <= 2 AND duration_hours < 6 THEN 'nascent' WHEN unique_outlets <= 5 THEN 'emerging' WHEN source_diversity < 3 THEN 'spreading' ELSE 'established' END AS stage FROM raw)"""


@query("cluster_metrics", f"""WITH {ARTICLES_SQL}, {METRICS_CTE} SELECT cluster_id, size, unique_outlets, outlet_types, source_diversity,
  {', '.join(f'round({c}, 6) AS {c}' for c in ('bias_spread', 'bias_mean', 'duration_hours', 'velocity', 'wire_origin_ratio', 'pr_origin_ratio'))}, stage FROM metrics""")
def cluster_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.summary(metrics.cluster_metrics(from_tables(spark, sf_dir)))


def _mode_sql(value: str, out: str) -> str:
    return f"""WITH {ARTICLES_SQL}, c AS (SELECT cluster_id, {value} AS v, count(*) AS n, min((published_at, id)) AS first FROM articles WHERE length({value}) > 0 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rn FROM c) SELECT cluster_id, v AS {out} FROM r WHERE rn = 1"""


@query("cluster_mode_topic", _mode_sql("pattern_topic", "topic"))
def cluster_mode_topic(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.first_mode(from_tables(spark, sf_dir), "cluster_id", "pattern_topic", ("published_at", "id"), "topic")


@query("cluster_dominant_pattern", _mode_sql("pattern_type", "dominant_pattern"))
def cluster_dominant_pattern(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.first_mode(from_tables(spark, sf_dir), "cluster_id", "pattern_type", ("published_at", "id"), "dominant_pattern")


@query("cluster_common_frame", f"""WITH {ARTICLES_SQL}, v AS (SELECT cluster_id, published_at, id, coordinated_frame AS f, 0 AS k FROM articles UNION ALL SELECT cluster_id, published_at, id, convergent_frame, 1 FROM articles),
  c AS (SELECT cluster_id, k, f, count(*) AS n, min((published_at, id)) AS first FROM v WHERE f <> '' GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY k, n DESC, first) AS rn FROM c)
  SELECT a.cluster_id, r.f AS common_frame FROM (SELECT DISTINCT cluster_id FROM articles) a LEFT JOIN r ON r.cluster_id = a.cluster_id AND rn = 1""")
def cluster_common_frame(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.common_frame(from_tables(spark, sf_dir))


@query("representative_headline", f"""WITH {ARTICLES_SQL} SELECT cluster_id, arg_min(title, (CASE WHEN {_FLAGS} THEN 0 ELSE 1 END, published_at, id)) AS headline, min(published_at) AS first_seen, max(published_at) AS last_seen FROM articles GROUP BY cluster_id""")
def representative_headline(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.headline(from_tables(spark, sf_dir))


@query("keyword_topn", f"""WITH {ARTICLES_SQL}, w AS (SELECT cluster_id, published_at, id, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS place FROM articles),
  c AS (SELECT cluster_id, keyword, count(*) AS n, min((published_at, id, place)) AS first FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rank FROM c)
  SELECT cluster_id, CAST(rank AS INTEGER) AS rank, keyword, n FROM r WHERE rank <= 10""")
def keyword_topn(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.keyword_counts(from_tables(spark, sf_dir))


@query("cluster_timeline", f"""WITH {ARTICLES_SQL} SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, id) AS INTEGER) AS place, id, published_at, outlet, title FROM articles""")
def cluster_timeline(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.timeline(from_tables(spark, sf_dir))


_BIASES = ("left", "center-left", "center", "center-right", "right")


@query("bias_histogram_zero_filled", f"""WITH {ARTICLES_SQL} SELECT c.cluster_id, d.value, count(a.id) AS n FROM (SELECT DISTINCT cluster_id FROM articles) c CROSS JOIN (SELECT unnest({list(_BIASES)}) AS value) d
  LEFT JOIN articles a ON a.cluster_id = c.cluster_id AND a.outlet_bias = d.value GROUP BY ALL""")
def bias_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.distribution_by(from_tables(spark, sf_dir), "cluster_id", "outlet_bias", _BIASES)


@query("pattern_distribution", f"WITH {ARTICLES_SQL} SELECT coalesce(pattern_type, 'unknown') AS value, count(*) AS n FROM articles GROUP BY 1")
def pattern_distribution(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.distribution(from_tables(spark, sf_dir), "pattern_type")


@query("stage_distribution", f"WITH {ARTICLES_SQL}, {METRICS_CTE.replace('cluster_id', 'pattern_topic')} SELECT stage AS value, count(*) AS n FROM metrics GROUP BY 1")
def stage_distribution(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.distribution(metrics.cluster_metrics(from_tables(spark, sf_dir), "pattern_topic"), "stage")


# --- filters of the query surface ------------------------------------------------------------------------------------


@query("articles_filtered", f"WITH {ARTICLES_SQL} SELECT id, outlet, outlet_type, pattern_topic FROM articles WHERE contains(lower(outlet), '1') AND outlet_type = 'view' AND contains(lower(pattern_topic), 'src1') ORDER BY id LIMIT 100")
def articles_filtered(spark, sf_dir):  # noqa: ANN001, ANN201
    return from_tables(spark, sf_dir).where(F.lower("outlet").contains("1") & (F.col("outlet_type") == "view") & F.lower("pattern_topic").contains("src1")).select("id", "outlet", "outlet_type", "pattern_topic").orderBy("id").limit(100)


@query("clusters_filtered", f"WITH {ARTICLES_SQL}, {METRICS_CTE.replace('cluster_id', 'pattern_topic')} SELECT pattern_topic, size, stage FROM metrics WHERE stage = 'established' AND contains(lower(pattern_topic), lower('SRC1')) AND size >= 5 ORDER BY size DESC, pattern_topic")
def clusters_filtered(spark, sf_dir):  # noqa: ANN001, ANN201
    m = metrics.cluster_metrics(from_tables(spark, sf_dir), "pattern_topic")
    return m.where((F.col("stage") == "established") & F.lower("pattern_topic").contains("src1") & (F.col("size") >= 5)).select("pattern_topic", "size", "stage").orderBy(F.desc("size"), "pattern_topic")


@query("top_coordinated", f"WITH {SIGNALS_CTE} SELECT cluster_id, size, round(coordination_ratio, 6) AS coordination_ratio FROM signals WHERE coordination_ratio >= 2 ORDER BY signals.coordination_ratio DESC, cluster_id LIMIT 10")
def top_coordinated(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(cluster_signals(spark, sf_dir).where("coordination_ratio >= 2").orderBy(F.desc("coordination_ratio"), "cluster_id").limit(10).select("cluster_id", "size", "coordination_ratio"))


@query("signal_clusters_page", f"WITH {SIGNALS_CTE} SELECT cluster_id, size, {_LEVEL} AS level FROM signals WHERE size >= 5 AND window_start >= TIMESTAMP '2024-01-01' ORDER BY coordination_ratio DESC, cluster_id LIMIT 20 OFFSET 5")
def signal_clusters_page(spark, sf_dir):  # noqa: ANN001, ANN201
    c = cluster_signals(spark, sf_dir).where("size >= 5 and window_start >= timestamp_ntz '2024-01-01 00:00:00'")
    return c.orderBy(F.desc("coordination_ratio"), "cluster_id").offset(5).limit(20).select("cluster_id", "size", F.expr(_LEVEL).alias("level"))


@query("window_summary", f"""WITH {SIGNALS_CTE} SELECT count(*) AS clusters, CAST(coalesce(sum(size), 0) AS BIGINT) AS documents, count(*) FILTER ({_LEVEL} = 'organic') AS organic, count(*) FILTER ({_LEVEL} = 'suspicious') AS suspicious,
  count(*) FILTER ({_LEVEL} = 'likely') AS likely, round(coalesce(avg(coordination_ratio), 0e0), 6) AS avg_ratio, round(coalesce(max(coordination_ratio), 0e0), 6) AS max_ratio, round(coalesce(avg(semantic_coherence), 0e0), 6) AS avg_coherence FROM signals""")
def window_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    c, zero = cluster_signals(spark, sf_dir).withColumn("level", F.expr(_LEVEL)), F.lit(0.0)
    return _rounded(c.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("documents"), *(F.count_if(F.col("level") == x).alias(x) for x in ("organic", "suspicious", "likely")), F.coalesce(F.avg("coordination_ratio"), zero).alias("avg_ratio"), F.coalesce(F.max("coordination_ratio"), zero).alias("max_ratio"), F.coalesce(F.avg("semantic_coherence"), zero).alias("avg_coherence")))


# --- windows ---------------------------------------------------------------------------------------------------------


def _spine(size: str, step: str, last: str = "hi - lo") -> str:
    return f"""b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
      s AS (SELECT unnest(generate_series(0, ({last}) // {step})) AS w, lo FROM b), win AS (SELECT w, lo + w * {step} AS a, lo + w * {step} + {size} AS z FROM s)"""


H = 3_600_000_000
_COUNTS = "SELECT make_timestamp(a) AS window_start, make_timestamp(z) AS window_end, count(event_id) AS n FROM win LEFT JOIN events ON epoch_us(ts) >= a AND epoch_us(ts) < z GROUP BY ALL"


@query("tumbling_counts", f"WITH {_spine(str(4 * H), str(4 * H))} {_COUNTS}")
def tumbling_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.counts(_read(spark, sf_dir, "events"), "ts", "4h")


@query("hopping_counts", f"WITH {_spine(str(4 * H), str(H))} {_COUNTS}")
def hopping_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.counts(_read(spark, sf_dir, "events"), "ts", "4h", "1h")


@query("hopping_gaps", f"WITH {_spine(str(H), str(4 * H))} {_COUNTS}")
def hopping_gaps(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.counts(_read(spark, sf_dir, "events"), "ts", "1h", "4h")


@query("time_series_counts", f"WITH {_spine(str(H), str(H))} SELECT make_timestamp(a) AS bucket, count(event_id) AS n FROM win LEFT JOIN events ON epoch_us(ts) >= a AND epoch_us(ts) < z GROUP BY ALL")
def time_series_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.time_series(_read(spark, sf_dir, "events"), "ts", "1h")


@query("cumulative_counts", f"WITH {_spine(str(4 * H), str(4 * H))} SELECT make_timestamp(z) AS window_end, count(event_id) AS n FROM win LEFT JOIN events ON epoch_us(ts) < z GROUP BY ALL")
def cumulative_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.cumulative(_read(spark, sf_dir, "events"), "ts", "4h")


@query("sliding_delta", f"""WITH {_spine(str(4 * H), str(H))}, m AS (SELECT w, event_id AS id FROM win JOIN events ON epoch_us(ts) >= a AND epoch_us(ts) < z)
  SELECT w, (SELECT count(*) FROM m WHERE m.w = win.w) AS n_all, (SELECT count(*) FROM m WHERE m.w = win.w AND NOT EXISTS (SELECT 1 FROM m p WHERE p.w = m.w - 1 AND p.id = m.id)) AS n_new,
   (SELECT count(*) FROM m WHERE m.w = win.w AND EXISTS (SELECT 1 FROM m p WHERE p.w = m.w - 1 AND p.id = m.id)) AS n_retained,
   (SELECT count(*) FROM m WHERE m.w = win.w - 1 AND NOT EXISTS (SELECT 1 FROM m p WHERE p.w = m.w + 1 AND p.id = m.id)) AS n_expired FROM win""")
def sliding_delta(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.sliding_delta(_read(spark, sf_dir, "events"))


@query("sliding_members", f"""WITH {_spine(str(4 * H), str(H))}, m AS (SELECT w, event_id AS id FROM win JOIN events ON epoch_us(ts) >= a AND epoch_us(ts) < z), p AS (SELECT w + 1 AS w, id FROM m)
  SELECT w, id, CASE WHEN p.id IS NULL THEN 'new' WHEN m.id IS NULL THEN 'expired' ELSE 'retained' END AS state FROM (SELECT w, id, id AS k FROM m) m2 JOIN m USING (w, id) LEFT JOIN p USING (w, id)
  UNION ALL SELECT w, id, 'expired' FROM p WHERE w <= (SELECT max(w) FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.w = p.w AND m.id = p.id)""")
def sliding_members(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.sliding_members(_read(spark, sf_dir, "events"))


@query("group_by_topic", "SELECT coalesce(nullif(event_type, ''), 'unknown') AS topic, CAST(row_number() OVER (PARTITION BY coalesce(nullif(event_type, ''), 'unknown') ORDER BY ts, event_id) AS INTEGER) AS place, event_id AS id, ts FROM events")
def group_by_topic(spark, sf_dir):  # noqa: ANN001, ANN201
    return windows.by_topic(_read(spark, sf_dir, "events"))


# --- vectors ---------------------------------------------------------------------------------------------------------

CELLS_CTE = "cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
CENTERS_CTE = f"{CELLS_CTE}, cv AS (SELECT label, dim, avg(x) AS value FROM cells GROUP BY ALL), centers AS (SELECT label, list(value ORDER BY dim) AS c FROM cv GROUP BY label)"


@query("centroids", f"WITH {CELLS_CTE} SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value FROM cells GROUP BY ALL")
def centroids(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(vectors.centroids(_read(spark, sf_dir, "embeddings")))


@query("coherence", "SELECT a.label, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS coherence FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def coherence(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(vectors.coherence(_read(spark, sf_dir, "embeddings")))


@query("cosine_topk", "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, id LIMIT 20")
def cosine_topk(spark, sf_dir):  # noqa: ANN001, ANN201
    v = _read(spark, sf_dir, "embeddings")
    query = v.where("vec_id = 7").first()
    return _rounded(vectors.top_k(v, query.embedding if query else [], 20))


@query("similar_clusters", f"WITH {CENTERS_CTE} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM centers a JOIN centers b ON a.label < b.label WHERE list_cosine_similarity(a.c, b.c) >= 0.05")
def similar_clusters(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(vectors.similar_clusters(_read(spark, sf_dir, "embeddings"), threshold=0.05))


@query("nearest_centroid_assign", f"""WITH {CENTERS_CTE}, s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], c.c) AS similarity FROM embeddings CROSS JOIN centers c),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS rn FROM s) SELECT vec_id AS id, label, round(similarity, 6) AS similarity FROM r WHERE rn = 1 AND similarity >= 0.3""")
def nearest_centroid_assign(spark, sf_dir):  # noqa: ANN001, ANN201
    v = _read(spark, sf_dir, "embeddings")
    centers = vectors.as_arrays(vectors.centroids(v), "label")
    return _rounded(vectors.nearest_centroid(v, centers, threshold=0.3))


@query("silhouette_cosine", """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_cosine_similarity(a.e, b.e)) AS s, count(*) AS n FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL),
  x AS (SELECT vec_id, label, max(CASE WHEN other = label THEN s / n END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY ALL)
  SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM x""")
def silhouette_cosine(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(evaluation.silhouette(_read(spark, sf_dir, "embeddings")))


@query("hdbscan_labels")
def hdbscan_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return clustering.cluster(_read(spark, sf_dir, "embeddings"))


@query("update_clusters_exact")
def update_clusters_exact(spark, sf_dir):  # noqa: ANN001, ANN201
    a = from_tables(spark, sf_dir)
    old, new = a.where("id % 4 = 0"), a.where("id % 4 <> 0")  # clusters as they were, and what arrives
    key = F.col("cluster_id") * 8 + F.coalesce(F.ascii("section"), F.lit(0)) % 8  # each section has clusters of its own
    old = old.withColumn("cluster", key)
    centers = vectors.as_arrays(vectors.centroids(old, "cluster"), "cluster").join(old.groupBy("cluster").agg(F.count("*").alias("size"), F.min("section").alias("section")), "cluster")
    return _rounded(clustering.update_clusters(new.select("id", F.col("published_at").alias("ts"), "embedding", "section"), centers.select("cluster", "centroid", "size", "section"), "section", 0.3))


# --- signals ---------------------------------------------------------------------------------------------------------

_COHERENCE_CTE = "coh AS (SELECT a.cluster_id, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS coherence FROM articles a JOIN articles b ON a.cluster_id = b.cluster_id AND a.id < b.id GROUP BY 1)"
_FIRED_CTE = """fired AS (
  SELECT cluster_id, 'rapid_emergence' AS signal_type, CASE WHEN velocity >= 5 THEN 'high' ELSE 'medium' END AS severity FROM metrics WHERE stage IN ('nascent', 'emerging') AND velocity >= 2
  UNION ALL SELECT cluster_id, 'cross_spectrum', CASE WHEN unique_outlets >= 10 THEN 'high' ELSE 'medium' END FROM metrics WHERE bias_spread >= 0.7e0 AND size >= 2
  UNION ALL SELECT cluster_id, 'wire_cascade', 'low' FROM metrics WHERE first_is_wire AND unique_outlets >= 3
  UNION ALL SELECT cluster_id, 'pr_amplification', CASE WHEN source_diversity >= 3 THEN 'high' ELSE 'medium' END FROM metrics WHERE pr_origin_ratio > 0 AND unique_outlets >= 3
  UNION ALL SELECT cluster_id, 'frame_convergence', 'low' FROM metrics LEFT JOIN coh USING (cluster_id) WHERE has_convergent AND NOT has_coordinated AND coherence >= 0.7e0
  UNION ALL SELECT cluster_id, 'synchronized', CASE WHEN unique_outlets >= 10 OR source_diversity >= 4 THEN 'critical' ELSE 'high' END FROM metrics LEFT JOIN coh USING (cluster_id) WHERE has_coordinated AND coherence >= 0.85e0)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = from_tables(spark, sf_dir)
    return signals.detect(metrics.cluster_metrics(a), a, vectors.coherence(a, "cluster_id"))


@query("signals_by_rule", f"WITH {ARTICLES_SQL}, {METRICS_CTE}, {_COHERENCE_CTE}, {_FIRED_CTE} SELECT cluster_id, signal_type, severity, 'sig_' || signal_type || '_' || substr(sha256(cluster_id || ':' || signal_type), 1, 8) AS signal_id FROM fired")
def signals_by_rule(spark, sf_dir):  # noqa: ANN001, ANN201
    return _signals(spark, sf_dir)


@query("signals_by_severity_type", f"WITH {ARTICLES_SQL}, {METRICS_CTE}, {_COHERENCE_CTE}, {_FIRED_CTE} SELECT 'severity' AS kind, severity AS value, count(*) AS n FROM fired GROUP BY severity UNION ALL SELECT 'type', signal_type, count(*) FROM fired GROUP BY signal_type")
def signals_by_severity_type(spark, sf_dir):  # noqa: ANN001, ANN201
    return signals.counts(_signals(spark, sf_dir))


_REVIEWS_CTE = "reviews AS (SELECT 's' || (event_id % 50) AS signal_id, ts AS moment, event_id AS ord, event_id % 3 <> 0 AS reviewed, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS false_positive, CASE WHEN event_id % 5 = 0 THEN 'note ' || event_id ELSE '' END AS notes FROM events)"


@query("signal_review_merge", f"""WITH {_REVIEWS_CTE}, s AS (SELECT DISTINCT 's' || (event_id % 60) AS signal_id FROM events) SELECT s.signal_id, coalesce(arg_max(reviewed, row(moment, ord)), false) AS reviewed,
  arg_max(false_positive, row(moment, ord)) FILTER (false_positive IS NOT NULL) AS false_positive, arg_max(notes, row(moment, ord)) FILTER (notes <> '') AS analyst_notes FROM s LEFT JOIN reviews USING (signal_id) GROUP BY s.signal_id""")
def signal_review_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    return signals.review(*review_rows(spark, sf_dir))


def review_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(signals, reviews), both from the events."""
    e = F.col("event_id")
    events = _read(spark, sf_dir, "events")
    reviews = events.select(F.concat(F.lit("s"), (e % 50).cast("string")).alias("signal_id"), F.col("ts").alias("at"), e.alias("ord"), (e % 3 != 0).alias("reviewed"), F.when(e % 4 == 0, e % 8 == 0).alias("false_positive"), F.when(e % 5 == 0, F.concat(F.lit("note "), e.cast("string"))).otherwise("").alias("notes"))
    return events.select(F.concat(F.lit("s"), (e % 60).cast("string")).alias("signal_id")).distinct(), reviews


def _transition_sql() -> str:
    step = 24 * H
    return f"""WITH b AS (SELECT min(epoch_us(ts)) AS lo FROM events), e AS (SELECT (epoch_us(ts) - lo) // {step} AS w, event_type || (user_id % 40) AS topic, user_id % 7 AS outlet, value, ts FROM events, b),
      m AS (SELECT w, topic, count(*) AS size, count(DISTINCT outlet) AS o, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS dur FROM e GROUP BY ALL),
      x AS (SELECT *, CASE WHEN dur = 0 THEN size ELSE size / dur END AS velocity, CASE WHEN o <= 2 AND dur < 6 THEN 0 WHEN o <= 5 THEN 1 ELSE 2 END AS stage_order FROM m),
      p AS (SELECT w, row_number() OVER (ORDER BY w) AS n FROM (SELECT DISTINCT w FROM x)), y AS (SELECT x.*, n FROM x JOIN p USING (w)),
      z AS (SELECT c.*, q.velocity AS p_velocity, q.stage_order AS p_order, EXISTS (SELECT 1 FROM y o WHERE o.topic = c.topic AND o.n < c.n) AS seen_before FROM y c LEFT JOIN y q ON q.topic = c.topic AND q.n = c.n - 1)
      SELECT w, topic, 'velocity_spike' AS signal_type, 'medium' AS severity FROM z WHERE velocity >= 3 * p_velocity
      UNION ALL SELECT w, topic, 'sustained_momentum', 'medium' FROM z WHERE velocity >= 2 AND p_velocity >= 2
      UNION ALL SELECT w, topic, 'stage_transition', CASE WHEN stage_order < p_order THEN 'info' ELSE 'low' END FROM z WHERE p_order <> stage_order
      UNION ALL SELECT w, topic, 'narrative_revival', 'medium' FROM z WHERE p_velocity IS NULL AND seen_before"""


@query("stage_transitions", _transition_sql())
def stage_transitions(spark, sf_dir):  # noqa: ANN001, ANN201
    e = windows.assign(_read(spark, sf_dir, "events"), "ts", "1d").withColumn("topic", F.concat("event_type", (F.col("user_id") % 40).cast("string")))
    m = e.groupBy("w", "topic").agg(F.count("*").alias("size"), F.size(F.collect_set(F.col("user_id") % 7)).alias("o"), hours(F.max("ts"), F.min("ts")).alias("dur"))
    m = m.withColumn("velocity", F.when(F.col("dur") == 0, F.col("size").cast("double")).otherwise(F.col("size") / F.when(F.col("dur") != 0, F.col("dur")))).withColumn("stage", metrics.stage(F.col("o"), F.lit(1), F.col("dur")))
    return signals.transitions(m)


# --- weak labels and feedback ----------------------------------------------------------------------------------------


def _votes_sql() -> str:
    likely, suspicious, organic = "'likely_coordinated'", "'suspicious'", "'organic'"
    votes = f"""
      SELECT cluster_id, 0 AS i, 'lf_coordination_ratio' AS name, CASE WHEN coordination_ratio > 5 THEN {likely} WHEN coordination_ratio > 2 THEN {suspicious} WHEN coordination_ratio < 1.2e0 THEN {organic} END AS label,
        CASE WHEN coordination_ratio > 5 THEN 1.5 WHEN coordination_ratio > 2 THEN 1.0 WHEN coordination_ratio < 1.2e0 THEN 0.8 END AS weight FROM signals
      UNION ALL SELECT cluster_id, 1, 'lf_duplicate_burst', CASE WHEN duplicate_burst_score > 0.7e0 THEN {likely} WHEN duplicate_burst_score > 0.5e0 THEN {suspicious} WHEN duplicate_burst_score < 0.1e0 THEN {organic} END,
        CASE WHEN duplicate_burst_score > 0.7e0 THEN 1.3 WHEN duplicate_burst_score > 0.5e0 THEN 1.0 WHEN duplicate_burst_score < 0.1e0 THEN 0.7 END FROM signals
      UNION ALL SELECT cluster_id, 2, 'lf_temporal_burst', CASE WHEN velocity_zscore > 4 AND semantic_coherence > 0.8e0 THEN {likely} WHEN burst_detected AND semantic_coherence > 0.7e0 THEN {suspicious} END,
        CASE WHEN velocity_zscore > 4 AND semantic_coherence > 0.8e0 THEN 1.2 WHEN burst_detected AND semantic_coherence > 0.7e0 THEN 0.9 END FROM signals
      UNION ALL SELECT cluster_id, 3, 'lf_coherence_diversity', CASE WHEN semantic_coherence > 0.85e0 AND coordination_ratio > 1.5e0 THEN {suspicious} END, 0.8 FROM signals
      UNION ALL SELECT cluster_id, 4, 'lf_small_cluster', CASE WHEN size < 10 AND coordination_ratio < 1.5e0 THEN {organic} END, 0.6 FROM signals
      UNION ALL SELECT cluster_id, 5, 'lf_large_diverse', CASE WHEN size > 50 AND coordination_ratio < 1.3e0 AND unique_authors > 40 THEN {organic} END, 1.0 FROM signals"""
    return f"""votes AS (SELECT * FROM ({votes}) WHERE label IS NOT NULL), t AS (SELECT cluster_id, sum(CAST(weight AS DOUBLE)) AS total, count(*) AS n, string_agg(name, ',' ORDER BY i) AS fired FROM votes GROUP BY 1),
      l AS (SELECT cluster_id, label, sum(CAST(weight AS DOUBLE)) AS w FROM votes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(w, 9) DESC, array_position(['organic','suspicious','likely_coordinated'], label)) AS rn FROM l),
      weak AS (SELECT s.cluster_id, CASE WHEN t.n IS NULL OR w / total < 0.4 THEN 'unknown' ELSE label END AS label, coalesce(w / total, 0e0) AS confidence, coalesce(fired, '') AS fired, CAST(coalesce(n, 0) AS INTEGER) AS n_fired
        FROM signals s LEFT JOIN t ON t.cluster_id = s.cluster_id LEFT JOIN r ON r.cluster_id = s.cluster_id AND rn = 1)"""


@query("weak_labels", f"WITH {SIGNALS_CTE}, {_votes_sql()} SELECT cluster_id, label, round(confidence, 6) AS confidence, fired, n_fired FROM weak")
def weak_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(labeling.weak_labels(cluster_signals(spark, sf_dir)).select("cluster_id", "label", "confidence", "fired", "n_fired"))


_KEYWORDS_CTE = """named AS (SELECT doc_id, [x for x in [CASE doc_id % 4 WHEN 0 THEN '$tk' || (doc_id % 7) WHEN 1 THEN source ELSE lang END, CASE WHEN doc_id % 5 <> 0 THEN (['buy','sell','hold','moon','squeeze','target','other'])[doc_id % 7 + 1] END, CASE WHEN doc_id % 3 = 0 THEN '$zz' END] if x IS NOT NULL] AS k FROM documents)"""


@query("narrative_labels", f"""WITH {_KEYWORDS_CTE}, t AS (SELECT doc_id, k, ([x for x in k if x[1] = '$'])[1] AS ticker, ([x for x in [CASE x WHEN 'buy' THEN 'Buy' WHEN 'sell' THEN 'Sell' WHEN 'hold' THEN 'Hold' WHEN 'moon' THEN 'Pump' WHEN 'squeeze' THEN 'Squeeze' WHEN 'target' THEN 'Target' END for x in k] if x IS NOT NULL])[1] AS action FROM named)
  SELECT doc_id, CASE WHEN len(k) < 2 THEN 'Unclassified Coordination Pattern' WHEN ticker IS NOT NULL THEN coalesce(action, 'Campaign') || ' Campaign for ' || upper(ticker)
    ELSE 'Coordinated ' || list_aggregate([upper(x[1]) || lower(x[2:]) for x in k[1:2]], 'string_agg', ' ') || ' Campaign' END AS label FROM t""")
def narrative_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    first = F.when(i % 4 == 0, F.concat(F.lit("$tk"), (i % 7).cast("string"))).when(i % 4 == 1, F.col("source")).otherwise(F.col("lang"))
    second = F.when(i % 5 != 0, pick(("buy", "sell", "hold", "moon", "squeeze", "target", "other"), i % 7))
    keywords = F.filter(F.array(first, second, F.when(i % 3 == 0, "$zz")), lambda k: k.isNotNull())
    return _read(spark, sf_dir, "documents").select("doc_id", keyword_label(keywords).alias("label"))


@query("high_confidence_labels", f"WITH {SIGNALS_CTE}, {_votes_sql()} SELECT cluster_id, label FROM weak WHERE label <> 'unknown' AND confidence >= 0.7")
def high_confidence_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return labeling.high_confidence(labeling.weak_labels(cluster_signals(spark, sf_dir))).select("cluster_id", "label")


@query("training_labels", f"""WITH {FEEDBACK_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY timestamp DESC, ord) AS rn FROM feedback)
  SELECT alert_id, CASE verdict WHEN 'confirmed' THEN 1 ELSE 0 END AS label, confidence FROM r WHERE rn = 1 AND verdict IN ('confirmed', 'false_positive')""")
def training_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return feedback.training_labels(feedback_rows(spark, sf_dir))


_rate = lambda c: f"coalesce(avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END), 0e0)"


@query("feedback_metrics", f"""WITH {FEEDBACK_CTE} SELECT count(*) AS total, round({_rate("verdict = 'confirmed'")}, 6) AS confirm_rate, round({_rate("verdict = 'false_positive'")}, 6) AS fp_rate, round({_rate("verdict IN ('needs_review', 'unsure')")}, 6) AS unsure_rate,
  round(coalesce(avg(confidence), 0e0), 6) AS avg_confidence, round(coalesce(avg(nullif(time_spent_seconds, 0)), 0e0), 6) AS avg_seconds FROM feedback WHERE timestamp >= TIMESTAMP '2024-01-08'""")
def feedback_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(feedback.metrics(feedback_rows(spark, sf_dir), F.expr("timestamp_ntz '2024-01-08 00:00:00'")))


@query("analyst_stats", f"WITH {FEEDBACK_CTE} SELECT analyst_id, count(*) AS total, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'false_positive') AS false_positive, count(*) FILTER (verdict NOT IN ('confirmed', 'false_positive')) AS unsure FROM feedback GROUP BY 1")
def analyst_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return feedback.analyst_stats(feedback_rows(spark, sf_dir))


@query("label_agreement", f"WITH {FEEDBACK_CTE} SELECT round(avg(CASE WHEN a.verdict = b.verdict THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM feedback a JOIN feedback b ON a.alert_id = b.alert_id AND a.ord < b.ord")
def label_agreement(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(feedback.agreement(feedback_rows(spark, sf_dir)))


_OPEN_CTE = f"{FEEDBACK_CTE}, {ALERTS_CTE}, open AS (SELECT *, coalesce(confidence, 0.5e0) AS model_confidence, 1 - abs(coalesce(confidence, 0.5e0) - 0.5e0) * 2 AS uncertainty_score FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM feedback))"
_PICKED = "alert_id, cluster_id, round(model_confidence, 6) AS model_confidence, round(uncertainty_score, 6) AS uncertainty_score, selection_reason"
_DIVERSE = "SELECT alert_id, cluster_id, model_confidence, uncertainty_score, 'diversity_' || severity AS selection_reason FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY ord) AS turn FROM {src} WHERE severity <> 'info') ORDER BY turn, array_position(['critical','high','medium','low'], severity) LIMIT {n}"


def _sampled(strategy: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        picked = feedback.select_for_labeling(alert_rows(spark, sf_dir), feedback_rows(spark, sf_dir), 25, strategy)
        return _rounded(picked.drop("ord"))

    return f


query("sample_uncertainty", f"WITH {_OPEN_CTE} SELECT {_PICKED} FROM (SELECT *, 'high_uncertainty' AS selection_reason FROM open ORDER BY uncertainty_score DESC, ord LIMIT 25)")(_sampled("uncertainty"))
query("sample_diversity", f"WITH {_OPEN_CTE} SELECT {_PICKED} FROM ({_DIVERSE.format(src='open', n=25)})")(_sampled("diversity"))
query("sample_mixed", f"""WITH {_OPEN_CTE}, u AS (SELECT *, 'high_uncertainty' AS selection_reason FROM open ORDER BY uncertainty_score DESC, ord LIMIT 12), rest AS (SELECT * FROM open WHERE alert_id NOT IN (SELECT alert_id FROM u)),
  d AS ({_DIVERSE.format(src='rest', n=13)}) SELECT {_PICKED} FROM (SELECT alert_id, cluster_id, model_confidence, uncertainty_score, selection_reason FROM u UNION ALL SELECT * FROM d)""")(_sampled("mixed"))


# --- splits ----------------------------------------------------------------------------------------------------------

D = 24 * H
_SPAN = f"b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi, (max(epoch_us(ts)) - min(epoch_us(ts))) // {D} AS days FROM events)"


@query("time_split_counts", f"""WITH {_SPAN}, c AS (SELECT lo + CAST(trunc(days * 0.6e0) AS BIGINT) * {D} AS train_end, days FROM b), d AS (SELECT train_end, train_end + {D} AS vs, train_end + {D} + CAST(trunc(days * 0.2e0) AS BIGINT) * {D} AS ve FROM c),
  s AS (SELECT ts, CASE WHEN epoch_us(ts) < train_end THEN 'train' WHEN epoch_us(ts) >= vs AND epoch_us(ts) < ve THEN 'val' WHEN epoch_us(ts) >= ve + {D} THEN 'test' END AS split FROM events, d)
  SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s WHERE split IS NOT NULL GROUP BY split""")
def time_split_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return splits.split_info(_read(spark, sf_dir, "events").select("event_id", "ts"))


def _folds_sql(folds: str) -> str:
    return f"""WITH {_SPAN}, f AS ({folds}), r AS (SELECT fold, CASE WHEN epoch_us(ts) >= lo AND epoch_us(ts) < te THEN 'train' WHEN epoch_us(ts) >= ss AND epoch_us(ts) < se THEN 'test' END AS role FROM f, events)
      SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY ALL"""


@query("walk_forward_folds", _folds_sql(f"SELECT i AS fold, lo, lo + (10 + 3 * i) * {D} AS te, lo + (11 + 3 * i) * {D} AS ss, lo + (15 + 3 * i) * {D} AS se FROM b, range(100) t(i) WHERE lo + (15 + 3 * i) * {D} <= hi"))
def walk_forward_folds(spark, sf_dir):  # noqa: ANN001, ANN201
    return splits.walk_forward(_read(spark, sf_dir, "events").select("event_id", "ts"), initial=10, test=4, step=3).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("expanding_folds", _folds_sql(f"SELECT i AS fold, lo, lo + (14 + i * (greatest(0, (days - 14) // 5))) * {D} AS te, lo + (15 + i * (greatest(0, (days - 14) // 5))) * {D} AS ss, least(hi, lo + (22 + i * (greatest(0, (days - 14) // 5))) * {D}) AS se FROM b, range(5) t(i)"))
def expanding_folds(spark, sf_dir):  # noqa: ANN001, ANN201
    return splits.expanding(_read(spark, sf_dir, "events").select("event_id", "ts")).groupBy("fold", "role").agg(F.count("*").alias("n"))


# --- evaluation ------------------------------------------------------------------------------------------------------


@query("precision_recall_at_k", f"""WITH {SCORED_CTE}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM scored), k AS (SELECT unnest([5, 10, 20, 50]) AS k)
  SELECT k, round((SELECT count(*) FROM r WHERE rn <= k AND truth) * 1e0 / k, 6) AS precision, round((SELECT count(*) FROM r WHERE rn <= k AND truth) * 1e0 / (SELECT count(*) FROM scored WHERE truth), 6) AS recall FROM k WHERE k <= (SELECT count(*) FROM scored)""")
def precision_recall_at_k(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(evaluation.at_k(scored_rows(spark, sf_dir), order=(F.desc("score"), F.col("doc_id"))))


@query("roc_auc", f"WITH {SCORED_CTE} SELECT round(avg(CASE WHEN p.score > q.score THEN 1e0 WHEN p.score = q.score THEN 0.5e0 ELSE 0e0 END), 6) AS roc_auc FROM (SELECT score FROM scored WHERE truth) p, (SELECT score FROM scored WHERE NOT truth) q")
def roc_auc(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(evaluation.roc_auc(scored_rows(spark, sf_dir)))


@query("average_precision", f"""WITH {SCORED_CTE} SELECT round(sum((SELECT count(*) FROM scored b WHERE b.truth AND b.score >= a.score) * 1e0 / (SELECT count(*) FROM scored b WHERE b.score >= a.score)) / count(*), 6) AS average_precision FROM scored a WHERE truth""")
def average_precision(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(evaluation.average_precision(scored_rows(spark, sf_dir)))


@query("confusion_at_median", f"""WITH {SCORED_CTE}, m AS (SELECT median(score) AS m FROM scored), c AS (SELECT count(*) FILTER (score >= m AND truth) AS tp, count(*) FILTER (score >= m AND NOT truth) AS fp, count(*) FILTER (score < m AND truth) AS fn, count(*) FILTER (score < m AND NOT truth) AS tn FROM scored, m)
  SELECT tp, fp, fn, tn, round((tp + tn) * 1e0 / (tp + fp + fn + tn), 6) AS accuracy, round(tp * 1e0 / (tp + fp), 6) AS precision, round(tp * 1e0 / (tp + fn), 6) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_at_median(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(evaluation.confusion_at_median(scored_rows(spark, sf_dir)))


@query("purity", "WITH a AS (SELECT vec_id % 11 - 1 AS cluster, lang AS truth FROM embeddings JOIN documents ON doc_id = vec_id), n AS (SELECT cluster, truth, count(*) AS n FROM a WHERE cluster >= 0 AND truth IS NOT NULL GROUP BY ALL), t AS (SELECT max(n) AS top, sum(n) AS s FROM n GROUP BY cluster) SELECT round(sum(top) * 1e0 / sum(s), 6) AS purity FROM t")
def purity(spark, sf_dir):  # noqa: ANN001, ANN201
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 11 - 1).alias("cluster"))
    return _rounded(evaluation.purity(e.join(_read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth")), "doc_id")))


@query("lead_time", f"""WITH {ALERTS_CTE}, p AS (SELECT user_id % 97 AS cluster_id, max(ts) AS peak_time FROM events WHERE event_type = 'purchase' GROUP BY 1), h AS (SELECT (epoch_us(peak_time) - epoch_us(alert_time)) / 3.6e9 AS h FROM alerts JOIN p USING (cluster_id))
  SELECT count(*) AS n, round(coalesce(avg(h), 0e0), 6) AS mean_hours, round(coalesce(median(h), 0e0), 6) AS median_hours FROM h WHERE h > 0""")
def lead_time(spark, sf_dir):  # noqa: ANN001, ANN201
    peaks = _read(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy((F.col("user_id") % 97).alias("cluster_id")).agg(F.max("ts").alias("peak_time"))
    return _rounded(evaluation.lead_times(alert_rows(spark, sf_dir), peaks))


@query("alert_ranking", f"WITH {ALERTS_CTE} SELECT alert_id, severity, round(coordination_ratio, 6) AS coordination_ratio FROM alerts ORDER BY array_position(['critical','high','medium','low','info'], severity), alerts.coordination_ratio DESC, ord LIMIT 50")
def alert_ranking(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(alert_rows(spark, sf_dir).orderBy(signals.severity_rank(F.col("severity")), F.desc("coordination_ratio"), "ord").limit(50).select("alert_id", "severity", "coordination_ratio"))


@query("cv_summary", f"WITH {FEEDBACK_CTE} SELECT analyst_id AS metric, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, min(confidence) AS least, max(confidence) AS greatest, count(*) AS n FROM feedback GROUP BY 1")
def cv_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(evaluation.summarize(feedback_rows(spark, sf_dir), "analyst_id", "confidence").withColumnRenamed("analyst_id", "metric"))


# --- drift -----------------------------------------------------------------------------------------------------------

_DIMS = lambda half: f"SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM cells WHERE vec_id % 2 = {half} GROUP BY dim"
_ED_CTE = f"""{CELLS_CTE}, base AS ({_DIMS(0)}), cur AS ({_DIMS(1)}), ed AS (SELECT sqrt(sum(power(c.mean - b.mean, 2))) AS mean_shift, abs(avg(power(c.std, 2)) - avg(power(b.std, 2))) / (avg(power(b.std, 2)) + 1e-6) AS variance_change,
  1 - sum(c.mean * b.mean) / (sqrt(sum(power(b.mean, 2))) * sqrt(sum(power(c.mean, 2))) + 1e-6) AS cosine_distance FROM base b JOIN cur c USING (dim))"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, sf_dir, "embeddings")
    return drift.dims(e.where("vec_id % 2 = 0")), drift.dims(e.where("vec_id % 2 = 1"))


@query("drift_embedding", f"WITH {_ED_CTE} SELECT round(mean_shift, 6) AS mean_shift, round(variance_change, 6) AS variance_change, round(cosine_distance, 6) AS cosine_distance FROM ed")
def drift_embedding(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(drift.embedding_drift(*_halves(spark, sf_dir)))


_TOPIC = lambda half: f"SELECT (user_id * 3 + event_id // 2500) % 23 - 1 AS topic, count(*) * 1e0 / (SELECT count(*) FROM events WHERE event_id % 2 = {half}) AS p FROM events WHERE event_id % 2 = {half} GROUP BY 1"
_JS_CTE = f"""pq AS (SELECT coalesce(a.p, 0e0) AS p, coalesce(b.p, 0e0) AS q FROM (SELECT * FROM ({_TOPIC(0)}) WHERE topic >= 0 AND topic <> 4) a FULL JOIN (SELECT * FROM ({_TOPIC(1)}) WHERE topic >= 0 AND topic NOT IN (5, 6)) b USING (topic)),
  n AS (SELECT (p + 1e-10) / (SELECT sum(p + 1e-10) FROM pq) AS a, (q + 1e-10) / (SELECT sum(q + 1e-10) FROM pq) AS b, p, q FROM pq),
  js AS (SELECT sqrt(sum(0.5e0 * a * ln(a / ((a + b) / 2)) + 0.5e0 * b * ln(b / ((a + b) / 2)))) AS js_distance, count(*) FILTER (p = 0 AND q > 0) * 1e0 / count(*) FILTER (q > 0) AS new_topics, count(*) FILTER (p > 0 AND q = 0) * 1e0 / count(*) FILTER (p > 0) AS gone_topics FROM n)"""


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("topic", (F.col("user_id") * 3 + F.floor(F.col("event_id") / 2500)) % 23 - 1)
    base, cur = (drift.topics(e.where(f"event_id % 2 = {i}"), "topic") for i in (0, 1))
    return drift.topic_drift(base.where("topic <> 4"), cur.where("topic not in (5, 6)"))


@query("drift_topic_js", f"WITH {_JS_CTE} SELECT round(js_distance, 6) AS js_distance, round(new_topics, 6) AS new_topics, round(gone_topics, 6) AS gone_topics FROM js")
def drift_topic_js(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(_topics(spark, sf_dir))


_VOL_CTE = f"""{_spine(str(D), str(D), 'hi - lo - 1')}, vc AS (SELECT w, count(event_id) AS n FROM win LEFT JOIN events ON epoch_us(ts) >= a AND epoch_us(ts) < z GROUP BY w),
  vb AS (SELECT avg(n) AS a, coalesce(nullif(stddev_pop(n), 0), 1) AS s FROM vc), vol AS (SELECT (420 - a) / (a + 1e-6) AS volume_change, (420 - a) / (s + 1e-6) AS volume_z FROM vb)"""


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.volume_drift(drift.volume_baseline(windows.counts(_read(spark, sf_dir, "events"), "ts", "1d", strict=True)), 420)


@query("drift_volume", f"WITH {_VOL_CTE} SELECT round(volume_change, 6) AS volume_change, round(volume_z, 6) AS volume_z FROM vol")
def drift_volume(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(_volume(spark, sf_dir))


_RD_CTE = f"""{SIGNALS_CTE}, rb AS (SELECT avg(coordination_ratio) AS a, coalesce(nullif(stddev_pop(coordination_ratio), 0), 0.5) AS s FROM signals WHERE size > 1 AND cluster_id % 2 = 0),
  rd AS (SELECT abs(avg(coordination_ratio) - any_value(a)) / (any_value(s) + 1e-6) AS ratio_change, avg(CASE WHEN coordination_ratio > a + 2 * s THEN 1e0 ELSE 0e0 END) AS alert_rate FROM signals, rb WHERE size > 1 AND cluster_id % 2 = 1)"""


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cluster_signals(spark, sf_dir)
    return drift.ratio_drift(drift.ratio_baseline(c.where("cluster_id % 2 = 0")), c.where("cluster_id % 2 = 1"))


@query("drift_coordination", f"WITH {_RD_CTE} SELECT round(ratio_change, 6) AS ratio_change, round(alert_rate, 6) AS alert_rate FROM rd")
def drift_coordination(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(_ratios(spark, sf_dir))


@query("drift_overall", f"""WITH {_ED_CTE}, {_JS_CTE}, {_VOL_CTE}, {_RD_CTE}, o AS (SELECT greatest(cosine_distance / 0.15e0, js_distance / 0.2e0, abs(volume_z) / 3e0, ratio_change / 0.5e0) AS score FROM ed, js, vol, rd)
  SELECT round(score, 6) AS score, CASE WHEN score >= 1.5 THEN 'high' WHEN score >= 1 THEN 'medium' WHEN score >= 0.7 THEN 'low' ELSE 'none' END AS severity FROM o""")
def drift_overall(spark, sf_dir):  # noqa: ANN001, ANN201
    m = drift.embedding_drift(*_halves(spark, sf_dir))
    for part in (_topics(spark, sf_dir), _volume(spark, sf_dir), _ratios(spark, sf_dir)):
        m = m.join(F.broadcast(part))  # one row each
    return _rounded(drift.overall(m).select("score", "severity"))


_HISTORY_CTE = "history AS (SELECT event_id AS seq, (['none','low','medium','high'])[user_id % 4 + 1] AS severity, 0.121e0 + (event_id % 5) / 100e0 AS cosine_distance, (event_id % 30) / 100e0 AS js_distance FROM events)"


@query("retrain_decision", f"""WITH {_HISTORY_CTE}, h AS (SELECT * FROM history ORDER BY seq DESC LIMIT 3), a AS (SELECT count(*) >= 3 AS enough, bool_and(severity IN ('medium', 'high')) AS a, bool_and(cosine_distance > 0.12) AS b, bool_and(js_distance > 0.16) AS c FROM h)
  SELECT enough AND (a OR b OR c) AS retrain, CASE WHEN NOT enough THEN 'Not enough data' WHEN a THEN 'consistent drift' WHEN b THEN 'embedding drift' WHEN c THEN 'topic drift' ELSE 'no drift' END AS reason FROM a""")
def retrain_decision(spark, sf_dir):  # noqa: ANN001, ANN201
    e, u = F.col("event_id"), F.col("user_id")
    h = _read(spark, sf_dir, "events").select(e.alias("seq"), pick(("none", "low", "medium", "high"), u % 4).alias("severity"), (F.lit(0.121) + (e % 5) / F.lit(100.0)).alias("cosine_distance"), ((e % 30) / F.lit(100.0)).alias("js_distance"))
    return drift.should_retrain(h)


@query("baseline_smoothing", f"WITH {CELLS_CTE}, base AS ({_DIMS(0)}), cur AS ({_DIMS(1)}) SELECT CAST(dim AS INTEGER) AS dim, round(0.9e0 * b.mean + 0.1e0 * c.mean, 6) AS mean, round(0.9e0 * b.std + 0.1e0 * c.std, 6) AS std FROM base b JOIN cur c USING (dim)")
def baseline_smoothing(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(drift.smooth(*_halves(spark, sf_dir)))


@query("first_cluster_membership", """WITH m AS (SELECT doc_id % 50 AS cluster_id, doc_id + 1 AS id FROM documents UNION ALL SELECT doc_id % 50, doc_id + 7 FROM documents)
  SELECT d.doc_id AS id, coalesce((SELECT arg_min(cluster_id, cluster_id) FROM m WHERE m.id = d.doc_id), -1) AS cluster_id FROM documents d""")
def first_cluster_membership(spark, sf_dir):  # noqa: ANN001, ANN201
    d = _read(spark, sf_dir, "documents").select("doc_id")
    number = F.col("doc_id") % 50
    members = d.select(number.alias("cluster_id"), number.alias("ord"), F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 7)).alias("id"))
    return drift.first_cluster(d.withColumnRenamed("doc_id", "id"), members)
