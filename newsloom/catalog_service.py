"""Further registered queries: lookups, replay over windows, the monitor's state, labelling by a generator, whole evaluations.

Importing this module adds them to the catalog's QUERIES and ORACLES.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog import _COHERENCE_CTE, _FIRED_CTE, _FLAGS, _PR, ALERTS_CTE, CELLS_CTE, METRICS_CTE, ORACLES, SIGNALS_CTE, H, _read, _rounded, _signals, alert_rows, cluster_signals, query, review_rows, scored_rows
from newsloom.operators import classifier, evaluation, generation, index, lookups, monitor, sketches, splits
from newsloom.operators.signals import with_reviews
from newsloom.plans import batch, replay
from newsloom.sources.articles import ARTICLES_SQL, from_tables, record_reviews
from newsloom.sources.scratch import folder
from newsloom.sources.store import Store
from newsloom.streaming import narratives
from newsloom.streaming.windows import table_stream

# --- lookups ---------------------------------------------------------------------------------------------------------


def _first_of(value: str, name: str) -> str:
    return f"""{name} AS (SELECT cluster_id, arg_min(v, (-n, first)) AS {name} FROM (SELECT cluster_id, {value} AS v, count(*) AS n, min((published_at, id)) AS first FROM articles WHERE length({value}) > 0 GROUP BY ALL) GROUP BY 1)"""


_TABLE_CTE = f"""{METRICS_CTE}, {_first_of('pattern_topic', 'topic')}, {_first_of('pattern_type', 'dominant')}, {_first_of('coordinated_frame', 'cframe')}, {_first_of('convergent_frame', 'vframe')},
  head AS (SELECT cluster_id, arg_min(title, (CASE WHEN {_FLAGS} THEN 0 ELSE 1 END, published_at, id)) AS headline, min(published_at) AS first_seen, max(published_at) AS last_seen FROM articles GROUP BY 1),
  tab AS (SELECT m.*, headline, first_seen, last_seen, topic, dominant AS dominant_pattern, coalesce(cframe, vframe) AS common_frame FROM metrics m JOIN head USING (cluster_id) LEFT JOIN topic USING (cluster_id)
    LEFT JOIN dominant USING (cluster_id) LEFT JOIN cframe USING (cluster_id) LEFT JOIN vframe USING (cluster_id))"""


@query("cluster_table", f"WITH {ARTICLES_SQL}, {_TABLE_CTE} SELECT cluster_id, size, headline, first_seen, last_seen, topic, dominant_pattern, common_frame, stage FROM tab")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.clusters(from_tables(spark, sf_dir)).select("cluster_id", "size", "headline", "first_seen", "last_seen", "topic", "dominant_pattern", "common_frame", "stage").orderBy(F.desc("size"), "first_seen")


@query("cluster_overview", f"WITH {ARTICLES_SQL}, {_TABLE_CTE} SELECT cluster_id, coalesce(topic, 'Unknown') AS topic, size, unique_outlets AS outlets, stage, round(velocity, 6) AS velocity, round(bias_spread, 6) AS bias_spread, round(duration_hours, 6) AS duration_hours FROM tab")
def cluster_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lookups.overview(batch.clusters(from_tables(spark, sf_dir))))


@query("cluster_detail", f"""WITH {ARTICLES_SQL}, {_TABLE_CTE} SELECT cluster_id, coalesce(topic, 'Unknown') AS topic, size, stage, id, outlet, outlet_type, outlet_bias, title,
  CASE WHEN microsecond(published_at) % 1000000 = 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f') END AS published_at, wire_source FROM articles JOIN tab USING (cluster_id) WHERE cluster_id = 3""")
def cluster_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = from_tables(spark, sf_dir)
    return lookups.cluster_articles(batch.clusters(a), a, 3)


@query("cluster_nearest_members", f"""WITH {CELLS_CTE}, c AS (SELECT list(value ORDER BY dim) AS c FROM (SELECT dim, avg(x) AS value FROM cells WHERE label = 3 GROUP BY dim)),
  s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], c.c) AS similarity FROM embeddings, c WHERE label = 3) SELECT id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, id LIMIT 20""")
def cluster_nearest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return _rounded(lookups.nearest_members(e, 3, key="label"))


_SIGNAL_CTE = f"{ARTICLES_SQL}, {_TABLE_CTE}, {_COHERENCE_CTE}, {_FIRED_CTE}, sig AS (SELECT *, 'sig_' || signal_type || '_' || substr(sha256(cluster_id || ':' || signal_type), 1, 8) AS signal_id, cluster_id % 3 = 0 AS reviewed FROM fired)"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, those of every third cluster reviewed."""
    return _signals(spark, sf_dir).withColumn("reviewed", F.col("cluster_id") % 3 == 0)


@query("signals_filtered", f"WITH {_SIGNAL_CTE} SELECT signal_id, cluster_id, signal_type, severity, reviewed FROM sig WHERE severity = 'high' AND signal_type = 'cross_spectrum' AND NOT reviewed")
def signals_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.find_signals(_reviewed(spark, sf_dir), "high", "cross_spectrum", False).select("signal_id", "cluster_id", "signal_type", "severity", "reviewed")


@query("signal_with_cluster", f"WITH {_SIGNAL_CTE} SELECT signal_id, s.cluster_id, signal_type, severity, reviewed, topic AS cluster_topic, size AS cluster_size, stage AS cluster_stage FROM sig s LEFT JOIN tab ON tab.cluster_id = s.cluster_id")
def signal_with_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.with_cluster(_reviewed(spark, sf_dir), batch.clusters(from_tables(spark, sf_dir)))


@query("signal_counters", f"WITH {_SIGNAL_CTE} SELECT count(*) FILTER (NOT reviewed) AS active, count(*) FILTER (severity IN ('high', 'critical')) AS urgent, count(*) FILTER (signal_type = 'cross_spectrum') AS cross_spectrum FROM sig")
def signal_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.counters(_reviewed(spark, sf_dir))


@query("signals_urgent", f"WITH {_SIGNAL_CTE} SELECT signal_id, severity FROM sig WHERE severity IN ('high', 'critical') ORDER BY signal_id LIMIT 5")
def signals_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.urgent(_reviewed(spark, sf_dir)).select("signal_id", "severity")


# --- replay ----------------------------------------------------------------------------------------------------------


def _replay_sql(result: str) -> str:
    """Windows of six hours whose clusters are the vectors' labels."""
    step = 6 * H
    keyed = METRICS_CTE.replace("FROM articles", "FROM placed").replace("cluster_id", "key")
    fired = _FIRED_CTE.replace("cluster_id", "key")
    story = METRICS_CTE.replace("FROM articles", "FROM placed WHERE length(pattern_topic) > 0").replace("cluster_id", "w, pattern_topic").replace("raw AS", "raw2 AS").replace("metrics AS", "x AS").replace("FROM raw)", "FROM raw2)")
    return f"""WITH {ARTICLES_SQL}, b AS (SELECT min(epoch_us(published_at)) AS lo FROM articles), placed AS (SELECT a.*, (epoch_us(published_at) - lo) // {step} AS w, ((epoch_us(published_at) - lo) // {step}) || ':' || cluster_id AS key, lo FROM articles a, b),
      {keyed}, coh AS (SELECT a.key, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS coherence FROM placed a JOIN placed b ON a.key = b.key AND a.id < b.id GROUP BY 1
        UNION ALL SELECT key, 1e0 FROM placed GROUP BY key HAVING count(*) = 1), {fired}, {story},
      y AS (SELECT *, pattern_topic AS topic, CASE stage WHEN 'nascent' THEN 0 WHEN 'emerging' THEN 1 WHEN 'spreading' THEN 2 ELSE 3 END AS so, dense_rank() OVER (ORDER BY w) AS n FROM x),
      z AS (SELECT c.*, q.velocity AS pv, q.so AS po, EXISTS (SELECT 1 FROM y o WHERE o.topic = c.topic AND o.n < c.n) AS seen FROM y c LEFT JOIN y q ON q.topic = c.topic AND q.n = c.n - 1),
      allsig AS (SELECT CAST(split_part(key, ':', 1) AS BIGINT) AS w, key AS name, signal_type, severity FROM fired
        UNION ALL SELECT w, topic, 'velocity_spike', 'medium' FROM z WHERE velocity >= 3 * pv
        UNION ALL SELECT w, topic, 'sustained_momentum', 'medium' FROM z WHERE velocity >= 2 AND pv >= 2
        UNION ALL SELECT w, topic, 'stage_transition', CASE WHEN so < po THEN 'info' ELSE 'low' END FROM z WHERE po <> so
        UNION ALL SELECT w, topic, 'narrative_revival', 'medium' FROM z WHERE pv IS NULL AND seen) {result}"""


@query("replay_signals", _replay_sql("SELECT w, name, signal_type, severity FROM allsig"))
def replay_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.found(replay.windowed(from_tables(spark, sf_dir), "6h", cluster="cluster_id"))


@query("replay_windows", _replay_sql(f"""SELECT p.w, make_timestamp(lo + p.w * {6 * H}) AS window_start, make_timestamp(lo + (p.w + 1) * {6 * H}) AS window_end, count(*) AS articles, count(DISTINCT cluster_id) AS clusters,
  (SELECT count(*) FROM allsig s WHERE s.w = p.w) AS signals FROM placed p GROUP BY p.w, lo"""))
def replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = replay.windowed(from_tables(spark, sf_dir), "6h", cluster="cluster_id")
    return replay.details(placed, replay.found(placed), "6h")


@query("stream_transitions", ORACLES["stage_transitions"])
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of stage_transitions, from a stream over the events: a row without a topic, two windows after the last event,
    closes the last window."""
    topic, outlet = F.concat("event_type", (F.col("user_id") % 40).cast("string")), F.col("user_id") % 7
    events = _read(spark, sf_dir, "events")
    span = events.agg(*(F.unix_micros(f(F.col("ts").cast("timestamp"))).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    out = folder(spark, "stream-transitions")
    if span.lo is None:
        return narratives.resolved(spark.createDataFrame([], narratives.COLUMNS), None)
    end = spark.range(1).select(F.timestamp_micros(F.lit(span.hi + 2 * 24 * H)).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("long").alias("user_id"))
    end.write.parquet(f"{out}/end")
    streams = [table_stream(spark, f"{sf_dir}/events.parquet", events.select("ts", "event_type", "user_id").schema), table_stream(spark, f"{out}/end", end.schema)]
    rows = [x.select(F.col("ts").cast("timestamp").alias("ts"), topic.alias("topic"), outlet.cast("long").alias("outlet")) for x in streams]
    query = narratives.follow(rows[0].unionByName(rows[1]), f"{out}/store", f"{out}/state", size="1d", start_us=span.lo)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return Store(spark, f"{out}/store").read("transitions")


@query("signal_review_store", ORACLES["signal_review_merge"])
def signal_review_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_review_merge from a store into which the reviews were merged in two parts, the later one first and twice."""
    signals_, reviews = review_rows(spark, sf_dir)
    at = folder(spark, "reviews")
    for part in (F.col("ord") % 2 == 1, F.col("ord") % 2 == 0, F.col("ord") % 2 == 1):
        record_reviews(reviews.where(part), at)
    return with_reviews(signals_, Store(spark, at).read("reviews"))


# --- the monitor -----------------------------------------------------------------------------------------------------

_OLD, _NEW = "id % 3 <> 0", "id % 3 = 0"  # what is past and what arrives; together they are the whole table



def _state_cte(old: str, ratios: str) -> str:
    return f"""old AS (SELECT * FROM articles WHERE {old}), new AS (SELECT * FROM articles WHERE {_NEW}), ob AS (SELECT min(epoch_us(published_at)) AS lo, max(epoch_us(published_at)) AS hi FROM old),
  ow AS (SELECT unnest(generate_series(0, (hi - lo - 1) // {6 * H})) AS w, lo FROM ob), oc AS (SELECT w, count(id) AS n FROM ow LEFT JOIN old ON (epoch_us(published_at) - lo) // {6 * H} = w GROUP BY w),
  state AS (SELECT avg(n) AS avg_volume, coalesce(nullif(stddev_pop(n), 0), 1e0) AS std_volume, (SELECT count(*) FROM old) AS n_documents, count(*) AS n_windows FROM oc),
  ratio AS (SELECT avg(coordination_ratio) AS avg_ratio, coalesce(nullif(stddev_pop(coordination_ratio), 0), 0.5e0) AS std_ratio FROM signals WHERE size > 1 AND {ratios}),
  now AS (SELECT avg(coordination_ratio) AS r FROM signals WHERE size > 1 AND cluster_id % 2 = 1)"""


def _monitored(spark: SparkSession, sf_dir: str) -> tuple[monitor.Baseline, DataFrame, DataFrame]:
    a = from_tables(spark, sf_dir).withColumnRenamed("published_at", "ts")
    c = cluster_signals(spark, sf_dir)
    return monitor.baseline(a.where(_OLD), c.where("cluster_id % 2 = 0"), "6h"), a.where(_NEW), c.where("cluster_id % 2 = 1")


@query("drift_baseline", f"WITH {ARTICLES_SQL}, {SIGNALS_CTE}, {_state_cte('true', 'true')} SELECT round(avg_volume, 6) AS avg_volume, round(std_volume, 6) AS std_volume, n_documents, n_windows, round(avg_ratio, 6) AS avg_ratio, round(std_ratio, 6) AS std_ratio FROM state, ratio")
def drift_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = monitor.baseline(from_tables(spark, sf_dir).withColumnRenamed("published_at", "ts"), cluster_signals(spark, sf_dir), "6h")
    return _rounded(base.volume.join(base.ratio))


@query("drift_baseline_updated", f"""WITH {ARTICLES_SQL}, {SIGNALS_CTE}, {_state_cte(_OLD, 'cluster_id % 2 = 0')} SELECT round(0.9e0 * avg_volume + 0.1e0 * (SELECT count(*) FROM new), 6) AS avg_volume, round(std_volume, 6) AS std_volume, n_documents + (SELECT count(*) FROM new) AS n_documents,
  n_windows + 1 AS n_windows, round(0.9e0 * avg_ratio + 0.1e0 * r, 6) AS avg_ratio, round(std_ratio, 6) AS std_ratio FROM state, ratio, now""")
def drift_baseline_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, docs, clusters = _monitored(spark, sf_dir)
    after = monitor.updated(base, docs, clusters)
    return _rounded(after.volume.join(after.ratio))


@query("current_topics", f"WITH {ARTICLES_SQL}, n AS (SELECT cluster_id AS topic, count(*) AS n FROM articles GROUP BY 1) SELECT topic, round(n * 1e0 / (SELECT sum(n) FROM n), 6) AS p FROM n")
def current_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = from_tables(spark, sf_dir)
    return _rounded(monitor.current_topics(a, _read(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("id"))))


@query("drift_trend", "SELECT event_id AS seq, value FROM events ORDER BY event_id DESC LIMIT 10")
def drift_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.recent(_read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value"))


# --- labelling by a generator, evaluation ----------------------------------------------------------------------------

_POSTS_CTE = """posts AS (SELECT cluster_id, string_agg('[Post ' || i || ']: ' || left(t, 300), chr(10) ORDER BY i) AS posts FROM (SELECT cluster_id, coalesce(title || chr(10) || body, '') AS t, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, id) AS i FROM articles) WHERE i <= 10 GROUP BY 1)"""


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = from_tables(spark, sf_dir).withColumn("text", F.concat("title", F.lit("\n"), "body"))
    return generation.excerpts(a, order=("published_at", "id"))


@query("cluster_excerpts", f"WITH {ARTICLES_SQL}, {_POSTS_CTE} SELECT cluster_id, posts FROM posts")
def cluster_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir)


def counting(prompt: str) -> str:
    """A stand-in for a model: it tells how many texts it was shown and how long they were, and refuses every odd length."""
    posts = prompt[prompt.index("[Post 1]") :]
    if len(posts) % 2:
        return "No."
    return "Here: " + json.dumps({"stance": "mixed" if posts.count("[Post ") > 5 else None, "emotions": {"anger": (len(posts) % 100) / 100}})


@query("cluster_stances", f"""WITH {ARTICLES_SQL}, {_POSTS_CTE}, p AS (SELECT cluster_id, length(posts) AS n, (length(posts) - length(replace(posts, '[Post ', ''))) / 6 AS shown FROM posts)
  SELECT cluster_id, CASE WHEN n % 2 = 0 AND shown > 5 THEN 'mixed' ELSE 'unknown' END AS stance, CASE WHEN n % 2 = 0 THEN (n % 100) / 100e0 END AS anger FROM p""")
def cluster_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.stance(_posts(spark, sf_dir), counting).select("cluster_id", "stance", F.col("emotions")["anger"].alias("anger"))


_AT_K = f"(SELECT {', '.join(f'max(CASE WHEN k = {k} THEN {c} END) AS {c}_at_{k}' for k in (5, 10, 20, 50) for c in ('precision', 'recall'))} FROM ({ORACLES['precision_recall_at_k']}))"


@query("classifier_evaluation", f"SELECT * FROM ({ORACLES['confusion_at_median'].replace('score >= m', 'score >= 0.5e0').replace('score < m', 'score < 0.5e0')}), ({ORACLES['roc_auc']}), ({ORACLES['average_precision']}), {_AT_K}")
def classifier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.evaluate_classifier(scored_rows(spark, sf_dir), F.col("score") >= 0.5, ties=(F.col("doc_id"),)))


@query("alert_evaluation", f"""SELECT * EXCLUDE (accuracy, n), n AS leads FROM ({ORACLES['confusion_at_median']}), ({ORACLES['roc_auc']}), ({ORACLES['average_precision']}), ({ORACLES['lead_time']}), (SELECT count(*) AS items FROM documents JOIN labels USING (doc_id)), {_AT_K}""")
def alert_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = _read(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy((F.col("user_id") % 97).alias("cluster_id")).agg(F.max("ts").alias("peak_time"))
    return _rounded(evaluation.evaluate_alerts(scored_rows(spark, sf_dir), alert_rows(spark, sf_dir), peaks, order=(F.desc("score"), F.col("doc_id"))))


@query("clustering_evaluation", f"""SELECT * FROM (SELECT count(DISTINCT label) AS n_clusters FROM embeddings), ({ORACLES['silhouette_cosine']}),
  (WITH n AS (SELECT label, vec_id % 5 AS truth, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT max(n) AS top, sum(n) AS s FROM n GROUP BY label) SELECT round(sum(top) * 1e0 / sum(s), 6) AS purity FROM t)""")
def clustering_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.evaluate_clustering(_read(spark, sf_dir, "embeddings").withColumn("truth", F.col("vec_id") % 5)))


@query("time_split_days", f"SELECT split, CAST((epoch_us(last_ts) - epoch_us(first_ts)) // {24 * H} AS BIGINT) AS days FROM ({ORACLES['time_split_counts']})")
def time_split_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.durations(_read(spark, sf_dir, "events").select("event_id", "ts"))


@query("walk_forward_clusters", f"""WITH c AS (SELECT user_id * 400 + dayofyear(ts) AS cluster_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1), b AS (SELECT min(epoch_us(s)) AS lo, arg_max(epoch_us(e), epoch_us(s)) AS hi FROM c),
  f AS (SELECT i AS fold, lo + (10 + 3 * i) * {24 * H} AS te, lo + (11 + 3 * i) * {24 * H} AS ss, lo + (15 + 3 * i) * {24 * H} AS se FROM b, range(100) t(i) WHERE lo + (15 + 3 * i) * {24 * H} <= hi),
  r AS (SELECT fold, CASE WHEN epoch_us(e) < te THEN 'train' WHEN epoch_us(s) >= ss AND epoch_us(s) < se THEN 'test' END AS role FROM f, c), g AS (SELECT fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY ALL)
  SELECT CAST(fold AS INTEGER) AS fold, role, n FROM g WHERE fold IN (SELECT fold FROM g GROUP BY fold HAVING count(*) = 2)""")
def walk_forward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _intervals(spark, sf_dir)
    return splits.walk_forward(c, "s", initial=10, test=4, step=3, end="e").groupBy("fold", "role").agg(F.count("*").alias("n"))


_INTERVALS_SQL = "c AS (SELECT user_id * 400 + dayofyear(ts) AS cluster_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1)"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their first and last time: a user's events of a day."""
    return _read(spark, sf_dir, "events").groupBy((F.col("user_id") * 400 + F.dayofyear("ts")).alias("cluster_id")).agg(F.min("ts").alias("s"), F.max("ts").alias("e"))


@query("cluster_time_split", f"""WITH {_INTERVALS_SQL}, b AS (SELECT min(epoch_us(s)) AS lo, arg_max(epoch_us(e), epoch_us(s)) AS hi FROM c), d AS (SELECT lo, (hi - lo) // {24 * H} AS days FROM b),
  x AS (SELECT lo + CAST(floor(days * 0.6e0) AS BIGINT) * {24 * H} AS te, lo + (CAST(floor(days * 0.6e0) AS BIGINT) + 1) * {24 * H} AS vs, lo + (CAST(floor(days * 0.6e0) AS BIGINT) + 1 + CAST(floor(days * 0.2e0) AS BIGINT)) * {24 * H} AS ve FROM d),
  r AS (SELECT cluster_id, CASE WHEN epoch_us(e) < te THEN 'train' WHEN epoch_us(s) >= vs AND epoch_us(s) < ve THEN 'val' WHEN epoch_us(s) >= ve + {24 * H} THEN 'test' END AS split FROM c, x) SELECT cluster_id, split FROM r WHERE split IS NOT NULL""")
def cluster_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_split(_intervals(spark, sf_dir), "s", end="e").select("cluster_id", "split")


@query("classifier_features", f"WITH {SIGNALS_CTE} SELECT cluster_id, {', '.join(f'round(CAST({sql.replace("coalesce(has_body_ratio, 0.5e0)", "0.5e0")} AS DOUBLE), 6) AS f_{name}' for name, sql in classifier.FEATURES)} FROM signals")
def classifier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(classifier.features(cluster_signals(spark, sf_dir)))


@query("index_topk", ORACLES["cosine_topk"])
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cosine_topk from an inverted file over all embeddings, all of whose lists are probed."""
    v = _read(spark, sf_dir, "embeddings")
    at, asked = folder(spark, "index"), v.where("vec_id = 7").first()
    index.build(v, at)
    return _rounded(index.search(spark, at, asked.embedding if asked else [], 20, None))


# --- sketches --------------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).select("cluster_id", "published_at", "id", F.posexplode("keywords").alias("place", "keyword"))


@query("keyword_topn_sketch", ORACLES["keyword_topn"])
def keyword_topn_sketch(spark, sf_dir):  # noqa: ANN001, ANN201
    found = sketches.frequent(_words(spark, sf_dir), "keyword", ("cluster_id",), ties=("published_at", "id", "place"))
    return found.select("cluster_id", "rank", F.col("value").alias("keyword"), "n")


@query("keyword_topn_windows", f"""WITH {ARTICLES_SQL}, k AS (SELECT epoch_us(published_at) AS us, unnest(keywords) AS keyword FROM articles), l AS (SELECT us - (SELECT min(us) FROM k WHERE keyword IS NOT NULL) AS t, keyword FROM k),
  w AS (SELECT unnest(range(greatest(t // {H} - 5, 0), t // {H} + 1)) AS w, keyword FROM l WHERE keyword IS NOT NULL), c AS (SELECT w, keyword, count(*) AS n FROM w GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, keyword) AS rank FROM c) SELECT w, CAST(rank AS INTEGER) AS rank, keyword, n FROM r WHERE rank <= 10""")
def keyword_topn_windows(spark, sf_dir):  # noqa: ANN001, ANN201
    return sketches.frequent(_words(spark, sf_dir), "keyword", ts="published_at", size="6h", step="1h").select("w", "rank", F.col("value").alias("keyword"), "n")
