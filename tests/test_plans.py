"""Batch runs, streams, CSV validation, the feedback store."""

import json
from collections import Counter

import pytest

from newsloom.operators import labeling, signals
from newsloom.plans import batch
from newsloom.settings import Settings
from newsloom.sources import articles
from newsloom.streaming import windows
from oracle import SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def test_batch_run(spark, tmp_path):
    rows = articles.from_tables(spark, SMALL)
    out = str(tmp_path / "out")
    summary = batch.run(rows, out)
    members = {r.id: r.cluster_id for r in spark.read.parquet(f"{out}/members").collect()}
    assert summary["total_articles"] == rows.count() == len(members)
    assert summary["noise_articles"] == sum(c < 0 for c in members.values())
    sizes = Counter(c for c in members.values() if c >= 0)
    written = {r.cluster_id: r for r in spark.read.json(f"{out}/clusters").collect()}
    assert {i: r["size"] for i, r in written.items()} == dict(sizes)
    found = [json.loads(line) for part in (tmp_path / "out" / "signals").glob("part-*") for line in part.read_text().splitlines()]
    assert len(found) == summary["total_signals"] > 0
    for s in found:
        assert s["metrics"]["cluster_size"] == sizes[s["cluster_id"]]
        assert s["id"].startswith(f"sig_{s['signal_type']}_") and s["title"] and not s["reviewed"]


def test_stream_agrees_with_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartitionByRange(3, "ts").write.parquet(given)
    for _ in range(2):  # a restart adds nothing twice
        windows.append(windows.counts(spark.readStream.schema(events.schema).parquet(given), "event_type", late="4w"), out, str(tmp_path / "state")).awaitTermination(120)
    key = lambda r: (r.window_start, r.event_type)
    whole = {key(r): r.n for r in windows.counts(events, "event_type").collect()}
    final = [(key(r), r.n) for r in spark.read.parquet(out).collect()]
    assert len(final) == len(dict(final))
    assert all(whole[k] == n for k, n in final)


CSV = """id,outlet,outlet_type,outlet_bias,title,body,author,url,section,published_at,wire_source,pattern_type,pattern_topic,keywords,pr_source,convergent_frame,coordinated_frame
1,A,independent,left,One,"two
lines",NA,null,x,2024-01-01T00:00:00,AP,wire_echo,t,"['a', 'b']",,n/a,
2,A,nowhere,left,Two,,,,,2024-01-01T00:00:00,AP,,,,,,
3,A,independent,left,,,,,,2024-01-01T00:00:00,AP,,,,,,
4,A,independent,left,Four,,,,,not a time,AP,,,,,,
5,B,independent,right,Five,,,,,2024-01-01T02:00:00+02:00,Nobody,odd,,broken,,,
"""


def test_csv_rows_are_validated_and_rejected_with_a_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    good, bad = articles.validate(articles.read_raw(spark, str(tmp_path / "a.csv")))
    kept = {r.id: r for r in good.collect()}
    assert set(kept) == {"1", "5"}
    assert (kept["1"].author, kept["1"].url, kept["1"].convergent_frame, kept["1"].keywords) == (None, None, None, ["a", "b"])
    assert kept["1"].body == "two\nlines"
    assert (kept["5"].wire_source, kept["5"].pattern_type, kept["5"].keywords) == ("Unknown", None, [])
    assert str(kept["5"].published_at) == "2024-01-01 00:00:00"
    assert {r.id: r.reason for r in bad.collect()} == {"2": "outlet_type", "3": "missing", "4": "published_at"}
    assert articles.read_raw(spark, str(tmp_path / "a.csv"), 2).count() == 2


def test_chunks_are_dense(spark, tmp_path):
    head, row = CSV.splitlines()[0], "A,independent,left,T,,,,,2024-01-01T00:00:00,AP,,,,,,"
    for part in range(3):
        (tmp_path / f"{part}.csv").write_text("\n".join([head, *(f"{part * 100 + i},{row}" for i in range(25))]) + "\n")
    sizes = Counter(r.chunk for r in articles.chunks(spark, str(tmp_path), 10).collect())
    assert sizes == {**dict.fromkeys(range(7), 10), 7: 5}


def test_feedback_store(spark, tmp_path):
    at = str(tmp_path / "feedback")
    assert articles.read_feedback(spark, at).count() == 0
    row = spark.createDataFrame([("a1", "x", None, "confirmed", 0.5, "", 3)], articles.read_feedback(spark, at).schema)
    articles.append_feedback(row, at)
    articles.append_feedback(row, at)
    assert articles.read_feedback(spark, at).count() == 2
    articles.clear_feedback(spark, at)
    assert articles.read_feedback(spark, at).count() == 0


def test_labels_by_hand(spark):
    """(ratio, duplicates, z, burst, coherence, size, authors) to label, confidence and functions, worked out by hand."""
    given = [
        (6.0, 0.8, 5.0, True, 0.9, 20, 5, "likely_coordinated", 4.0 / 4.8, "lf_coordination_ratio,lf_duplicate_burst,lf_temporal_burst,lf_coherence_diversity"),
        (1.0, 0.05, 0.0, False, 0.2, 60, 50, "organic", 1.0, "lf_coordination_ratio,lf_duplicate_burst,lf_large_diverse"),
        (1.4, 0.3, 0.0, False, 0.2, 20, 5, "unknown", 0.0, ""),
        (3.0, 0.05, 0.0, False, 0.2, 20, 5, "suspicious", 1.0 / 1.7, "lf_coordination_ratio,lf_duplicate_burst"),
    ]
    rows = spark.createDataFrame([(i, *g[:7]) for i, g in enumerate(given)], "cluster_id int, coordination_ratio double, duplicate_burst_score double, velocity_zscore double, burst_detected boolean, semantic_coherence double, size int, unique_authors int")
    out = {r.cluster_id: r for r in labeling.weak_labels(rows).collect()}
    for i, g in enumerate(given):
        assert (out[i].label, out[i].fired) == (g[7], g[9])
        assert abs(out[i].confidence - g[8]) < 1e-9


def test_a_stream_of_csv_files_agrees_with_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, part in enumerate((CSV, CSV.replace("\n5,B", "\n6,B"), CSV.splitlines()[0] + "\n")):
        (tmp_path / "in" / f"{i}.csv").write_text(part)
    good, bad = articles.stream(spark, str(tmp_path / "in"))
    for name, df in (("good", good), ("bad", bad)):
        query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2  # one file a batch
    want = articles.validate(articles.read_raw(spark, str(tmp_path / "in")))
    for name, whole in zip(("good", "bad"), want, strict=True):
        rows = lambda df: sorted(map(repr, df.drop("ord").collect()))
        assert rows(spark.read.parquet(str(tmp_path / name))) == rows(whole) and whole.count() > 0


def test_the_default_data_set(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    spark.conf.set("spark.newsloom.articles", str(tmp_path / "a.csv"))
    try:
        assert articles.load_default(spark).count() == 2
        spark.conf.set("spark.newsloom.articles", str(tmp_path / "b.csv"))
        with pytest.raises(AnalysisException):
            articles.load_default(spark)
    finally:
        spark.conf.unset("spark.newsloom.articles")


def test_a_report_is_published_whole_or_not_at_all(spark, tmp_path):
    good = {"summary": spark.range(1), "signals": spark.range(3)}
    articles.write_report(good, str(tmp_path), "run1")
    assert spark.read.json(str(tmp_path / "run1" / "signals")).count() == 3
    with pytest.raises(Exception, match="lost"):
        articles.write_report(good | {"bad": spark.range(1).selectExpr("raise_error('lost') as x")}, str(tmp_path), "run2")
    with pytest.raises(FileExistsError):
        articles.write_report(good, str(tmp_path), "run1")
    assert [p.name for p in tmp_path.iterdir()] == ["run1"]


def test_settings_of_a_session(spark):
    assert Settings.of(spark) == Settings()
    changed = {"bias_spread": "0.9", "min_samples": "5", "time_window": "1d", "unknown": "x"}
    try:
        for name, value in changed.items():
            spark.conf.set(f"spark.newsloom.{name}", value)
        s = Settings.of(spark)
        assert (s.bias_spread, s.min_samples, s.time_window) == (0.9, 5, "1d")
        assert "bias_spread >= 0.9e0" in signals.rules(s)[1][1]
        spark.conf.set("spark.newsloom.min_samples", "many")
        with pytest.raises(ValueError, match="many"):
            Settings.of(spark)
    finally:
        for name in changed:
            spark.conf.unset(f"spark.newsloom.{name}")
