"""Transitions on a stream against the same over the table: several files, late rows, restarts, crashes."""

import pytest
from newsloom import catalog
from newsloom.operators import signals
from newsloom.sources.store import Store
from newsloom.streaming import narratives
from oracle import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "ts timestamp, topic string, outlet long"
DAY = 86_400_000_000


def events(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("topic"), (F.col("user_id") % 7).alias("outlet"))


def rows(df):
    return sorted((r.w, r.topic, r.signal_type, r.severity) for r in df.collect())


def add(spark, at, name, df):
    """One file more for the stream, as a file source needs it: at once and complete."""
    df.coalesce(1).write.parquet(f"{at}/{name}")


def read(spark, at):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


def follow(spark, at, tmp_path, start, **more):
    query = narratives.follow(read(spark, at), str(tmp_path / "out"), str(tmp_path / "state"), size="1d", start_us=start, **more)
    query.awaitTermination(300)
    assert query.exception() is None
    return Store(spark, str(tmp_path / "out"))


@pytest.fixture
def table(spark, tmp_path):
    e = events(spark).cache()
    start = e.agg(F.min(F.unix_micros("ts"))).first()[0]
    at = str(tmp_path / "in")
    # three files in the order of time, but for some rows of the first third that come with the last
    third = F.ntile(3).over(narratives.Window.orderBy("ts"))
    parted = e.withColumn("third", third).withColumn("file", F.when((F.col("third") == 1) & (F.pmod(F.xxhash64("ts"), F.lit(7)) == 0), 3).otherwise(F.col("third"))).cache()
    assert parted.where("third = 1 and file = 3").count() > 20
    for i in (1, 2, 3):
        add(spark, at, f"f{i}", parted.where(F.col("file") == i).drop("third", "file"))
    return e, start, at


def beat(spark, at, name, us):
    """A row without a topic, which only moves the watermark."""
    add(spark, at, name, spark.range(1).select(F.timestamp_micros(F.lit(us)).alias("ts"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("long").alias("outlet")))


def test_a_stream_of_files_agrees_with_the_table(spark, tmp_path, table):
    e, start, at = table
    end = e.agg(F.max(F.unix_micros("ts"))).first()[0]
    store = follow(spark, at, tmp_path, start, late="30d")
    beat(spark, at, "g1", end + 40 * DAY)
    store = follow(spark, at, tmp_path, start, late="30d")  # a restart, which takes up the state
    want = rows(catalog.QUERIES["stage_transitions"](spark, SMALL))
    assert rows(store.read("transitions")) == want and want
    versions = store.versions()
    follow(spark, at, tmp_path, start, late="30d")  # another adds nothing
    assert store.versions() == versions and rows(store.read("transitions")) == want


def test_late_rows_are_dropped(spark, tmp_path, table):
    """Spark judges a batch's rows by the watermark that the batch before it ran with, so rows are late a batch later."""
    e, start, at = table
    end = e.agg(F.max(F.unix_micros("ts"))).first()[0]
    beat(spark, at, "g1", end + 3 * DAY)
    got = rows(follow(spark, at, tmp_path, start, late="1h").read("transitions"))
    assert got != rows(catalog.QUERIES["stage_transitions"](spark, SMALL)) and got


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path, monkeypatch):
    columns = "w long, topic string, velocity double, stage_order int, p_w long, p_velocity double, p_order int"
    one = spark.createDataFrame([(0, "a", 1.0, 0, None, None, None), (0, "b", 1.0, 0, None, None, None)], columns)
    two = spark.createDataFrame([(2, "a", 9.0, 1, 0, 1.0, 0), (5, "b", 9.0, 1, 0, 1.0, 0)], columns)
    out = str(tmp_path)
    write = narratives.sink(out)
    write(one, 0)
    write(one.limit(0), 1)
    with monkeypatch.context() as m:  # all is written, but the crash comes before it is published
        m.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            write(two, 2)
    assert rows(Store(spark, out).read("transitions")) == []
    for _ in range(2):
        write(two, 2)
    # between windows 0 and 5 something happened in 2, so b has returned, and a goes on
    assert rows(Store(spark, out).read("transitions")) == [(2, "a", "stage_transition", "low"), (2, "a", "velocity_spike", "medium"), (5, "b", "narrative_revival", "medium")]
    assert [r.w for r in Store(spark, out).read("transitions_state").collect()] == [5]
    write(two.selectExpr("w + 5 AS w", "topic", "velocity", "stage_order", "w AS p_w", "velocity AS p_velocity", "stage_order AS p_order").where("topic = 'b'"), 3)
    assert (10, "b", "sustained_momentum", "medium") in rows(Store(spark, out).read("transitions"))


def test_narratives_are_forgotten(spark, tmp_path):
    at = str(tmp_path / "in")
    day = lambda d: f"2024-01-{d:02d} 01:00:00"
    given = [[(1, "a"), (1, "b")], [(3, "b")], [(8, "c")], [(12, "a"), (12, "b")], [(13, "c")], [(20, None)]]
    for i, part in enumerate(given):
        add(spark, at, f"f{i}", spark.createDataFrame([(day(d), t, 1) for d, t in part], "ts string, topic string, outlet long").withColumn("ts", F.col("ts").cast("timestamp")))
    got = rows(follow(spark, at, tmp_path, 0, late="1h", forget="6d").read("transitions"))
    origin = 19723  # 2024-01-01
    revived = [r for r in got if r[2] == "narrative_revival"]
    assert [(w - origin, t) for w, t, *_ in revived] == [(12, "c")]  # a and b stayed away too long
    kept = rows(follow(spark, at, tmp_path / "other", 0, late="1h").read("transitions"))
    assert [(w - origin, t) for w, t, s, _ in kept if s == "narrative_revival"] == [(11, "a"), (11, "b"), (12, "c")]


def test_metrics_of_a_table_are_those_of_the_stream(spark):
    e = events(spark).withColumn("kind", F.col("outlet").cast("string"))
    start = e.agg(F.min(F.unix_micros("ts"))).first()[0]
    told = narratives.window_metrics(e, size="1d", start_us=start, kind="kind")
    plain = e.withColumn("w", F.floor((F.unix_micros("ts") - start) / DAY)).groupBy("w", "topic").agg(F.count("*").alias("size"), F.count_distinct("outlet").alias("o"), F.count_distinct("kind").alias("d"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("h"))
    from newsloom.operators.metrics import stage

    want = {(r.w, r.topic): (r.size_, r.stage) for r in plain.select("w", "topic", F.col("size").alias("size_"), stage(F.col("o"), F.col("d"), F.col("h")).alias("stage")).collect()}
    assert {(r.w, r.topic): (r["size"], r.stage) for r in told.collect()} == want
    assert isinstance(told.schema["ends"].dataType, T.TimestampType)
    assert signals.TRANSITIONS[3][0] == "narrative_revival"
