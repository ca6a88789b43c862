"""Windows over a stream of events: watermarked counts, written as they become final."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from newsloom.functions.time_windows import parse_window


def counts(stream: DataFrame, key: str, ts: str = "ts", size: str = "4h", step: str | None = None, late: str = "1h") -> DataFrame:
    """(window_start, window_end, key, n) of a stream or a table, windows aligned to the epoch; events later than ``late`` behind
    the newest are dropped by the watermark, so state is bounded by the open windows and their keys."""
    length = lambda text: f"{parse_window(text) // 1000} milliseconds"
    window = F.window(ts, length(size), length(step or size))
    per = stream.withWatermark(ts, length(late)).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def append(counted: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write windows once they are final, as Parquet; what has arrived is processed and the query ends. A restart goes on from
    the checkpoint, which executors and driver must share."""
    return counted.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A Parquet table as a stream, ``files`` of its files in a batch at most. A table that is one file is read by its name in the
    folder above, as file streams take folders only."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).isFile(jvm_path)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", jvm_path.getName()).parquet(str(jvm_path.getParent())) if single else reader.parquet(path)
