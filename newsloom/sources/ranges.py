"""CSV whose records may span lines, read by byte ranges: one large file is many tasks.

A record ends at a line break with an even number of quotes before it in its file. A first pass counts the quotes of each range;
their running parity tells a range whether it begins inside a record. A second pass finds the pieces of records that cross a border, two of
a range at most, and brings them together. The rows are a third pass: lines become records within each range, in the order in
which they are read. No pass shuffles the text; what the first two find is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.scratch import written

#: Ranges of one read. Their table (path, place and state, up to about 200 bytes each) is broadcast: a shuffle would lose the order of lines.
MAX_RANGES = 1_000_000
#: Bits of ``ord`` for a record's line within its range; the bits above number the ranges.
LINE_BITS = 33
_OPTIONS = {"escape": '"', "multiLine": "true"}
_PIECES = "ord long, piece int, text string"
# Values of ``piece``: a record of its own, the beginning of one that goes on in the next range, and what goes on from the range before.
_WHOLE, _BEGINS, _GOES_ON = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"),
        F.regexp_count("value", F.lit('"')).alias("quotes"),
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """(path, start, number, inside): every range that holds the beginning of a line, and whether a quote is open there. The
    windows order a row for each range."""
    each = lines.groupBy("path", "start").agg(F.sum("quotes").alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return each.select("path", "start", F.row_number().over(Window.orderBy("path", "start")).alias("number"), (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines in the order of reading -> records and pieces of records. What is kept between lines is one record."""
    number, at, odd, held, first, kind = None, 0, 0, [], 0, _WHOLE

    def told(piece: int) -> tuple[int, int, str]:
        return (number << LINE_BITS) + first, piece, "\n".join(held)

    for batch in batches:
        out = []
        for place, inside, quotes, line in zip(batch["number"].tolist(), batch["inside"].tolist(), batch["quotes"].tolist(), batch["line"], strict=True):
            if place != number:
                if held:
                    out.append(told(kind or _BEGINS))
                number, at, odd, held = place, 0, int(inside), []
                kind = _GOES_ON if inside else _WHOLE
            if not held:
                first = at
            held.append(line)
            at += 1
            odd = (odd + quotes) % 2
            if not odd:
                out.append(told(kind))
                held, kind = [], _WHOLE
        yield pd.DataFrame(out, columns=["ord", "piece", "text"])
    if held:
        yield pd.DataFrame([told(kind or _BEGINS)], columns=["ord", "piece", "text"])


def _joined(cut: DataFrame) -> DataFrame:
    """(ord, text) of records whose pieces lie in several ranges. A range has two such pieces at most; they are numbered in the
    window of one task, without their texts."""
    record = F.sum((F.col("piece") == _BEGINS).cast("long")).over(Window.orderBy("ord"))
    named = cut.select("ord", "piece").select("ord", record.alias("record"))
    whole = cut.join(named, "ord").groupBy("record").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return whole.select(F.col("p")[0]["ord"].alias("ord"), F.array_join(F.col("p")["text"], "\n").alias("text"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, head, text): the records of a CSV file or folder in the order of ``ord``; ``head`` marks the first of each file.
    Blank lines outside quotes are no records; a quote that is never closed makes the rest of its file one record."""
    lines = _lines(spark, path)
    ranges = written(_ranges(lines), "csv-ranges")
    n = ranges.count()
    if n > MAX_RANGES:
        raise ValueError(f"{n} ranges are more than {MAX_RANGES}: read parts of the folder, or raise spark.sql.files.maxPartitionBytes")
    pieces = lines.join(F.broadcast(ranges), ["path", "start"]).select("number", "inside", "quotes", "line").mapInPandas(_pieces, _PIECES)
    cut = written(pieces.where(F.col("piece") != _WHOLE), "csv-pieces")
    found = pieces.where(F.col("piece") == _WHOLE).select("ord", "text").unionByName(_joined(cut))
    firsts = ranges.groupBy("path").agg(F.min("number").cast("long").alias("n")).select(F.shiftleft("n", LINE_BITS).alias("ord"), F.lit(True).alias("head"))
    named = found.join(F.broadcast(firsts), "ord", "left").withColumn("head", F.coalesce("head", F.lit(False)))
    return named.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where(F.col("head") | (F.col("text") != ""))


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a CSV file or folder with headers, as the columns of ``schema``, all text, and ``ord``, their order of reading.
    Row by row what Spark's reader gives for records over several lines, as long as quotes stand around whole cells and double
    within them; but a carriage return within a cell stays, where that reader drops those of files whose lines end so. Cells that a row lacks are null, further ones are left out; a header of other names raises an error. Files
    without rows give none; a path that isn't there raises AnalysisException."""
    names = F.struct(*(F.lit(f.name).alias(f.name) for f in schema))
    row = lambda text: F.from_csv(text, F.lit(", ".join(f"`{f.name}` string" for f in schema)), _OPTIONS)
    bare = row(F.ltrim("text", F.lit("\ufeff")))  # a byte order mark
    is_head = F.when(F.col("head"), F.when(bare == names, True).otherwise(F.raise_error(F.concat(F.lit("unknown header: "), F.col("text"))).cast("boolean"))).otherwise(False)
    return records(spark, path).where(~is_head).select(row(F.col("text")).alias("row"), "ord").select("row.*", "ord")
