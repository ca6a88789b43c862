"""What the operators of this subpackage share: words, uniform numbers, written intermediates, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\u000b\u000c\r"
#: A side of a join is broadcast up to so many rows of a few numbers each (about 5 MB); beyond, it is shuffled with salt.
BROADCAST_ROWS = 100_000
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than BLANKS, as an array; null has none."""
    bare = F.btrim(filled(text), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+"))


def id_text(doc_id: Column) -> Column:
    """A document id as text; null gives the empty text."""
    return filled(doc_id.cast("string"))


def uniform(*cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the values alone, so reruns and retries agree."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's lambdas read it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(values: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each place of an array the fold of all before it; op must be associative. The array is folded in chunks of the root of
    its length, so n values take n ** 1.5 steps at most, where appending to one array would take n ** 2."""

    def fold(chunk: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(chunk, state, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def whole(v: Column) -> Column:
        k = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda c: F.slice(v, c * k + 1, k))
        starts = lambda cs: fold(F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, b: op(a, b))), zero)
        return let(chunks, lambda cs: let(starts(cs), lambda at: F.flatten(F.zip_with(cs, at, fold))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast(f"array<{kind}>")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where a local master has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stashed_at = path
    return read


def discard(*stashed: DataFrame) -> None:
    """Delete what stash() wrote, once nothing that is still to be computed reads it."""
    for df in stashed:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_small(df: DataFrame, dim: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join a dimension of a counted number of rows: broadcast up to BROADCAST_ROWS, else shuffled with each row of dim
    repeated over SALTS so that a hot key is dealt to as many tasks."""
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(dim), on, how)
    salt = "__salt"
    spread = dim.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn(salt, (F.rand(7) * SALTS).cast("int"))
    return dealt.join(spread, [*on, salt], how).drop(salt)
