"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import filled, join_small, stash, uniform

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents of one source compete by size: their expected copies grow as the size, in classes of a quarter octave, to this power.
PREFER = 0.5
CLASSES = 4
#: Rows of one source that are ranked together, as expected.
BUCKET_ROWS = 512
#: What a source's sample may miss of its target before documents are taken out of their order to come nearer.
TOLERANCE = 0.01
#: Equal rows that one task writes.
CHUNK = 4096
SEED = 20


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """rows with place, from 0, by a text column, null last. Rows are dealt by range and counted by part; no task sees all."""
    order = F.col(by).asc_nulls_last()
    parts = stash(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).withColumn("__part", F.spark_partition_id()), "mix-ranks")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n")).collect()  # one for each shuffle partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before[r["__part"]], total = total, total + r.n
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("__part")) if before else F.lit(0)
    return parts.withColumn("place", offset + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1).drop("__part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n) -> the same with target: all sizes shared by weight, each target at most ``limit`` times its
    source's size and the excess reshared until none is above.

    One row for each source; sources come by code point, null last. Each round of sharing is one aggregation of whole
    numbers over the sources, so reruns agree to the last bit; it ends when no source goes above its limit.
    """
    ranked = stash(_ranked(sizes, "source").withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int"))), "mix-weights")
    weight, cap = F.col("weight"), F.col("source_size") * limit
    held, level = -1, 0.0
    while True:
        above = F.lit(level) * weight > cap
        x = ranked.agg(F.sum("source_size").alias("all"), F.count_if(above).alias("n"), F.sum(F.when(above, cap).otherwise(0)).alias("caps"), F.sum(F.when(above, 0).otherwise(weight)).alias("open")).first()
        if x.n == held or not x.open:
            break
        held, level = x.n, (x["all"] - x.caps) / x.open
    return ranked.select("source", "source_size", "n", F.least(cap.cast("double"), F.lit(level) * weight).alias("target"))


def n_words(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit("[^ \t-\r]+")).cast("long")


def _key(source: Column) -> Column:
    return filled(F.concat(F.lit("s"), source))


def _class(size: Column) -> Column:
    return F.when(size > 0, F.floor(CLASSES * F.log2(size.cast("double")))).otherwise(-1).cast("int")


def expected(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = MAX_COPIES) -> DataFrame:
    """(source, size) -> (key, class, source_size, target, root, certain, p, lack): what each size class of a source may expect.

    A class may expect c * size ** PREFER copies, ``limit`` at most, with c so that the source's expected words are its
    target. The whole part is certain; p, the rest, is the chance of one copy more; lack is the words that those copies are
    to bring. A source has some 4 classes for each doubling of the size, so the plan grows with sources, not documents.
    """
    by_class = stash(narrow.groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"), F.count("*").alias("m")), "mix-classes")
    per = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("m").alias("n")), weights, limit)
    rows = by_class.withColumn("key", _key(F.col("source"))).join(per.withColumn("key", _key(F.col("source"))).drop("source"), "key")
    down = Window.partitionBy("key").orderBy(F.desc("class"))
    gain = F.pow(F.lit(2.0), F.col("class") * (PREFER / CLASSES))
    capped = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * limit
    rest = F.sum(F.col("words") * gain).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.where("words > 0").withColumns({"gain": gain, "c": (F.col("target") - capped) / rest})
    fits = F.when(F.col("c") * F.col("gain") <= limit * (1 + 1e-9), F.col("c"))
    rows = rows.withColumn("fits", fits).withColumn("c", F.first("fits", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    copies = F.least(F.lit(float(limit)), F.coalesce(F.col("c") * F.col("gain"), F.lit(float(limit))))
    rows = rows.withColumn("copies", copies).withColumn("certain", F.floor(F.col("copies") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("copies") - F.col("certain"), F.lit(0.0)))
    sure = F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("key"))
    planned = rows.withColumn("lack", F.greatest(F.col("target") - sure, F.lit(0.0))).select("key", "class", "source_size", "target", "n", "certain", "p", "lack")
    wordless = per.select(_key(F.col("source")).alias("key"), F.lit(-1).alias("class"), "source_size", "target", "n", F.lit(0).alias("certain"), F.lit(0.0).alias("p"), F.lit(0.0).alias("lack"))
    return planned.unionByName(wordless).withColumn("root", F.ceil(F.sqrt(F.col("n") / BUCKET_ROWS))).drop("n")


class Mix:
    """The mix of a table: what each row expects, where the ranking is cut, and what the rows at the cut get.

    Ranks are found without sorting a source: documents are dealt by v, the Pareto quotient q = (u / (1 - u)) / (p / (1 - p))
    as q / (1 + q), to the square root of n / BUCKET_ROWS coarse buckets, and the cut one again to as many fine ones. Only
    sums of words by bucket are ordered, and only the fine bucket at the cut is gathered: about BUCKET_ROWS rows of a source,
    whatever its size, equal rows being one entry with their number.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...], limit: int, seed: int) -> None:
        self.seed, self.limit = seed, limit
        self.narrow = stash(self.measured(docs.select("doc_id", "source", "text")).drop("text"), "mix")
        self.plan = stash(expected(self.narrow, weights, limit), "mix-plan")
        self.n_plan = self.plan.count()
        rows = self.dealt(self.narrow).where("p > 0")
        first = self.cut(rows, "coarse", "lack", "c1", "room1")
        self.cuts = stash(self.cut(join_small(rows, first, ["key"], first.count()).where("coarse = c1"), "fine", "room1", "c2", "room"), "mix-cuts")
        self.n_cuts = self.cuts.count()
        self.edge = stash(self.taken_at_the_cut(), "mix-edge")

    def measured(self, docs: DataFrame) -> DataFrame:
        """docs with size, u and key."""
        return docs.withColumns({"size": n_words(F.col("text")), "u": uniform(F.lit(self.seed), F.col("doc_id"), F.col("text")), "key": _key(F.col("source"))})

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows (key, size, u, ...) with their class's expectations, v and both buckets."""
        rows = join_small(rows.withColumn("class", _class(F.col("size"))), self.plan, ["key", "class"], self.n_plan)
        u, p, root = F.col("u"), F.col("p"), F.col("root")
        v = F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)).otherwise(1.0)
        at = lambda x: F.least(F.floor(x * root), root - 1)
        return rows.withColumn("v", v).withColumn("coarse", at(F.col("v"))).withColumn("fine", at(F.col("v") * root - F.col("coarse")))

    @staticmethod
    def cut(rows: DataFrame, bucket: str, lack: str, at: str, room: str) -> DataFrame:
        """(key, at, room): of each key the first bucket whose words, with those before, are more than what lacks, and what of
        that those before leave; keys without such a bucket are absent. Earlier cuts are carried along."""
        carried = [c for c in ("c1",) if c in rows.columns]
        sums = rows.groupBy("key", bucket, *carried).agg(F.sum("size").alias("words"), F.first(lack).alias("lack_"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        over = sums.withColumn("upto", upto).where("upto > lack_")
        return over.groupBy("key", *carried).agg(F.min(F.struct(bucket, (F.col("lack_") - F.col("upto") + F.col("words")).alias("room_"))).alias("x")).select("key", *carried, F.col(f"x.{bucket}").alias(at), F.col("x.room_").alias(room))

    def sided(self, rows: DataFrame) -> DataFrame:
        """dealt rows with side: -1 before the cut of their source, 0 at it, 1 after it or without a chance of more."""
        joined = join_small(rows, self.cuts, ["key"], self.n_cuts, "left")
        ahead = F.when(F.col("c1").isNull() | (F.col("coarse") < F.col("c1")), -1).when(F.col("coarse") > F.col("c1"), 1)
        return joined.withColumn("side", F.when(F.col("p") <= 0, 1).otherwise(F.coalesce(ahead, F.when(F.col("fine") < F.col("c2"), -1).when(F.col("fine") > F.col("c2"), 1).otherwise(0))))

    def taken_at_the_cut(self) -> DataFrame:
        """(key, doc_id, u, size, source, source_size, target, certain, m, more): the m equal rows at the cut, and how many of
        them get one copy more. They are taken in order until one doesn't fit; that one is taken too if it comes nearer to the
        target than stopping short. Only if more than TOLERANCE of the target is missing even so, as in a source of a few
        documents, the fill goes on down the ranking with whatever fits, and ends with the row that comes nearest."""
        columns = ["doc_id", "u", "size", "source", "source_size", "target", "certain"]
        rows = self.sided(self.dealt(self.narrow)).where("side = 0").groupBy("key", "room", "v", *columns).agg(F.count("*").alias("m"))
        gathered = rows.groupBy("key", "room").agg(F.max(TOLERANCE * F.col("target")).alias("slack"), F.sort_array(F.collect_list(F.struct("v", *columns, "m"))).alias("ranked"))
        most = lambda s, x: F.least(x["m"], F.floor(s["room"] / x["size"]))
        state = F.struct(F.col("room").alias("room"), F.lit(-1).alias("first"), F.array().cast("array<bigint>").alias("more"))

        def step(s: Column, x: Column) -> Column:
            fit = F.when((s["first"] < 0) | (s["room"] > F.col("slack")), most(s, x)).otherwise(0)
            left = s["room"] - fit * x["size"]
            first = F.when((s["first"] < 0) & (fit < x["m"]), F.size(s["more"])).otherwise(s["first"])
            return F.struct(left.alias("room"), first.alias("first"), F.concat(s["more"], F.array(fit)).alias("more"))

        full = gathered.select("key", "slack", "ranked", F.aggregate("ranked", state, step).alias("s")).select("key", "slack", "ranked", "s.more", "s.room", "s.first")
        off = F.transform("ranked", lambda x, i: F.when((F.get("more", i) < x["m"]) & ((i == F.col("first")) | (F.col("room") > F.col("slack"))), F.struct(F.abs(x["size"] - F.col("room")).alias("off"), i.alias("i"))))
        nearest = full.withColumn("best", F.array_min(off))
        more = F.transform("more", lambda t, i: t + F.when((F.col("best.off") < F.col("room")) & (F.col("best.i") == i), 1).otherwise(0))
        each = nearest.select("key", F.explode(F.arrays_zip("ranked", more.alias("more"))).alias("x"))
        return each.select("key", *(F.col(f"x.ranked.{c}").alias(c) for c in (*columns, "m")), F.col("x.more").alias("more"))


def _repeated(rows: DataFrame, n: str, index: str) -> DataFrame:
    """Each row n times, numbered from 1 in ``index``; more than CHUNK of a row are dealt to several tasks."""
    parts = rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    dealt = parts.repartition("key", "doc_id", "u", "__part")
    return dealt.withColumn(index, F.explode(F.sequence(F.col("__part") * CHUNK + 1, F.least(F.col(n), (F.col("__part") + 1) * CHUNK)))).drop("__part")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, size, source, source_size, target, copies, taken), a row for each row of docs: how
    many copies of each document the mix takes, and how many words that is.

    Every source has a target of words. Its documents expect unequal numbers of copies, more for longer ones (expected());
    the whole part of that is allocated as certain copies, and the rest is the inclusion probability p of one more. For
    those, documents are ranked by the Pareto quotient (u / (1 - u)) / (p / (1 - p)), u being a uniform number hashed from the
    seed, doc_id and the text, and taken in that order up to the words that the target still lacks: a sample of fixed size,
    counted in words, whose inclusion probabilities are about p.

    Null texts have size 0, null sources are one source, the last. Repeated rows are separate documents of one rank.
    Sources without words have target 0 and take nothing. An empty table gives no rows; other columns are ignored.
    """
    m = Mix(docs, weights, limit, seed)
    columns = ["doc_id", "size", "source", "source_size", "target"]
    far = m.sided(m.dealt(m.narrow)).where("side <> 0").select(*columns, (F.col("certain") + (F.col("side") < 0).cast("int")).alias("copies"))
    edge = _repeated(m.edge, "m", "i").select(*columns, (F.col("certain") + (F.col("i") <= F.col("more")).cast("int")).alias("copies"))
    return far.unionByName(edge).withColumn("taken", F.col("copies") * F.col("size"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) with each row as many times as the mix takes it; rows it does not take go, rows without
    words stay once. Rows at the cut that agree in doc_id, text and source are interchangeable: one of them stands for all.
    Texts are not shuffled but for those at the cut."""
    m, names = Mix(docs, weights, limit, seed), [f"__c{i}" for i in range(len(docs.columns))]
    own = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("__row"), "doc_id", "source", "text")
    rows = m.sided(m.dealt(m.measured(own).drop("text")))
    back = [F.col(f"__row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)]
    n = F.when(F.col("size") == 0, 1).otherwise(F.col("certain") + (F.col("side") < 0).cast("int"))
    far = rows.where("side <> 0").withColumn("__n", n).where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    one = rows.where("side = 0").groupBy("key", "doc_id", "u").agg(F.min("__row").alias("__row"))
    same = (one["key"] == m.edge["key"]) & one["doc_id"].eqNullSafe(m.edge["doc_id"]) & (one["u"] == m.edge["u"])
    edge = one.join(m.edge, same).select(one["key"], one["doc_id"], one["u"], "__row", (F.col("m") * F.col("certain") + F.col("more")).alias("__n")).where("__n > 0")
    return far.select(*back).unionByName(_repeated(edge, "__n", "__i").select(*back))
