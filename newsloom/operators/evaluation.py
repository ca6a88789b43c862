"""Evaluation of rankings, classifiers and clusterings, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.articles import hours
from newsloom.functions.arrays import let
from newsloom.operators.vectors import CENTERS_AT_ONCE, against, dot, norm, shape_of, unit_cells


def at_k(ranked: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50), truth: str = "truth", order: tuple = ()) -> DataFrame:
    """(k, precision, recall): hits among the first k over k and over all positives; a k beyond the items is left out. Only
    the first max(ks) rows are ranked."""
    top = ranked.orderBy(*order).limit(max(ks)).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.coalesce(F.col(truth), F.lit(False)).alias("hit"))
    totals = ranked.agg(F.count("*").alias("items"), F.count_if(F.coalesce(F.col(truth), F.lit(False))).alias("positives"))
    k = ranked.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hits = k.join(F.broadcast(top), F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.count_if("hit").alias("hits"))
    both = hits.join(F.broadcast(totals)).where("k <= items")
    return both.select("k", (F.col("hits") / F.col("k")).alias("precision"), F.when(F.col("positives") == 0, 0.0).otherwise(F.col("hits") / F.when(F.col("positives") != 0, F.col("positives"))).alias("recall"))


KS = (5, 10, 20, 50)


def at_k_row(ranked: DataFrame, truth: str, order: tuple) -> DataFrame:
    """at_k() as one row: precision_at_5, recall_at_5 and so on, null for a k beyond the items."""
    found = at_k(ranked, KS, truth, order)
    return found.agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_at_{k}") for k in KS for c in ("precision", "recall")))


def _by_score(scored: DataFrame, score: str, truth: str) -> DataFrame:
    return scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(truth)).alias("p"))


#: Ranges that ordered sums are computed in, side by side.
RANGES = 200


def running(g: DataFrame, order: str, sums: dict[str, Column], descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """g with the sum of each column over the rows before, by ``order`` and then by ``ties``. Rows are dealt to RANGES ranges of
    about as many rows; the ranges' sums, a row each, are added up first, so no task orders more than a range, or than the rows
    of one value."""
    bounds = g.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    rows = g.withColumns(sums).withColumn("__r", F.size(F.filter(cuts, lambda c: c <= F.col(order))) * (-1 if descending else 1))
    totals = rows.groupBy("__r").agg(*(F.sum(c).alias(f"t_{c}") for c in sums))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    totals = totals.select("__r", *(F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"t_{c}") for c in sums))
    within = Window.partitionBy("__r").orderBy(F.desc(order) if descending else F.asc(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(totals), "__r").withColumns({c: F.col(f"t_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).drop("__r", *(f"t_{c}" for c in sums))


def roc_auc(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """One row: area under the ROC curve with mid-ranks for ties; one half if a class is absent. Rows are first counted by
    score, and the distinct scores are ordered in ranges."""
    g = running(_by_score(scored, score, truth), "s", {"below": F.col("n") - F.col("p")})
    u = g.withColumn("u", F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2))
    s = u.agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    pairs = F.col("p") * F.col("q")
    return s.select(F.when(F.coalesce(pairs, F.lit(0)) == 0, 0.5).otherwise(F.col("u") / F.when(pairs != 0, pairs)).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """One row: step-wise average precision; 0 without positives."""
    g = running(_by_score(scored, score, truth), "s", {"tp": F.col("p"), "seen": F.col("n")}, descending=True)
    s = g.agg(F.sum(F.col("p") * (F.col("tp") + F.col("p")) / (F.col("seen") + F.col("n"))).alias("a"), F.sum("p").alias("p"))
    return s.select(F.when(F.coalesce("p", F.lit(0)) == 0, 0.0).otherwise(F.col("a") / F.when(F.col("p") != 0, F.col("p"))).alias("average_precision"))


def median(values: DataFrame, value: str) -> DataFrame:
    """One row: the median of the values that are not null, the mean of the middle two; null without any. Values are counted
    first, and the distinct ones are ordered in ranges."""
    g = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("s")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    middle = running(g, "s", {"below": F.col("n")}).join(F.broadcast(total))  # one row
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return middle.agg(((F.max(F.when(holds(low), F.col("s"))) + F.max(F.when(holds(high), F.col("s")))) / 2).alias("median"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def confusion(scored: DataFrame, predicted: Column, truth: str = "truth") -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1, with 0 where a denominator is."""
    t = F.col(truth)
    c = scored.select(predicted.alias("y"), t.alias("t")).agg(F.count_if(F.col("y") & F.col("t")).alias("tp"), F.count_if(F.col("y") & ~F.col("t")).alias("fp"), F.count_if(~F.col("y") & F.col("t")).alias("fn"), F.count_if(~F.col("y") & ~F.col("t")).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_at_median(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    middle = median(scored, score).withColumnRenamed("median", "__m")
    return confusion(scored.join(F.broadcast(middle)), F.col(score) >= F.col("__m"), truth)


def purity(assigned: DataFrame, cluster: str = "cluster", truth: str = "truth") -> DataFrame:
    """One row: documents of their cluster's most frequent truth over all with a truth, noise (-1) excluded; 0 without any."""
    n = assigned.where((F.col(cluster) >= 0) & F.col(truth).isNotNull()).groupBy(cluster, truth).agg(F.count("*").alias("n"))
    s = n.groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("all")).agg(F.sum("top").alias("a"), F.sum("all").alias("b"))
    return s.select(_ratio(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("purity"))


def silhouette(vectors: DataFrame, id_: str = "vec_id", key: str = "label", vector: str = "embedding") -> DataFrame:
    """One row: the mean cosine silhouette, noise (-1) excluded, 0 with fewer than two clusters. The mean distance of a
    unit vector to a cluster is 1 minus its dot product with the cluster's mean, so it is linear in vectors times clusters.
    Clusters' sums are held against the vectors in blocks."""
    v = vectors.where(F.col(key) >= 0)
    sizes = v.groupBy(key).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "s")))
    sums = unit_cells(v, [key], vector).groupBy(key, "dim").agg(F.sum("x").alias("s")).groupBy(key).agg(F.transform(ordered, lambda c: c["s"]).alias("centroid")).join(sizes, key)

    def far(centers: Column) -> Column:
        total = lambda n: lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"), (c["n"] - F.when(n == 0, 0.0).otherwise(dot(F.col(vector), c["c"]) / F.when(n != 0, n))).alias("total"))
        split = lambda t: F.struct(F.get(F.filter(t, lambda c: c["k"] == F.col(key)), F.lit(0)).alias("own"), F.array_min(F.transform(F.filter(t, lambda c: c["k"] != F.col(key)), lambda c: c["total"] / c["n"])).alias("b"))
        return let(let(norm(F.col(vector)), lambda n: F.transform(centers, total(n))), split)

    shape = shape_of(v, key, vector)
    rows = against(v.select(id_, key, vector), sums, key, far, shape, ("n",)).select(id_, "taken.own", "taken.b")
    if shape[0] > CENTERS_AT_ONCE:
        rows = rows.groupBy(id_).agg(F.max("own").alias("own"), F.min("b").alias("b"))
    rows = rows.select(F.col("own.n").alias("n"), (F.col("own.total") / F.greatest(F.col("own.n") - 1, F.lit(1))).alias("a"), "b")
    s = F.when((F.col("n") == 1) | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return rows.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


def lead_times(alerts: DataFrame, peaks: DataFrame) -> DataFrame:
    """One row: number, mean and median of the positive hours from an alert (cluster_id, alert_time) to its cluster's peak."""
    h = alerts.join(peaks, "cluster_id").select(hours(F.col("peak_time"), F.col("alert_time")).alias("h")).where("h > 0")
    row = h.agg(F.count("*").alias("n"), F.coalesce(F.avg("h"), F.lit(0.0)).alias("mean_hours")).join(median(h, "h"))  # one row each
    return row.select("n", "mean_hours", F.coalesce("median", F.lit(0.0)).alias("median_hours"))


def summarize(values: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Mean, population deviation, least, greatest and number of each metric over folds."""
    return values.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count("*").alias("n"))


def evaluate_classifier(scored: DataFrame, predicted: Column, score: str = "score", truth: str = "truth", ties: tuple = ()) -> DataFrame:
    """One row: confusion(), roc_auc (one half if a class is absent), average_precision (0 if a class is absent), and at_k_row() by score;
    ``ties`` orders equal scores."""
    both = F.broadcast(scored.agg((F.count_if(F.col(truth)) * F.count_if(~F.col(truth)) > 0).alias("__both")))
    row = confusion(scored, predicted, truth).join(roc_auc(scored, score, truth)).join(average_precision(scored, score, truth)).join(both)  # one row each
    row = row.join(at_k_row(scored, truth, (F.desc(score), *ties)))
    return row.withColumn("average_precision", F.when(F.col("__both"), F.col("average_precision")).otherwise(0.0)).drop("__both")


def evaluate_alerts(scored: DataFrame, alerts: DataFrame, peaks: DataFrame, score: str = "score", truth: str = "truth", order: tuple = ()) -> DataFrame:
    """One row: at_k_row() by ``order`` (by score without one), number of items, tp, fp, fn, tn, precision, recall and f1 of scores from the median up, roc_auc (one half if a class
    is absent), average_precision (the base rate if one is), and the lead times of alerts before peaks."""
    t = F.col(truth)
    rates = F.broadcast(scored.agg(F.count("*").alias("items"), F.coalesce(F.avg(t.cast("double")), F.lit(0.0)).alias("__rate")))
    row = confusion_at_median(scored, score, truth).drop("accuracy").join(roc_auc(scored, score, truth)).join(average_precision(scored, score, truth)).join(rates)  # one row each
    some = (F.col("__rate") > 0) & (F.col("__rate") < 1)
    row = row.withColumn("average_precision", F.when(some, F.col("average_precision")).otherwise(F.col("__rate"))).drop("__rate")
    row = row.join(at_k_row(scored, truth, order or (F.desc(score),)))
    return row.join(lead_times(alerts, peaks).withColumnRenamed("n", "leads"))


def evaluate_clustering(vectors: DataFrame, id_: str = "vec_id", key: str = "label", truth: str = "truth", vector: str = "embedding") -> DataFrame:
    """One row: the number of clusters without noise, silhouette and purity."""
    n = vectors.agg(F.count_distinct(F.when(F.col(key) >= 0, F.col(key))).alias("n_clusters"))
    return n.join(silhouette(vectors, id_, key, vector)).join(purity(vectors, key, truth))
