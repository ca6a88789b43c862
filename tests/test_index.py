"""The inverted file against the exact search: recall, partitions read, and vectors without a direction."""

import numpy as np
from newsloom.operators import index, vectors
from oracle import SMALL


def clustered(n=3000, d=16, centres=30, seed=2):
    draw = np.random.default_rng(seed)
    c = draw.normal(size=(centres, d))
    return c[draw.integers(0, centres, n)] + 0.3 * draw.normal(size=(n, d))


def ids(df):
    return [r.id for r in df.collect()]


def test_recall_and_exactness(spark, tmp_path):
    x = clustered()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    lists = index.build(table, str(tmp_path))
    assert 40 <= lists <= 60
    hits = []
    for i in range(0, 3000, 300):
        q = (x[i] + 0.01).tolist()
        exact = vectors.top_k(table, q, 10)
        assert ids(index.search(spark, str(tmp_path), q, 10, None)) == ids(exact)
        found = index.search(spark, str(tmp_path), q, 10, 8)
        assert "PartitionFilters: [list" in found._jdf.queryExecution().executedPlan().toString()
        hits.append(len(set(ids(found)) & set(ids(exact))) / 10)
    assert np.mean(hits) >= 0.95


def test_every_row_is_listed(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, [0.9, 0.1]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0]), (None, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as list", "2 as v")
    index.build(table, str(tmp_path / "a"))
    assert sorted(map(str, ids(index.search(spark, str(tmp_path / "a"), [1.0, 0.0], 99, None)))) == ["1", "2", "5", "6", "7", "7", "None"]
    assert ids(index.search(spark, str(tmp_path / "a"), [1.0, 0.0], 2, 1)) == [1, 6]
    assert index.build(table.limit(0), str(tmp_path / "b")) == 0
    assert ids(index.search(spark, str(tmp_path / "b"), [1.0, 0.0], 2)) == []


def test_given_vectors(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    query = table.orderBy("vec_id").first().embedding
    index.build(table, str(tmp_path))
    exact = vectors.top_k(table, query, 20)
    assert ids(index.search(spark, str(tmp_path), query, 20, None)) == ids(exact)
