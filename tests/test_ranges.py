"""CSV by byte ranges against Python's reader and Spark's, with ranges so small that records cross many of them."""

import csv
import random

import pytest
from newsloom.schema import RAW_ARTICLE, RAW_COLUMNS
from newsloom.sources import articles, ranges
from pyspark.errors import AnalysisException

CELLS = ("", "a", 'he said "x"', "two\nlines", "\n\n", "comma, here", 'é"\n"', '""', " pad ", "a\r\nb", "'", "\\", "\\\"")


@pytest.fixture
def small(spark):
    """Ranges of about 400 bytes, many of them in a task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    of(400)
    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, **({"lineterminator": "\n"} | options)).writerows([RAW_COLUMNS, *rows])


def drawn(draw, name, n):
    return [[f"{name}-{i}", *(draw.choice((*CELLS, "x" * draw.randint(0, 300), "l\n" * draw.randint(0, 120))) for _ in RAW_COLUMNS[1:])] for i in range(n)]


@pytest.mark.parametrize("size", [400, 3000])
def test_records_over_many_ranges(spark, tmp_path, small, size):
    small(size)
    draw = random.Random(size)
    given = {name: drawn(draw, name, 8) for name in "abc"}
    write(tmp_path / "a.csv", given["a"])
    write(tmp_path / "b.csv", given["b"], lineterminator="\r\n")
    write(tmp_path / "c.csv", given["c"], quoting=csv.QUOTE_ALL)
    got = [tuple(r)[:-1] for r in ranges.read(spark, str(tmp_path), RAW_ARTICLE).orderBy("ord").collect()]
    assert [tuple(x or "" for x in r) for r in got] == [tuple(r) for name in "abc" for r in given[name]]
    spark_s = [tuple(r)[:-1] for r in articles.read_raw(spark, str(tmp_path)).collect()]
    bare = lambda rows: sorted(repr(r).replace("\\r\\n", "\\n") for r in rows)
    assert bare(got) == bare(spark_s)  # empty cells and quoted empty cells too


def test_large_files_are_many_tasks_and_chunks_are_dense(spark, tmp_path, small):
    small(2000)
    row = ["A", "independent", "left", "T", "one\ntwo", "", "", "", "2024-01-01T00:00:00", "AP", *[""] * 6]
    write(tmp_path / "a.csv", [[i, *row] for i in range(95)])
    assert ranges._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 2
    found = articles.chunks(spark, str(tmp_path), 10, by_ranges=True).collect()
    assert sorted((int(r.id), r.chunk) for r in found) == [(i, i // 10) for i in range(95)]
    whole = lambda df: sorted(map(repr, df.drop("ord").collect()))
    assert whole(articles.load(spark, str(tmp_path), by_ranges=True)) == whole(articles.load(spark, str(tmp_path)))


def test_hard_files(spark, tmp_path):
    head = ",".join(RAW_COLUMNS)
    (tmp_path / "a.csv").write_text(f"﻿{head}\r\n\r\n1,A\r\n\n2,B{',' * 20}z")  # marked, blank lines, short and long rows, no last line break
    (tmp_path / "b.csv").write_text(head)
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text(f'{head}\n3,"never\nclosed\n')
    rows = ranges.read(spark, str(tmp_path), RAW_ARTICLE).orderBy("ord").collect()
    assert [(r.id, r.outlet, r.title) for r in rows] == [("1", "A", None), ("2", "B", None), ("3", "never\nclosed", None)]
    assert ranges.read(spark, str(tmp_path / "c.csv"), RAW_ARTICLE).collect() == []


def test_wrong_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id,name\n1,A\n")
    with pytest.raises(Exception, match="unknown header"):
        ranges.read(spark, str(tmp_path), RAW_ARTICLE).collect()
    with pytest.raises(AnalysisException):
        ranges.read(spark, str(tmp_path / "none"), RAW_ARTICLE)
    monkeypatch.setattr(ranges, "MAX_RANGES", 0)
    with pytest.raises(ValueError, match="maxPartitionBytes"):
        ranges.records(spark, str(tmp_path))
