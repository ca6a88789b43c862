"""Orders that are computed in ranges: medians and splits by count."""

import statistics
from datetime import datetime, timedelta

import pytest

from newsloom.operators import evaluation, splits


@pytest.mark.parametrize("values", [[], [None], [4.0], [4.0, 1.0], [2.0, 2.0, 2.0, 9.0], [float(i * i % 101) for i in range(500)], [0.0] * 7 + [1.0] * 7, [None, 3.0, 8.0, 5.0]])
def test_median(spark, values):
    out = evaluation.median(spark.createDataFrame([(v,) for v in values], "h double"), "h").collect()
    known = [v for v in values if v is not None]
    assert [r["median"] for r in out] == [statistics.median(known) if known else None]


def test_split_of_one_day_by_count(spark):
    """Order of time and, for equal times, of the other columns; missing times come first."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i * 7 % 50) if i else None) for i in range(100)]
    out = splits.time_split(spark.createDataFrame(rows, "id long, ts timestamp_ntz")).collect()
    ordered = [i for i, _ in sorted(rows, key=lambda r: (r[1] or start - timedelta(1), r[0]))]
    expected = {i: "train" if at < 60 else "val" if at < 80 else "test" for at, i in enumerate(ordered)}
    assert {r.id: r.split for r in out} == expected
    assert all(set(r.asDict()) == {"id", "ts", "split"} for r in out)
