"""Guarded merge of weekly parts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recohort.plans.history import merge_history, publish
from tests.fixtures import boundary_fixture

WEEKS = [("2023-09-20T00:00:00Z", "2023-09-27T00:00:00Z"), ("2023-09-27T00:00:00Z", "2023-10-04T00:00:00Z")]
COVERAGE = (datetime(2023, 9, 20), datetime(2023, 10, 4))


def part(spark, folder, index, key=None):
    row = boundary_fixture(spark, datetime(2023, 11, 15), datetime(2024, 3, 29)).limit(1)
    start, end = WEEKS[index]
    row = row.withColumns({"timestamp": F.lit(start), "order_created_at": F.lit(None).cast("string"),
                           "tx_hash": F.lit("0x" + str(key or index + 1) * 64)})
    path = str(folder / f"week-{index}-{key}")
    row.write.option("header", True).csv(path)
    return path, {"coverage_start": start, "coverage_end": end, "complete": True, "source_url": "u", "is_synthetic": False,
                  "normalization_version": 2, "row_count": 1}


def test_merge(spark, tmp_path):
    parts = [part(spark, tmp_path, 0), part(spark, tmp_path, 1)]

    def merge(chosen):
        return merge_history(spark, chosen, COVERAGE, 42161, "u", False, 2)

    merged = merge(parts)
    assert merged.count() == 2
    publish(merged, str(tmp_path / "snapshot"))
    assert spark.read.parquet(str(tmp_path / "snapshot")).count() == 2
    for change, message in (({"coverage_start": "2023-09-28T00:00:00Z"}, "gap"), ({"complete": False}, "incomplete"),
                            ({"source_url": "other"}, "provenance"), ({"row_count": 2}, "row count")):
        with pytest.raises(ValueError, match=message):
            merge([parts[0], (parts[1][0], {**parts[1][1], **change})])
    with pytest.raises(ValueError, match="reach the end"):
        merge(parts[:1])
    with pytest.raises(ValueError, match="empty"):
        merge([])
    # Each part is valid alone, but the same event key in two of them refuses the merge.
    with pytest.raises(ValueError, match="copies"):
        merge([parts[0], part(spark, tmp_path, 1, key=1)])
