"""CSV files that each bring their own header, read by name and never by position.

A data set of parts need not agree on the order of its columns, and Spark's reader takes one header
for all. Here the lines are read as text in one pass. A line that holds every required name, in any
order, is a header; each file's header says where its values are. Records are one line each, so a
large file is split over tasks. Lines that do not fit their header stay, with their fault.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recohort.functions.scalars import fold
from recohort.session import pin

FILES_TO_BROADCAST = 100_000  # Rows of one path and one header number: some tens of megabytes at most.


def plain_name(text: str) -> str:
    """A column name without byte order mark and outer blanks, case-folded."""
    return text.lstrip("﻿").strip().casefold()


def header_names(line: str) -> list[str]:
    return [plain_name(name) for name in next(csv.reader([line]), [])]


def plain_path(path: Column) -> Column:
    """A file's path without scheme and repeated slashes, as both listings and rows spell it."""
    return F.regexp_replace(path, "^file:/+", "/")


def _lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def _headers(lines: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(file, line) of the lines that hold every required name as a field."""
    fields = F.transform(F.split(F.regexp_replace("line", "[﻿\"]", ""), ","), fold)
    return lines.filter(F.size(F.array_except(F.array(*[F.lit(name) for name in required]), fields)) == 0).select("file", "line")


def read_headed_csv(spark: SparkSession, paths, required: tuple[str, ...], most_headers: int = 100) -> DataFrame:
    """The required columns as text, ``file``, ``line`` and ``fault`` of every record; other columns are ignored.

    ``fault`` is null, ``no header`` for lines of a file without the required names, or ``malformed line``
    where the number of values is not that of the header; values of faulty lines are null. An empty value
    is null, and so is an absent one. Raises if no file has the names, if a header repeats one, or if
    there are more different headers than ``most_headers``.
    """
    lines = _lines(spark, paths)
    headers = pin(_headers(lines, tuple(plain_name(n) for n in required)).distinct(), "headers")
    found = [row["line"] for row in headers.select("line").distinct().orderBy("line").limit(most_headers + 1).collect()]
    if not found:
        raise ValueError(f"no header with all required columns: {list(required)}")
    if len(found) > most_headers:
        raise ValueError(f"more than {most_headers} different headers")
    names = [header_names(line) for line in found]
    for header in names:
        repeated = sorted({name for name in header if header.count(name) > 1})
        if repeated:
            raise ValueError(f"missing or duplicate columns: {repeated} repeated in a header")
    numbered = F.create_map(*[c for i, line in enumerate(found) for c in (F.lit(line), F.lit(i))])
    # A file that is one of several concatenated ones may repeat its header, but not change it.
    by_file = headers.groupBy("file").agg(F.min(numbered[F.col("line")]).alias("header"), F.max(numbered[F.col("line")]).alias("other"))
    by_file = pin(by_file, "header-numbers")
    if by_file.filter("header <> other").limit(1).count():
        raise ValueError("a file has two different headers")
    few = F.broadcast(by_file) if by_file.count() <= FILES_TO_BROADCAST else by_file
    rows = lines.join(few.select("file", "header"), "file", "left").filter(F.col("header").isNull() | ~F.col("line").isin(found))
    rows = rows.filter(F.length(F.trim("line")) > 0)
    parsed = {}
    for i, header in enumerate(names):
        schema = ", ".join([*(f"c{k} string" for k in range(len(header))), "_bad string"])
        parsed[f"_p{i}"] = F.when(F.col("header") == i, F.from_csv("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rows = rows.withColumns(parsed)
    bad = F.coalesce(*[F.col(f"_p{i}._bad") for i in range(len(names))], F.lit(None).cast("string"))
    fault = F.when(F.col("header").isNull(), "no header").when(bad.isNotNull(), "malformed line")

    def value(name: str) -> Column:
        picks = [F.col(f"_p{i}.c{header.index(plain_name(name))}") for i, header in enumerate(names)]
        return F.when(fault.isNull(), F.coalesce(*picks, F.lit(None).cast("string"))).alias(name)

    return rows.select(*[value(name) for name in required], "file", "line", fault.alias("fault"))


def line_faults(rows: DataFrame) -> DataFrame:
    """Records that could not be read, with their file."""
    return rows.filter(F.col("fault").isNotNull()).select("file", "line", F.col("fault").alias("rule"))
