"""Which files to fetch."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import hex_lower, java_regex
from lodestone.sources.storage import settle


def select_files(files: DataFrame, extensions: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Files whose name ends with any extension or holds any pattern; with neither, all of them. Null names pass only then."""
    name = F.col("name")
    tests = [name.endswith(e) for e in extensions] + [name.rlike(java_regex(p, files.sparkSession)) for p in patterns]
    return files.where(reduce(or_, tests)) if tests else files


def hex_ids(files: DataFrame) -> DataFrame:
    return files.withColumn("sha1_git", hex_lower(F.col("sha1_git")))


TOP = 100_000  #: as many rows as one task may choose from those of all others


def first_by_ranges(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows by order, with no task that gets more than its range: ranges are counted, then the last one is cut.

    Rows that are equal in order are dealt to several ranges, too. Only a count a partition goes to the driver. Settles: call it in a scope.
    """
    pos = "pos"
    while pos in rows.columns:
        pos += "_"
    ties = F.monotonically_increasing_id()
    placed = settle(rows.repartitionByRange(*order, ties).sortWithinPartitions(*order).withColumn(pos, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(pos), 33)
    left, end = n, 0
    for p, count in sorted(map(tuple, placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())):
        end = (p << 33) + min(left, count)
        left -= count
        if left <= 0:
            break
    return placed.where(F.col(pos) < end).drop(pos)


def limit_files(files: DataFrame, n: int | None, top: int = TOP) -> DataFrame:
    """The first n by repository, path and hash; None and 0: all. Up to top rows, one task merges the others' first; above it, see first_by_ranges."""
    if n is not None and n < 0:
        raise ValueError("max_files is negative")
    order = [F.col(c).asc_nulls_last() for c in ("repo_url", "path", "sha1_git")]
    return files if not n else files.orderBy(*order).limit(n) if n <= top else first_by_ranges(files, n, order)


def with_defaults(files: DataFrame) -> DataFrame:
    """sha1_git, repo_url, path; a column that files lacks reads "unknown", and so does a null URL."""
    have = set(files.columns)
    return files.select("sha1_git", (F.coalesce("repo_url", F.lit("unknown")) if "repo_url" in have else F.lit("unknown")).alias("repo_url"), (F.col("path") if "path" in have else F.lit("unknown")).alias("path"))
