"""Ranks over whole tables, long literals and free names; and the settled tables of the rest of the package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.storage import alone, bucketed, exists, forget, new_path, scope, settle, shared_dir, stored_bytes

_LOW = (1 << 33) - 1


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def long_array(values) -> Column:
    """A literal array<bigint>; folded once by the optimizer, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def ranked(df: DataFrame, *keys: str, name: str = "rank") -> tuple[DataFrame, int]:
    """df with each row's place, gapless from 0, in the order of keys; and the number of rows.

    The rows are range-partitioned and sorted, so that no task holds more than its range, then
    settled: places depend on partitions that a retry must not deal anew. Only one count a
    partition goes to the driver. df is read twice (once for the ranges): settle it if it is dear.
    """
    pos = free_name(df, "pos")
    fixed = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(pos, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(pos), 33)
    counts = {r[0]: r[1] for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    at = F.element_at(long_array(starts), (part + 1).cast("int")) + F.col(pos).bitwiseAND(F.lit(_LOW))
    return fixed.withColumn(name, at).drop(pos), total


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, for what runs in the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


HOT = 1000  #: a key is hot if it holds more than one in so many rows; hence there are fewer hot keys than that


def join_unique(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", least: int = 1 << 25) -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key; settle left: it is read several times.

    Rows of hot keys stay where they are: their less than HOT rows of right are broadcast. So no
    task gets all rows of a key, whatever its share. A settled left of less than least bytes, which
    one task can hold, is simply joined.
    """
    held = stored_bytes(left)
    if held is not None and held < least:
        return left.join(right, key, how)
    total = left.count()
    keys = [key] if isinstance(key, str) else key
    count = free_name(left, "rows")
    hot = settle(left.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) * HOT > total).select(*keys).dropna())
    if hot.isEmpty():
        return left.join(right, key, how)
    few = right.join(F.broadcast(hot), key, "left_semi")
    stay = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    return stay.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


__all__ = ["alone", "bucketed", "exists", "forget", "free_name", "join_unique", "long_array", "new_path", "ranked", "scope", "setting", "settle", "shared_dir"]
