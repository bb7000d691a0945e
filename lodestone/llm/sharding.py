"""Shards along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import storage


def hilbert(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """The place of each point on the Hilbert curve through a grid of 2^bits cells a side (Skilling's transform)."""
    x = [a.astype(np.int64).copy() for a in axes]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [a ^ t for a in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | ((a >> b) & 1)
    return out


def curve(*axes: Column, bits: int = 8) -> Column:
    """A column with the curve's index of axes, which hold whole numbers from 0 to 2^bits - 1."""
    if bits * len(axes) > 62:
        raise ValueError("the curve's index has at most 62 bits")

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert([c.to_numpy(np.int64) for c in cols], bits))

    return index(*axes)


def hashed(col: Column, bits: int) -> Column:
    """Names have no order: a cell by hash; null: cell 0."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(col), F.lit(1 << bits))).cast("long")


def scaled(col: Column, bits: int, top: float) -> Column:
    """A cell on a logarithmic scale from 0 to top; null and less than 1: cell 0."""
    cell = F.floor(F.log2(F.greatest(F.coalesce(col, F.lit(0)), F.lit(0)) + 1) / np.log2(top + 1) * (1 << bits))
    return F.least(cell, F.lit((1 << bits) - 1)).cast("long")


def shard(df: DataFrame, shards: int = 16, axes: tuple[Column, ...] = (), ties: tuple[str, ...] = (), bits: int = 8) -> DataFrame:
    """df in the curve's order, cut into runs of rows: shard, and slot (gapless from 0 in a shard).

    Row counts differ by one at most. Rows in one cell of the curve are ordered by ties, so a cell
    of any size is cut where the count says. Shards are empty where there are fewer rows than
    shards. Adds curve, shard and slot (own columns of these names are replaced); an empty table
    stays empty. Only a count a partition goes to the driver.
    """
    df = df.drop("curve", "shard", "slot")
    place = storage.free_name(df, "place")
    out, n = storage.ranked(storage.settle(df.withColumn("curve", curve(*axes, bits=bits))), "curve", *ties, name=place)
    n = max(n, 1)
    at = F.expr(f"cast(`{place}` * {shards}L div {n}L as int)")
    first = F.expr(f"(cast(shard as bigint) * {n}L + {shards - 1}L) div {shards}L")
    return out.withColumn("shard", at).withColumn("slot", F.col(place) - first).drop(place)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, curve, shard, slot of every document.

    size is the text's UTF-8 bytes plus 1 (null text: 1, and crc32 0, as for an empty one). The
    dimensions are language, source (both by hash) and size (logarithmic), 8 bits each. Columns
    that docs lacks count as null; repeated rows and null ids are rows like any other.
    """
    have = {c.lower() for c in docs.columns}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), name("lang").alias("lang"), name("source").alias("source"))
    return shard(rows, shards, (hashed(F.col("lang"), 8), hashed(F.col("source"), 8), scaled(F.col("size"), 8, 1e6)), ("text_crc32", "doc_id"))


CELLS = ("cell_lang", "cell_source", "cell_size")


def _cells(lang: Column, source: Column, size: Column) -> tuple[Column, Column, Column]:
    return hashed(lang, 8), hashed(source, 8), scaled(size, 8, 1e6)


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write all columns of docs in the curve's order, a folder for each shard, below path/rows; and each shard's least and greatest cells to path/manifest.

    docs has doc_id, text, lang and source. Adds size, the cells (CELLS), curve, shard and slot; own
    columns of these names are replaced. Null metadata has cells too. An empty table keeps its schema.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("size", (F.octet_length(text) + 1).cast("long"))
    rows = rows.withColumns(dict(zip(CELLS, _cells(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("size")), strict=True)))
    dealt = storage.settle(shard(rows, shards, tuple(map(F.col, CELLS)), ("doc_id",)))
    if dealt.isEmpty():
        dealt.drop("shard").write.parquet(f"{path}/rows/shard=0")
    else:
        dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")
    ranges = [f(c).alias(f"{n}_{c}") for c in CELLS for n, f in (("least", F.min), ("most", F.max))]
    dealt.groupBy("shard").agg(F.count("*").alias("n"), *ranges).coalesce(1).write.parquet(f"{path}/manifest")
    storage.forget(dealt)


def _box(lang: str | None, source: str | None, sizes: tuple[int, int] | None) -> list[tuple[str, Column, Column]]:
    """The given dimensions' cells, from and to."""
    low, high = (_cells(F.lit(lang), F.lit(source), F.lit(size)) for size in sizes or (0, 0))
    return [(c, a, b) for c, a, b, held in zip(CELLS, low, high, (lang, source, sizes), strict=True) if held is not None]


def shards_of_box(spark: SparkSession, path: str, lang: str | None = None, source: str | None = None, sizes: tuple[int, int] | None = None) -> list[int]:
    """Shards whose ranges of cells meet the box; of the manifest these numbers go to the driver."""
    meets = F.lit(True)
    for c, a, b in _box(lang, source, sizes):
        meets &= (F.col(f"most_{c}") >= a) & (F.col(f"least_{c}") <= b)
    return sorted(r["shard"] for r in spark.read.parquet(f"{path}/manifest").where(meets).select("shard").collect())


def read_box(spark: SparkSession, path: str, lang: str | None = None, source: str | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rows of write_shards() with this language, source and size (both ends included); None: any.

    Only shards whose ranges of cells meet the box are read, and of these only row groups that do.
    """
    rows = spark.read.parquet(f"{path}/rows").where(F.col("shard").isin(shards_of_box(spark, path, lang, source, sizes)))
    for c, a, b in _box(lang, source, sizes):
        rows = rows.where(F.col(c).between(a, b))
    for name, value in (("lang", lang), ("source", source)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.where(F.col("size").between(*sizes)) if sizes else rows
