"""Tables that grow by whole versions: appended, never changed, compacted when asked.

A version is a folder of parquet files that Spark's committer writes. Its number is claimed first, by
a file that only one writer can make; the mark that it is whole comes last. Readers see marked
versions only, so a killed task or driver leaves nothing half done, and no rename is needed, which
object stores don't have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources import storage

DONE, CLAIMS = "_DONE", "_claims"


class Versions:
    """place/v=N holds what version N appended, place/base=N all rows up to N, rewritten."""

    def __init__(self, spark: SparkSession, place: str, schema: T.StructType):
        self.spark, self.place, self.schema = spark, place.rstrip("/"), schema
        self.whole = T.StructType([*schema.fields, T.StructField("version", T.LongType())])

    def _folders(self) -> tuple[list[int], list[int]]:
        """Numbers of the marked bases and versions."""
        found: dict[str, list[int]] = {"base": [], "v": []}
        for name in storage.names(self.spark, self.place):
            kind, _, number = name.partition("=")
            if kind in found and number.isdigit() and storage.exists(self.spark, f"{self.place}/{name}/{DONE}"):
                found[kind].append(int(number))
        return sorted(found["base"]), sorted(found["v"])

    def live(self) -> list[str]:
        """Folders whose rows count: the last base, and the versions after it."""
        bases, versions = self._folders()
        base = bases[-1:]
        return [f"base={n:010d}" for n in base] + [f"v={n:010d}" for n in versions if not base or n > base[0]]

    def last(self) -> int:
        """The number of the last whole version; 0 if there is none."""
        bases, versions = self._folders()
        return max([0, *bases, *versions])

    def _claim(self) -> int:
        """A number that no other writer has, greater than every number so far."""
        taken = [int(n) for n in storage.names(self.spark, f"{self.place}/{CLAIMS}") if n.isdigit()]
        number = max([self.last(), *taken]) + 1
        while not storage.create_new(self.spark, f"{self.place}/{CLAIMS}/{number:010d}"):
            number += 1
        return number

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.place}/{folder}")
        storage.touch(self.spark, f"{self.place}/{folder}/{DONE}")

    def append(self, rows: DataFrame) -> int:
        """Write rows, in one job, as the next version; its number."""
        number = self._claim()
        self._write(rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn("version", F.lit(number).cast("long")), f"v={number:010d}")
        return number

    def read(self, since: int = 0) -> DataFrame:
        """All rows, with the version that each came with; only those of versions after since."""
        folders = self.live()
        if not folders:
            return self.spark.createDataFrame([], self.whole)
        rows = self.spark.read.schema(self.whole).parquet(*(f"{self.place}/{f}" for f in folders))
        return rows.where(F.col("version") > since) if since else rows

    def compact(self, keep: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrite all rows as keep() has them into one base, then delete what it replaces; run it while nothing reads.

        Rows keep the version that they came with. Breaking off before the end leaves a table that reads the same.
        """
        last, before = self.last(), self.live()
        if not before or before == [f"base={last:010d}"]:
            return last
        self._write(keep(self.read()).select(*self.whole.names), f"base={last:010d}")
        for name in storage.names(self.spark, self.place):
            kind, _, number = name.partition("=")
            if kind in ("base", "v") and number.isdigit() and (int(number) < last or int(number) == last and kind == "v"):
                storage.delete(self.spark, f"{self.place}/{name}")
        return last
