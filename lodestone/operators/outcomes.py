"""What earlier runs have fetched: an append-only log of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans import schemas
from lodestone.sources.versions import Versions

OUTCOME = T.StructType([T.StructField("target", T.StringType()), *schemas.DOWNLOAD_STATS.fields])


def latest(rows: DataFrame) -> DataFrame:
    """The last outcome of each target (null is a target): of the greatest version, there a success before a failure, then the greatest values."""
    kept = [c for c in rows.columns if c != "target"]
    order = F.struct("version", "success", *(c for c in kept if c not in ("version", "success")))
    return rows.groupBy("target").agg(F.max_by(F.struct(*kept), order).alias("o")).select("target", "o.*").select(*rows.columns)


def fetched(rows: DataFrame) -> DataFrame:
    """The last success of each target that has one: what a later run needn't ask for again."""
    return latest(rows.where("success and target is not null"))


class OutcomeLog(Versions):
    """A version for each wave of a run. Minima and maxima are combined before rows move, so a target of very many outcomes is no burden."""

    def __init__(self, spark: SparkSession, place: str):
        super().__init__(spark, place, OUTCOME)

    def latest(self) -> DataFrame:
        return latest(self.read())

    def fetched(self) -> DataFrame:
        return fetched(self.read())

    def compact(self) -> int:
        """Leave of each target its last outcome and, if that is a failure, its last success."""

        def keep(rows: DataFrame) -> DataFrame:
            return latest(rows).unionByName(fetched(rows)).distinct()

        return super().compact(keep)


def skipped(known: DataFrame) -> DataFrame:
    """Outcomes (as DOWNLOAD_STATS) of rows sha1_git, target, size that needn't be fetched."""
    return known.select("sha1_git", F.col("target").alias("local_path"), F.lit(True).alias("success"), "size", F.lit("skipped_already_exists").alias("status"), F.lit("File already exists").alias("error_message"))
