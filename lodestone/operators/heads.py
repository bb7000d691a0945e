"""Branch heads and the repositories they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans import schemas


def branch_heads(snapshot_branch: DataFrame) -> DataFrame:
    """Main and master branches that point to revisions. Filters compare raw bytes, so that they reach the scan."""
    kept = snapshot_branch.where(F.col("name").isin(*map(F.lit, schemas.REFS))).where(F.col("target_type") == "revision")
    return kept.select(F.col("object_id").alias("snapshot_id"), F.col("name").alias("branch_name"), F.col("target").alias("revision_id"))


def main_revisions(snapshot_branch: DataFrame, revision: DataFrame) -> DataFrame:
    """snapshot_id (a branch's id), revision_id, root_directory_id, branch_name; heads without a revision are left out."""
    roots = revision.select(F.col("id").alias("revision_id"), F.col("directory").alias("root_directory_id"))
    return branch_heads(snapshot_branch).join(roots, "revision_id").select("snapshot_id", "revision_id", "root_directory_id", "branch_name")


def url_chain(heads: DataFrame, snapshot_branches: DataFrame, origin_visit: DataFrame, origin: DataFrame) -> DataFrame:
    """heads with actual_snapshot_id, origin_id, repo_url and origin_type, by left joins.

    Every visit of a snapshot gives a row. The snapshot table adds no column and could only repeat
    rows that the choice of one row a head removes again; it is not read.
    """
    to_snapshot = snapshot_branches.select(F.col("branch_id").alias("snapshot_id"), F.col("snapshot_id").alias("actual_snapshot_id"))
    visits = origin_visit.select(F.col("snapshot_id").alias("actual_snapshot_id"), F.col("origin").alias("origin_id"))
    origins = origin.select(F.col("id").alias("origin_id"), F.col("url").alias("repo_url"), F.col("type").alias("origin_type"))
    out = heads.join(to_snapshot, "snapshot_id", "left").join(visits, "actual_snapshot_id", "left").join(origins, "origin_id", "left")
    return out.select(*heads.columns, "actual_snapshot_id", "origin_id", "repo_url", "origin_type")


def one_url(chain: DataFrame) -> DataFrame:
    """One row for each root directory and branch id: the smallest URL that is not null, then the smallest ids.

    An aggregate, combined before it moves: a head with very many visits is no burden to one task.
    """
    keys = ["root_directory_id", "snapshot_id"]
    rest = ["repo_url", "origin_id", "revision_id", "branch_name", "actual_snapshot_id", "origin_type"]
    order = F.struct(F.col("repo_url").isNull(), *(x for c in rest for x in (F.col(c).isNull(), F.col(c))))
    best = chain.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b"))
    return best.select("snapshot_id", F.col("b.revision_id").alias("revision_id"), "root_directory_id", F.col("b.branch_name").alias("branch_name"), *(F.col(f"b.{c}").alias(c) for c in ("actual_snapshot_id", "origin_id", "repo_url", "origin_type")))


def add_repo_urls(heads: DataFrame, snapshot_branches: DataFrame, origin_visit: DataFrame, origin: DataFrame) -> DataFrame:
    """one_url(url_chain(..)), but only what heads ask for meets anything.

    Branch rows are reduced to the heads', visits to those of their snapshots, origins to those
    visited, all by semi-joins (Spark broadcasts a small side, or filters scans by Bloom filters of
    it); then each snapshot's visits are reduced to the one that can win before heads meet them.
    heads is read twice: settle it if it is dear.
    """
    order = [x for c in ("url", "origin", "type") for x in (F.col(c).isNull(), F.col(c))]
    asked = heads.select("snapshot_id").distinct()
    to_snapshot = snapshot_branches.select(F.col("branch_id").alias("snapshot_id"), F.col("snapshot_id").alias("actual_snapshot_id")).join(asked, "snapshot_id", "left_semi")
    wanted = to_snapshot.select(F.col("actual_snapshot_id").alias("snapshot_id")).distinct()
    visits = origin_visit.select("origin", "snapshot_id").join(wanted, "snapshot_id", "left_semi").distinct()
    origins = origin.select(F.col("id").alias("origin"), "url", "type").join(visits.select("origin").distinct(), "origin", "left_semi")
    best = visits.join(origins, "origin", "left").groupBy("snapshot_id").agg(F.min_by(F.struct("origin", "url", "type"), F.struct(*order)).alias("v"))
    best = best.select(F.col("snapshot_id").alias("actual_snapshot_id"), F.col("v.origin").alias("origin_id"), F.col("v.url").alias("repo_url"), F.col("v.type").alias("origin_type"))
    return one_url(heads.join(to_snapshot, "snapshot_id", "left").join(best, "actual_snapshot_id", "left"))


def url_coverage(repos: DataFrame) -> DataFrame:
    return repos.agg(F.count_if(F.col("repo_url").isNotNull()).alias("with_url"), F.count("*").alias("total"))


__all__ = ["add_repo_urls", "branch_heads", "main_revisions", "one_url", "url_chain", "url_coverage"]
