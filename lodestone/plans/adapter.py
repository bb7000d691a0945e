"""The star-schema test tables, relabelled as an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.catalog import Catalog

STEP = 1_000_000_000_000  #: entry ids of nations, customers, orders and lines start at multiples of it


def _key(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col)).cast("binary")


def archive(spark: SparkSession, sf_dir: str) -> Catalog:
    """region > nation > customer > order directories with lines as files; orders as branches; nations as origins."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    no_ids = F.array().cast("array<bigint>")
    entry = lambda k, col: (F.lit(k * STEP) + F.col(col)).cast("bigint")

    def lists(child: DataFrame, k: int, col: str, parent: str):
        return child.groupBy(F.col(parent).alias("p")).agg(F.collect_list(entry(k, col)).alias("ids"))

    def level(df, key, prefix, child, files=False):
        got = df.select(F.col(key).alias("p")).join(child, "p", "left").select(_key(prefix, "p").alias("id"), F.coalesce("ids", no_ids).alias("ids"))
        return got.select("id", F.col("ids").alias("file_entries"), no_ids.alias("dir_entries")) if files else got.select("id", F.lit(None).cast("array<bigint>").alias("file_entries"), F.col("ids").alias("dir_entries"))

    line_id = (F.lit(4 * STEP) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint")
    lines = t["lineitem"].groupBy(F.col("l_orderkey").alias("p")).agg(F.collect_list(line_id).alias("ids"))
    directory = level(t["region"], "r_regionkey", "r", lists(t["nation"], 1, "n_nationkey", "n_regionkey")).unionByName(level(t["nation"], "n_nationkey", "n", lists(t["customer"], 2, "c_custkey", "c_nationkey"))).unionByName(level(t["customer"], "c_custkey", "c", lists(t["orders"], 3, "o_orderkey", "o_custkey"))).unionByName(level(t["orders"], "o_orderkey", "o", lines, files=True))
    dirs = [t["nation"].select(entry(1, "n_nationkey").alias("id"), F.col("n_name").cast("binary").alias("name"), _key("n", "n_nationkey").alias("target")), t["customer"].select(entry(2, "c_custkey").alias("id"), F.col("c_name").cast("binary").alias("name"), _key("c", "c_custkey").alias("target")), t["orders"].select(entry(3, "o_orderkey").alias("id"), _key("o", "o_orderkey").alias("name"), _key("o", "o_orderkey").alias("target"))]
    suffix = F.when(F.col("l_returnflag") == "A", ".py").when(F.col("l_returnflag") == "N", ".js").otherwise(".md")
    files = t["lineitem"].select(line_id.alias("id"), F.concat(F.lit("l"), F.col("l_linenumber"), suffix).cast("binary").alias("name"), _key("p", "l_partkey").alias("target"))
    content = t["part"].select(_key("p", "p_partkey").alias("sha1_git"))
    refs = F.when(F.col("o_orderpriority") == "1-URGENT", "refs/heads/main").when(F.col("o_orderpriority") == "2-HIGH", "refs/heads/master").otherwise("refs/heads/dev")
    tables = {
        "directory": directory,
        "directory_entry_dir": dirs[0].unionByName(dirs[1]).unionByName(dirs[2]),
        "directory_entry_file": files,
        "content": content.unionByName(t["part"].where("p_size <= 5").select(_key("p", "p_partkey").alias("sha1_git"))),
        "snapshot_branch": t["orders"].select(F.col("o_orderkey").alias("object_id"), refs.cast("binary").alias("name"), F.col("o_orderkey").alias("target"), F.when(F.col("o_orderstatus") == "F", "revision").otherwise("release").alias("target_type")),
        "revision": t["orders"].where("o_totalprice >= 50000").select(F.col("o_orderkey").alias("id"), _key("c", "o_custkey").alias("directory")),
        "snapshot_branches": t["orders"].select(F.col("o_orderkey").alias("branch_id"), F.col("o_custkey").alias("snapshot_id")),
        "snapshot": t["customer"].select(F.col("c_custkey").alias("object_id")),
        "origin_visit": t["customer"].where("c_mktsegment <> 'FURNITURE'").select(F.col("c_nationkey").cast("bigint").alias("origin"), F.col("c_custkey").alias("snapshot_id")).unionByName(t["supplier"].select(F.col("s_nationkey").cast("bigint").alias("origin"), F.col("s_suppkey").alias("snapshot_id"))),
        "origin": t["nation"].select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("https://host.example/"), F.lower("n_name")).alias("url"), F.lit("git").alias("type")),
    }
    return Catalog(spark, tables=tables)
