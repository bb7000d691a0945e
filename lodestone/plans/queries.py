"""One query for each operator on the relabelled test tables, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import fetch, heads, select, tree
from lodestone.operators.outcomes import OutcomeLog
from lodestone.plans.adapter import archive
from lodestone.plans.config import ApiConfig
from lodestone.plans.prepare import write_metadata
from lodestone.sources import storage

QUERIES, ORACLES = {}, {}


def _query(oracle: str | None = None, settles: bool = False):
    """Register a query and its SQL. settles: tables that it settles go when its own rows are written."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: storage.alone(spark, lambda: f(spark, sf_dir))) if settles else f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _s(name: str, to: str | None = None):
    return F.col(name).cast("string").alias(to or name)


# What the archive's tables are in the test tables' terms.
_HEADS = "SELECT o_orderkey AS snapshot_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'refs/heads/main' ELSE 'refs/heads/master' END AS branch_name, o_orderkey AS revision_id, 'c' || o_custkey AS root_directory_id, o_custkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'"
_REVISIONS = f"SELECT * FROM ({_HEADS}) WHERE o_totalprice >= 50000"
_VISITS = "SELECT c_custkey AS snapshot_id, c_nationkey AS origin FROM customer WHERE c_mktsegment <> 'FURNITURE' UNION ALL SELECT s_suppkey, s_nationkey FROM supplier"
_CHAIN = f"SELECT h.snapshot_id, h.revision_id, h.root_directory_id, h.branch_name, h.o_custkey AS actual_snapshot_id, v.origin AS origin_id, CASE WHEN n_nationkey IS NULL THEN NULL ELSE 'https://host.example/' || lower(n_name) END AS repo_url, CASE WHEN n_nationkey IS NULL THEN NULL ELSE 'git' END AS origin_type FROM ({_REVISIONS}) h LEFT JOIN ({_VISITS}) v ON h.o_custkey = v.snapshot_id LEFT JOIN nation ON v.origin = n_nationkey"
_REPOS = f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY root_directory_id, snapshot_id ORDER BY repo_url ASC NULLS LAST, origin_id ASC NULLS LAST) AS k FROM ({_CHAIN})) WHERE k = 1"
_NAME = "'l' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '.py' WHEN 'N' THEN '.js' ELSE '.md' END"
_COPIES = "SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_size <= 5"
_BELOW_CUSTOMER = f"SELECT 'c' || o_custkey AS root, 'o' || o_orderkey || '/' || {_NAME} AS path, {_NAME} AS name, 'p' || l_partkey AS sha1_git FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN ({_COPIES}) k ON p_partkey = l_partkey"
_REPO_FILES = f"SELECT f.path, f.name, f.sha1_git, r.repo_url FROM ({_REPOS}) r JOIN ({_BELOW_CUSTOMER}) f ON r.root_directory_id = f.root"
_NAMES = f"SELECT {_NAME} AS name, l_orderkey, l_linenumber FROM lineitem"


def _repos(c) -> DataFrame:
    return heads.add_repo_urls(heads.main_revisions(c["snapshot_branch"], c["revision"]), c["snapshot_branches"], c["origin_visit"], c["origin"])


def _repo_files(c) -> DataFrame:
    repos = storage.settle(_repos(c))
    return tree.repo_files_below(repos, c["directory"], c["directory_entry_file"], c["directory_entry_dir"], c["content"])


def _names(c) -> DataFrame:
    return c["directory_entry_file"].select(tree.decoded(c["directory_entry_file"]).alias("name"), (F.col("id") - 4_000_000_000_000).alias("k")).select("name", F.expr("(k - 1) div 8").alias("l_orderkey"), ((F.col("k") - 1) % 8 + 1).cast("int").alias("l_linenumber"))


@_query("SELECT o_orderkey AS object_id, CASE o_orderstatus WHEN 'F' THEN 'revision' ELSE 'release' END AS target_type FROM orders")
def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir)["snapshot_branch"].select("object_id", "target_type")


@_query(f"SELECT snapshot_id, branch_name, revision_id FROM ({_HEADS})")
def branch_head_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.branch_heads(archive(spark, sf_dir)["snapshot_branch"]).select("snapshot_id", _s("branch_name"), "revision_id")


@_query(f"SELECT snapshot_id, revision_id, root_directory_id, branch_name FROM ({_REVISIONS})")
def main_revision_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)
    return heads.main_revisions(c["snapshot_branch"], c["revision"]).select("snapshot_id", "revision_id", _s("root_directory_id"), _s("branch_name"))


def _texts(df: DataFrame) -> DataFrame:
    return df.select("snapshot_id", "revision_id", _s("root_directory_id"), _s("branch_name"), "actual_snapshot_id", "origin_id", "repo_url", "origin_type")


@_query(_CHAIN)
def repo_url_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)
    return _texts(heads.url_chain(heads.main_revisions(c["snapshot_branch"], c["revision"]), c["snapshot_branches"], c["origin_visit"], c["origin"]))


@_query(_REPOS)
def repo_url_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(_repos(archive(spark, sf_dir)))


@_query(f"SELECT count(repo_url) AS with_url, count(*) AS total FROM ({_REPOS})")
def url_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.url_coverage(_repos(archive(spark, sf_dir)))


@_query(f"SELECT 'o' || l_orderkey AS directory, {_NAME} AS name, 'p' || l_partkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def array_membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)
    return tree.file_edges(tree.unique_directories(c["directory"]), c["directory_entry_file"]).select(_s("directory"), "name", _s("target"))


@_query("SELECT 'r' || n_regionkey AS directory, n_name AS name, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, c_name, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'o' || o_orderkey FROM orders")
def subdirectory_membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)
    return tree.dir_edges(tree.unique_directories(c["directory"]), c["directory_entry_dir"]).select(_s("directory"), "name", _s("target"))


@_query(f"SELECT 'o' || l_orderkey AS root, {_NAME} AS path, {_NAME} AS name, 'p' || l_partkey AS sha1_git FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def directory_files_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)
    roots = c["directory"].select(F.col("id").alias("root_directory_id"))
    return tree.files_below(roots, c["directory"], c["directory_entry_file"], c["directory_entry_dir"], recursive=False).select(_s("root"), "path", "name", _s("sha1_git"))


@_query(f"""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS d, n_name AS name, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || c_nationkey, c_name, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'o' || o_orderkey FROM orders),
w(root, d, prefix) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, '' FROM region UNION ALL SELECT root, e.t, CASE WHEN prefix = '' THEN e.name ELSE prefix || '/' || e.name END FROM w JOIN e ON w.d = e.d)
SELECT root, prefix || '/' || {_NAME} AS path, {_NAME} AS name, 'p' || l_partkey AS sha1_git FROM w JOIN lineitem ON w.d = 'o' || l_orderkey""", settles=True)
def directory_files_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)
    roots = c["directory"].select(F.col("id").alias("root_directory_id")).where(F.col("root_directory_id").cast("string").startswith("r"))
    return tree.files_below(roots, c["directory"], c["directory_entry_file"], c["directory_entry_dir"]).select(_s("root"), "path", "name", _s("sha1_git"))


@_query(f"SELECT 'o' || l_orderkey AS directory, {_NAME} AS name, 'p' || l_partkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN ({_COPIES}) k ON p_partkey = l_partkey")
def files_left_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)
    return tree.file_edges(tree.unique_directories(c["directory"]), c["directory_entry_file"], c["content"]).select(_s("directory"), "name", _s("target"))


@_query(_REPO_FILES, settles=True)
def repo_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repo_files(archive(spark, sf_dir)).select("path", "name", _s("sha1_git"), "repo_url")


@_query(f"SELECT repo_url, count(*) AS n_files FROM ({_REPO_FILES}) WHERE name LIKE '%.py' GROUP BY repo_url", settles=True)
def python_files_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(_repo_files(archive(spark, sf_dir)), [".py"]).groupBy("repo_url").agg(F.count("*").alias("n_files"))


@_query("SELECT p_partkey, lower(hex('p' || p_partkey)) AS sha1_git FROM part")
def hex_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.hex_ids(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("p"), "p_partkey").cast("binary").alias("sha1_git")))


@_query("SELECT c_custkey, CASE WHEN p = '' THEN c_name ELSE p || '/' || c_name END AS path FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS p FROM customer)")
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fn.path_join(prefix, F.col("c_name")).alias("path"))


@_query("SELECT page_id, 'content/' || substr(sha256(url), 1, 8) || '/a/b.py' AS target FROM pages")
def output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fn.output_path("content", F.col("url"), F.lit("a/b.py")).alias("target"))


@_query("SELECT p_partkey, 'https://api.example/content/sha1_git:' || lower(hex('p' || p_partkey)) || '/raw/' AS url FROM part")
def content_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hex_encode(spark, sf_dir).select("p_partkey", fn.content_url("https://api.example", F.col("sha1_git")).alias("url"))


@_query(f"SELECT * FROM ({_NAMES}) WHERE name LIKE '%.py'")
def filter_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(_names(archive(spark, sf_dir)), [".py"])


@_query(f"SELECT * FROM ({_NAMES}) WHERE regexp_matches(name, '(?i)^L[1-3]\\.(py|md)$')")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(_names(archive(spark, sf_dir)), [], [r"(?i)^L[1-3]\.(py|md)$"])


@_query(f"SELECT * FROM ({_NAMES}) WHERE name LIKE '%.py' OR regexp_matches(name, '^l1')")
def filter_or_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(_names(archive(spark, sf_dir)), [".py"], ["^l1"])


@_query(_NAMES)
def filter_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(_names(archive(spark, sf_dir)))


@_query("SELECT 'p' || p_partkey AS sha1_git, p_brand AS repo_url, p_name AS path FROM part ORDER BY p_brand, p_name, 'p' || p_partkey LIMIT 100")
def limit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), "p_partkey").alias("sha1_git"), F.col("p_brand").alias("repo_url"), F.col("p_name").alias("path"))
    return select.limit_files(files, 100)


@_query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders")
def download_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "skipped_already_exists").otherwise("not_found")
    return fetch.summary(spark.read.parquet(f"{sf_dir}/orders.parquet").select(status.alias("status")).withColumn("success", F.col("status") != "not_found"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 < 0.1 THEN 'critical' WHEN l_quantity / 50 < 0.3 THEN 'warning' END AS class FROM lineitem")
def rate_limit_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", fn.rate_class(F.col("l_quantity"), F.lit(50)).alias("class"))


@_query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE pow(2.0, p_size % 5 + 1) END ELSE pow(2.0, p_size % 5) END AS wait, greatest(3600.0 / p_size, 0.01) AS limiter FROM part")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "429").when(size % 3 == 1, "timeout").otherwise("network")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fn.backoff(kind, size % 5, F.when(size % 2 == 0, size)).alias("wait"), fn.limiter_wait(size).alias("limiter"))


@_query("SELECT c_custkey, c_name || chr(65533) || chr(65533) || c_mktsegment || chr(65533) AS name FROM customer")
def utf8_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.col("c_name").cast("binary"), F.lit(b"\xff\xfe"), F.col("c_mktsegment").cast("binary"), F.lit(b"\xe2\x82"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fn.utf8_replace(broken).alias("name"))


@_query(f"SELECT * FROM ({_NAMES}) WHERE regexp_matches(name, '^l[0-3]\\.[a-ik-z]{{2}}$')")
def filter_class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(_names(archive(spark, sf_dir)), [], [r"^l[\d--[4-9]]\.[a-z--j]{2}$"])


@_query(f"SELECT * FROM ({_NAMES}) WHERE regexp_matches(name, '^(l1|L2)\\.(py|md)$')")
def filter_flag_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(_names(archive(spark, sf_dir)), [], [r"(?m:^l)1(?-i)\.(?i:PY|MD)$|\AL2\.(?:py|md)\z"])


_FILES = "SELECT l_returnflag AS repo_url, 'l' || l_linenumber AS path, 'o' || l_orderkey AS sha1_git FROM lineitem"


@_query(f"SELECT * FROM ({_FILES}) ORDER BY repo_url, path, sha1_git LIMIT 25000", settles=True)
def limit_files_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many files as no one task should choose."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("repo_url"), F.concat(F.lit("l"), "l_linenumber").alias("path"), F.concat(F.lit("o"), "l_orderkey").alias("sha1_git"))
    return select.limit_files(rows, 25_000, top=0)


# Orders as outcomes of three runs: of a customer's file each.
_RUNS = "SELECT 'c' || o_custkey AS target, o_orderkey % 3 + 1 AS version, 'o' || o_orderkey AS sha1_git, o_orderstatus = 'F' AS success, o_orderkey * 7 AS size FROM orders"


def _history(spark: SparkSession, sf_dir: str) -> OutcomeLog:
    log = OutcomeLog(spark, storage.new_path(spark))
    target, done = F.concat(F.lit("c"), "o_custkey"), F.col("o_orderstatus") == "F"
    size = F.col("o_orderkey") * 7
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", target.alias("target"), F.concat(F.lit("o"), "o_orderkey").alias("sha1_git"), target.alias("local_path"), done.alias("success"), size.alias("size"), F.when(done, "success").otherwise("timeout").alias("status"), F.lit(None).cast("string").alias("error_message"))
    for run in range(3):
        log.append(rows.where(F.col("o_orderkey") % 3 == run))
        if run == 1:
            log.compact()
    return log


@_query(f"SELECT target, version, sha1_git, success, size FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY version DESC, success DESC, sha1_git DESC) = 1", settles=True)
def outcome_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).latest().select("target", "version", "sha1_git", "success", "size")


@_query(f"SELECT c_custkey, 'c' || c_custkey AS target FROM customer WHERE 'c' || c_custkey NOT IN (SELECT target FROM ({_RUNS}) WHERE success)", settles=True)
def not_yet_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run asks for: files that no run has fetched."""
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("target"))
    return wanted.join(_history(spark, sf_dir).fetched().select("target"), "target", "left_anti").select("c_custkey", "target")


class _Simulated:
    """Answers by the hash's last digit, without a network or a clock."""

    def __init__(self):
        self.now = 0.0

    def clock(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds

    def get(self, url: str, headers: dict, timeout: float):
        digit = int(url.split(":")[-1].split("/")[0][-1], 16)
        if digit == 1:
            raise TimeoutError
        if digit == 2:
            raise fetch.NetworkError("refused")
        return {3: (404, {}, b""), 4: (429, {"retry-after": "1"}, b""), 5: (500, {}, b"")}.get(digit, (200, {}, url.encode()))


def simulated(config: ApiConfig, hourly: int) -> fetch.Fetcher:
    world = _Simulated()
    return fetch.Fetcher(config, 1 << 40, world.get, world.clock, world.sleep)


_ANSWERS = "CASE p_partkey % 10 WHEN 1 THEN 'timeout' WHEN 2 THEN 'network_error' WHEN 3 THEN 'not_found' WHEN 4 THEN 'max_retries_exceeded' WHEN 5 THEN 'max_retries_exceeded' ELSE 'success' END"


@_query(f"SELECT status, count(*) AS n, CAST(sum(CASE status WHEN 'success' THEN length('{ApiConfig.base_url}/content/sha1_git:' || lower(hex('p' || p_partkey)) || '/raw/') ELSE 0 END) AS BIGINT) AS bytes FROM (SELECT p_partkey, {_ANSWERS} AS status FROM part) GROUP BY status", settles=True)
def fetch_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fetch.local_folder(storage.new_path(spark))
    files = hex_encode(spark, sf_dir).select("sha1_git", F.lit("https://host.example/r").alias("repo_url"), F.concat(F.lit("d/"), "p_partkey", F.lit(".py")).alias("path"))
    stats = fetch.fetch_files(files, base, ApiConfig(bearer_token=None, requests_per_hour=1 << 40), tasks=2, fetcher=simulated)
    return storage.settle(stats).groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@_query(_REPO_FILES)
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.plans import schemas

    path = storage.new_path(spark)  # stays: it is the result
    with storage.scope(spark):
        write_metadata(_repo_files(archive(spark, sf_dir)), path)
    return spark.read.schema(schemas.FILE_METADATA).parquet(path).select("path", "name", _s("sha1_git"), "repo_url")


HEADLINE = ("repo_url_unique", "array_membership_join", "directory_files_recursive", "repo_file_list", "python_files_per_repo", "filter_or_fold", "files_left_content", "limit_files")
