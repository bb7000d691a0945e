"""The two commands: parse (file metadata from the archive's tables) and download (contents)."""

from __future__ import annotations

import logging
import logging.handlers
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import fetch, heads, select, tree
from lodestone.operators.outcomes import OutcomeLog, skipped
from lodestone.plans import schemas
from lodestone.plans.config import Config
from lodestone.sources.catalog import Catalog, dataset_place, source_uri
from lodestone.sources.storage import exists, scope, settle
from lodestone.sources.versions import Versions

log = logging.getLogger("lodestone")


@contextmanager
def timer(name: str):
    """Log how long a block took, even if it raised."""
    start = time.perf_counter()
    log.info("%s...", name)
    try:
        yield
    finally:
        log.info("%s took %.2fs", name, time.perf_counter() - start)


def setup_logging(folder: Path) -> None:
    """Console from INFO, a file from DEBUG that rotates at 10 MB."""
    folder.mkdir(parents=True, exist_ok=True)
    log.setLevel(logging.DEBUG)
    for old in list(log.handlers):
        log.removeHandler(old)
    console, file = logging.StreamHandler(), logging.handlers.RotatingFileHandler(folder / "lodestone.log", maxBytes=10_000_000, backupCount=5)
    console.setLevel(logging.INFO)
    for h in (console, file):
        h.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(name)s:%(lineno)d - %(message)s"))
        log.addHandler(h)


class Counts:
    """Row counts that a plan's own jobs gather on the way (a retried task may count twice)."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def of(self, df: DataFrame, name: str, **more) -> DataFrame:
        """df, counted as name when it is first computed."""
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in more.items()))

    def get(self, name: str) -> dict[str, int]:
        """The metrics of name; only after a job over it has ended."""
        return self.seen[name].get


def file_metadata(catalog: Catalog, max_depth: int = tree.MAX_DEPTH, batch_size: int | None = None, counts: Counts | None = None) -> DataFrame:
    """Heads, their repositories' URLs and all files below their roots, in one pipeline. Null URLs stay null.

    batch_size: repositories a task starts with (as far as that makes no more than MOST_TASKS); it changes only how work is dealt.
    counts: gathers heads, repositories (with_url) and files. Settles tables: call it in a scope.
    """
    counts = counts or Counts()
    revisions = counts.of(heads.main_revisions(catalog[schemas.SNAPSHOT_BRANCH], catalog[schemas.REVISION]), "heads")
    repos = heads.add_repo_urls(settle(revisions), catalog[schemas.SNAPSHOT_BRANCHES], catalog[schemas.ORIGIN_VISIT], catalog[schemas.ORIGIN])
    repos = settle(counts.of(repos, "repositories", with_url=F.count("repo_url")))
    if batch_size:
        repos = repos.repartition(min(MOST_TASKS, max(1, -(-counts.get("repositories")["rows"] // batch_size))), "root_directory_id")
    files = tree.repo_files_below(repos, catalog[schemas.DIRECTORY], catalog[schemas.ENTRY_FILE], catalog[schemas.ENTRY_DIR], catalog[schemas.CONTENT], max_depth)
    return counts.of(files, "files")


MOST_TASKS = 10_000


def prepare_dataset(spark: SparkSession, config: Config, catalog: Catalog | None = None) -> str:
    """Write the file metadata table; returns its path."""
    log.info("Configuration: %s", config.shown())
    places, s3 = config.layout(), config.s3_dataset
    if catalog is None:
        source = source_uri(s3.s3_url, s3.dataset_name) if s3.auto_download else None
        catalog = Catalog(spark, dataset_place(spark, places.tables, source, s3.in_place, s3.parallelism)).load()
    counts = Counts()
    with scope(spark):
        write_metadata(file_metadata(catalog, batch_size=config.batch.batch_size, counts=counts), places.metadata)
    log.info("Found %d main branch heads", counts.get("heads")["rows"])
    log.info("Found URLs for %d of %d repositories", counts.get("repositories")["with_url"], counts.get("repositories")["rows"])
    log.info("Found %d files", counts.get("files")["rows"])
    log.info("Saved file metadata to %s", places.metadata)
    return places.metadata


def write_metadata(files: DataFrame, path: str) -> None:
    files.select(*(files[f.name].cast(f.dataType) for f in schemas.FILE_METADATA)).write.mode("overwrite").parquet(path)


def content_table(spark: SparkSession, place: str) -> Versions:
    """Contents by hash: sha1_git, success, size, status, error_message, content; a version for each wave."""
    return Versions(spark, f"{place}/table", schemas.CONTENTS)


def read_contents(spark: SparkSession, place: str) -> DataFrame:
    """sha1_git, size, content of every hash that was fetched; a row each, unless two runs met."""
    return content_table(spark, place).read().where("success").select("sha1_git", "size", "content")


def _waves(rows: DataFrame, key: str, size: int) -> list[DataFrame]:
    """rows in parts of about size, rows of one key together."""
    n = max(1, -(-rows.count() // size))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == w) for w in range(n)] if n > 1 else [rows]


def _to_files(spark: SparkSession, wanted: DataFrame, base: str, history: OutcomeLog, config: Config, tasks: int, fetcher) -> DataFrame:
    known = wanted.join(history.fetched().select("target", "size"), "target")
    known = settle(fetch.still_there(known.select("sha1_git", "target", "size")))
    fresh = settle(wanted.join(known.select("target").distinct(), "target", "left_anti"))  # null targets match none
    before = history.last()
    for wave in _waves(fresh, "target", config.swh_api.wave) if not fresh.isEmpty() else []:
        history.append(fetch.fetch_targets(wave, base, config.swh_api, tasks=tasks, fetcher=fetcher))
    return skipped(known).unionByName(history.read(since=before).select(*schemas.DOWNLOAD_STATS.names))


def _to_table(spark: SparkSession, wanted: DataFrame, place: str, history: OutcomeLog, config: Config, tasks: int, fetcher) -> DataFrame:
    """Each hash is asked for once, whatever paths it has; contents and outcomes are one write."""
    table = content_table(spark, place)
    have = settle(table.read().where("success").groupBy("sha1_git").agg(F.max("size").alias("size")))
    known = wanted.join(have, "sha1_git").select("sha1_git", "target", "size")
    fresh = settle(wanted.join(have, "sha1_git", "left_anti"))
    before = history.last()
    for wave in _waves(settle(fresh.select("sha1_git").where("sha1_git is not null").distinct()), "sha1_git", config.swh_api.wave) if not fresh.isEmpty() else []:
        number = table.append(fetch.fetch_contents(wave, config.swh_api, tasks, fetcher))
        got = table.read(since=number - 1).where(F.col("version") == number).drop("content")
        rows = fresh.join(got, "sha1_git").select("target", "sha1_git", F.when(F.col("success"), F.concat(F.lit(f"{table.place}#"), "sha1_git")).alias("local_path"), "success", "size", "status", "error_message")
        history.append(rows)
    nameless = fresh.where("sha1_git is null").select("target", "sha1_git", F.lit(None).cast("string").alias("local_path"), F.lit(False).alias("success"), F.lit(0).cast("long").alias("size"), F.lit("unknown_error").alias("status"), F.lit("no hash").alias("error_message"))
    if not nameless.isEmpty():
        history.append(nameless)
    out = skipped(known).withColumn("local_path", F.concat(F.lit(f"{table.place}#"), "sha1_git"))
    return out.unionByName(history.read(since=before).select(*schemas.DOWNLOAD_STATS.names))


def download_data(spark: SparkSession, config: Config, tasks: int = 1, fetcher=fetch.Fetcher) -> str | None:
    """Fetch the selected files that no earlier run has fetched, and write an outcome for each selected one; None (and a warning) before parse has run.

    What is fetched is kept wave by wave: a run that breaks off loses at most one, and the next one
    asks for the rest. A file that was fetched and is gone from its folder is fetched again.
    """
    places = config.layout()
    if not exists(spark, places.metadata):
        log.warning("There is no %s; run parse first", places.metadata)
        return None
    files = select.hex_ids(spark.read.schema(schemas.FILE_METADATA).parquet(places.metadata))
    chosen = select.select_files(files, config.processing.file_extensions, config.processing.file_patterns)
    out, counts, history = places.outcomes, Counts(), OutcomeLog(spark, places.history)
    as_table = config.swh_api.store == "table" or config.swh_api.store == "auto" and not fetch.mounted(places.contents)
    base = places.contents if as_table else fetch.local_folder(places.contents)
    with scope(spark):
        wanted = settle(counts.of(fetch.targets(chosen, base, config.swh_api.max_files), "selected"))
        log.info("Selected %d files", counts.get("selected")["rows"])
        stats = (_to_table if as_table else _to_files)(spark, wanted, base, history, config, tasks, fetcher)
        stats.write.mode("overwrite").parquet(out)
    done = fetch.summary(spark.read.schema(schemas.DOWNLOAD_STATS).parquet(out)).first()
    log.info("Download complete: %d total, %d downloaded, %d skipped, %d failed", *done)
    return out
