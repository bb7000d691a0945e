"""Directory graphs expanded into flat lists of files, level by level for all roots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import path_join, utf8_replace
from lodestone.sources.storage import bucketed, forget, settle, stored_bytes

MAX_DEPTH = 256
SEVERAL = 1 << 20  #: hashes with several content rows that go to all tasks; if there are more, files move to meet them
HOT, SMALL = 1000, 1 << 25  #: a directory is hot if more than one in so many ways lead to it; bytes that one task can hold


class TooDeep(RuntimeError):
    """Directories nest deeper than allowed."""


class Cycle(TooDeep):
    """A directory contains itself."""


def decoded(df: DataFrame, name: str = "name") -> Column:
    """A name as text, whether the table has bytes or strings."""
    return utf8_replace(F.col(name)) if isinstance(df.schema[name].dataType, T.BinaryType) else F.col(name)


def unique_directories(directory: DataFrame) -> DataFrame:
    """Directories with equal ids are one."""
    return directory.select("id", "file_entries", "dir_entries").dropDuplicates(["id"])


def _edges(directory: DataFrame, entries: DataFrame, listed: str) -> DataFrame:
    """directory, name, target: a list's ids count once, an entry's rows each; null and empty lists have none."""
    ids = directory.select(F.col("id").alias("directory"), F.explode(F.array_distinct(listed)).alias("entry"))
    rows = entries.select(F.col("id").alias("entry"), decoded(entries).alias("name"), "target")
    return ids.join(rows, "entry").select("directory", "name", "target")


def file_edges(directory: DataFrame, entry_file: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Files of each directory; with content, a file's row comes once for each content row of its hash, and once without any."""
    out = _edges(directory, entry_file, "file_entries")
    if content is not None:
        several = content.groupBy(F.col("sha1_git").alias("target")).agg(F.count("*").cast("int").alias("times")).where("times > 1")
        if several.limit(SEVERAL + 1).count() <= SEVERAL:
            several = F.broadcast(several)
        out = out.join(several, "target", "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    return out.select("directory", "name", "target")


def dir_edges(directory: DataFrame, entry_dir: DataFrame) -> DataFrame:
    return _edges(directory, entry_dir, "dir_entries")


def edges_table(edges: DataFrame, buckets: int | None = None) -> DataFrame:
    """directory, step, next: edges dealt by their directory once, so that levels of a walk don't move them again."""
    return bucketed(edges.select("directory", F.col("name").alias("step"), F.col("target").alias("next")), "directory", buckets)


def _down(level: DataFrame, edges: DataFrame) -> DataFrame:
    """The next level's ways; looped: where a way comes back to a directory that it has been to."""
    looped = F.array_contains("trail", F.col("next"))
    return level.join(edges, "directory").select("root", F.col("next").alias("directory"), path_join(F.col("prefix"), F.col("step")).alias("prefix"), F.when(looped, F.concat(F.slice("trail", F.array_position("trail", F.col("next")).cast("int"), F.size("trail")), F.array("next"))).alias("looped"), F.concat("trail", F.array("next")).alias("trail"))


def step_down(level: DataFrame, edges: DataFrame) -> DataFrame:
    """_down, settled: only ways move, not edges; ways to a hot directory stay, and meet its edges where they are (if these are small)."""
    size = stored_bytes(level)
    if size is not None and size >= SMALL:
        total = level.count()
        hot = settle(level.groupBy("directory").agg(F.count("*").alias("ways")).where(F.col("ways") * HOT > total).select("directory"))
        few = settle(edges.join(F.broadcast(hot), "directory", "left_semi"))  # at most HOT directories
        if (stored_bytes(few) or 0) < SMALL:
            hot = F.broadcast(hot)
            stay, rest = level.join(hot, "directory", "left_semi"), level.join(hot, "directory", "left_anti")
            return settle(_down(stay, F.broadcast(few)).unionByName(_down(rest, edges)))
    return settle(_down(level, edges))


def walk(roots: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """root, directory, prefix: every way from each distinct root down to every directory below it.

    One join a level. Edges are a bucketed table, dealt once; the frontier is settled each level,
    to see whether it is empty. A directory that several ways reach has a row for each. A way
    carries the directories that it has been to, so a cycle ends the walk in as many levels as it
    is long, whatever max_depth allows, with its directories in the error. Tables are settled: call it in a scope.
    """
    spark, kind = roots.sparkSession, edges.schema["directory"].dataType
    shown = (lambda c: F.lower(F.hex(c))) if isinstance(kind, T.BinaryType) else (lambda c: c.cast("string"))
    edges = edges_table(edges)
    first = roots.select(F.col("root_directory_id").alias("root")).where("root is not null").distinct()
    level = settle(first.select("root", F.col("root").alias("directory"), F.lit("").alias("prefix"), F.lit(None).cast(T.ArrayType(kind)).alias("looped"), F.array("root").alias("trail")))
    levels, ways = [level], level.count()
    while ways:
        if len(levels) > max_depth:
            raise TooDeep(f"directories nest deeper than {max_depth}")
        level = step_down(level, edges)
        levels.append(level)
        ways, loop = level.agg(F.count("*"), F.min(F.concat_ws(" > ", F.transform("looped", shown)))).first()
        if loop:
            raise Cycle(f"directories that contain each other: {loop}")
    forget(edges)
    return spark.read.schema(level.schema).parquet(*[x._settled_at for x in levels]).select("root", "directory", "prefix")


def files_below(roots: DataFrame, directory: DataFrame, entry_file: DataFrame, entry_dir: DataFrame, content: DataFrame | None = None, recursive: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """root, path, name, sha1_git for every file below each distinct root_directory_id of roots.

    A bag: shared directories give their files once for each way. Directories that are missing
    give nothing. recursive=False: only files that lie in a root itself.
    """
    ways, files = _ways_and_files(roots, directory, entry_file, entry_dir, content, recursive, max_depth)
    return ways.join(files, "directory").select("root", path_join(F.col("prefix"), F.col("name")).alias("path"), "name", F.col("target").alias("sha1_git"))


def _ways_and_files(roots: DataFrame, directory: DataFrame, entry_file: DataFrame, entry_dir: DataFrame, content: DataFrame | None, recursive: bool, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Ways (root, directory, prefix) and, of the directories that they reach, the files (directory, name, target); directories with empty lists are left out first."""
    if recursive:
        ways = walk(roots, dir_edges(unique_directories(directory.where(F.size("dir_entries") > 0)), entry_dir), max_depth)
    else:
        ways = roots.select(F.col("root_directory_id").alias("root")).where("root is not null").distinct().select("root", F.col("root").alias("directory"), F.lit("").alias("prefix"))
    reached = directory.where(F.size("file_entries") > 0).join(ways.select(F.col("directory").alias("id")).distinct(), "id", "left_semi")  # before any list is spread
    return ways, file_edges(unique_directories(reached), entry_file, content)


def repo_files_below(repos: DataFrame, directory: DataFrame, entry_file: DataFrame, entry_dir: DataFrame, content: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """repo_files(repos, files_below(repos, ...)): ways meet their repositories before files meet ways, so files move once less. Settle repos: it is read twice."""
    ways, files = _ways_and_files(repos, directory, entry_file, entry_dir, content, True, max_depth)
    own = repos.select(F.col("root_directory_id").alias("root"), "repo_url").join(ways, "root").select("repo_url", "directory", "prefix")
    return own.join(files, "directory").select(path_join(F.col("prefix"), F.col("name")).alias("path"), "name", F.col("target").alias("sha1_git"), "repo_url")


def repo_files(repos: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, sha1_git, repo_url: the files of each repository row; equal rows of repos give their files each."""
    return repos.select(F.col("root_directory_id").alias("root"), "repo_url").join(files, "root").select("path", "name", "sha1_git", "repo_url")


RECURSIVE_SQL = """
WITH RECURSIVE walk (root, directory, prefix, depth) MAX RECURSION LEVEL {max_depth} AS (
  SELECT root_directory_id, root_directory_id, '', 0 FROM (SELECT DISTINCT root_directory_id FROM {roots} WHERE root_directory_id IS NOT NULL)
  UNION ALL
  SELECT w.root, e.target, CASE WHEN w.prefix = '' THEN e.name ELSE concat(w.prefix, '/', e.name) END, w.depth + 1
  FROM walk w JOIN {edges} e ON w.directory = e.directory)
SELECT root, directory, prefix FROM walk
"""


def walk_sql(roots: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """walk() as one recursive query; for small graphs, as the session's recursion limits allow."""
    return roots.sparkSession.sql(RECURSIVE_SQL.format(roots="{roots}", edges="{edges}", max_depth=max_depth), roots=roots, edges=edges)
