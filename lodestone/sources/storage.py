"""Tables cut off from their lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """Executors on other machines would write to their own disks."""


#: Paths of the tables that the innermost open scope will delete.
_open: ContextVar[list[str] | None] = ContextVar("lodestone_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a folder of our own on this machine, if the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines share; the master is {master}")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder; removed at the end of the open scope, or else when the session's JVM ends."""
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    if (held := _open.get()) is not None:
        held.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Whatever is settled in the block is deleted after it: write what is to stay within it."""
    held: list[str] = []
    token = _open.set(held)
    try:
        yield
    finally:
        _open.reset(token)
        for path in held:
            _drop(spark, path)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, settled; all other tables that it settled are deleted."""
    path = new_path(spark)
    with scope(spark):
        df = make()
        _write(df, path)
    return _read(spark, df, path)


#: Whether shuffle files go with the query that wrote them, and not only with the driver's next full collection.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def _read(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file at path."""
    fs, at = _hadoop(spark, path)
    fs.create(at, True).close()


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already."""
    fs, at = _hadoop(spark, path)
    if fs.exists(at):
        return False
    try:
        fs.create(at, False).close()
    except Exception as e:
        if "AlreadyExists" in str(e) or fs.exists(at):
            return False
        raise
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    fs, at = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at path."""
    fs, at = _hadoop(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    if not exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession)
    _write(df, path)
    return _read(df.sparkSession, df, path)


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of a settled table's files, without a job; None: df is not one."""
    path = getattr(df, "_settled_at", None)
    if path is None:
        return None
    fs, at = _hadoop(df.sparkSession, path)
    return fs.getContentSummary(at).getLength()


def _bucket_name(path: str) -> str:
    """The catalog's name of the bucketed table at path."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


def _drop(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_bucket_name(path)}")
    delete(spark, path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None, deal: bool = True) -> DataFrame:
    """Settle df as a table of the session's catalog, its rows dealt and sorted by key: joins on key move only the other side.

    deal=False: each task writes its own rows to their buckets and nothing moves, for keys of which a task has few.
    """
    spark = df.sparkSession
    path, n = new_path(spark), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key) if deal else df).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(_bucket_name(path))
    out = spark.table(_bucket_name(path))
    out._settled_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            _drop(df.sparkSession, path)
