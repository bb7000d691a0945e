"""How the archive engine's plans and copies hold at scale: what moves, what is counted, what is resumed."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import heads, select, tree
from lodestone.sources import catalog, storage

ENTRY = "id bigint, name binary, target binary"


def graph(spark, pairs):
    return spark.createDataFrame([(a.encode(), f"to-{b}", b.encode()) for a, b in pairs], "directory binary, name string, target binary")


def roots(spark, *names):
    return spark.createDataFrame([(n.encode(),) for n in names], "root_directory_id binary")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_level_moves_ways_and_not_edges(spark):
    edges = tree.edges_table(graph(spark, [(f"d{i}", f"d{i * 3 % 500 + 500}") for i in range(500)]), 4)
    level = storage.settle(spark.range(400).select(F.lit(b"r").alias("root"), F.concat(F.lit("d"), "id").cast("binary").alias("directory"), F.lit("").alias("prefix"), F.array(F.lit(b"r")).alias("trail")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = tree._down(level, edges)
        assert df.count() == 400
        final = plan(df).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in final and len(re.findall(r"\bExchange hashpartitioning", final)) == 1
    assert "SelectedBucketsCount: 4 out of 4" in final or "Bucketed: true" in final
    storage.forget(edges, level)


def test_a_cycle_is_named_within_its_length(spark, monkeypatch):
    seen, step = [], tree.step_down
    monkeypatch.setattr(tree, "step_down", lambda *a: (seen.append(1), step(*a))[1])
    with pytest.raises(tree.Cycle, match="61 > 62 > 63 > 61"):
        tree.walk(roots(spark, "a", "x"), graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]), max_depth=10**6)
    assert len(seen) <= 3
    with pytest.raises(tree.Cycle, match="62 > 62"):
        tree.walk(roots(spark, "a"), graph(spark, [("a", "b"), ("b", "b")]))


def test_a_legal_depth_beyond_the_default(spark):
    chain = graph(spark, [(f"d{i}", f"d{i + 1}") for i in range(tree.MAX_DEPTH + 4)])
    with pytest.raises(tree.TooDeep, match="deeper than 3"):
        tree.walk(roots(spark, "d0"), chain, max_depth=3)
    assert tree.walk(roots(spark, f"d{tree.MAX_DEPTH - 20}"), chain).count() == 25


def test_ways_to_a_hot_directory_stay(spark, monkeypatch):
    pairs = [("r", f"m{i}") for i in range(60)] + [(f"m{i}", "hot") for i in range(60)] + [("hot", f"h{i}") for i in range(5)] + [("h1", "z")]
    want = sorted(tree.walk(roots(spark, "r"), graph(spark, pairs)).collect())
    assert len(want) == 1 + 60 + 60 + 300 + 60
    monkeypatch.setattr(tree, "SMALL", 1)
    assert sorted(tree.walk(roots(spark, "r"), graph(spark, pairs)).collect()) == want  # nothing is small: nothing is broadcast
    sizes = iter([1, 0] * 99)
    monkeypatch.setattr(tree, "stored_bytes", lambda df: next(sizes))
    assert sorted(tree.walk(roots(spark, "r"), graph(spark, pairs)).collect()) == want


def test_provenance_reduces_before_it_joins(spark):
    h = spark.createDataFrame([(1, b"r", b"d", b"m"), (2, b"r", b"e", b"m")], "snapshot_id bigint, revision_id binary, root_directory_id binary, branch_name binary")
    to = spark.createDataFrame([(1, 10), (2, 20), (9, 90)], "branch_id bigint, snapshot_id bigint")
    visit = spark.createDataFrame([(7, 10), (7, 10), (8, 20), (None, 20), (6, 90)], "origin bigint, snapshot_id bigint")
    origin = spark.createDataFrame([(7, "https://b", "git"), (6, "https://never", "git")], "id bigint, url string, type string")
    df = heads.add_repo_urls(h, to, visit, origin)
    assert {r["snapshot_id"]: r["repo_url"] for r in df.collect()} == {1: "https://b", 2: None}
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Join LeftSemi") >= 3
    # Every visit meets the heads' snapshots before any origin.
    below_visits = optimized[: optimized.index("url#")] if "url#" in optimized else optimized
    assert "LeftSemi" in below_visits or optimized.index("LeftSemi") < optimized.rindex("url#")


def test_first_rows_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["u", "v", None]), rng.choice(["p", "q", None]) if i % 3 else "same", "s" if i % 3 == 0 else str(i % 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "repo_url string, path string, sha1_git string, pos int").repartition(5)
    key = lambda r: tuple((r[c] is None, r[c] or "") for c in ("repo_url", "path", "sha1_git"))
    for n in (1, 999, 1000, 2999, 3000, 5000):
        got = select.limit_files(df, n, top=0).collect()
        assert sorted(map(key, got)) == sorted(map(key, df.collect()))[:n] and got[0].__fields__ == df.columns if got else n == 0
    assert select.limit_files(df.limit(0), 5, top=0).count() == 0
    kept = select.limit_files(df, 1500, top=0)
    assert "TakeOrdered" not in plan(kept) and kept.rdd.getNumPartitions() >= 1


def put(spark, place, names, rows=20):
    for name in names:
        spark.range(rows).select("id", F.concat(F.lit(name), "id").alias("t")).write.mode("overwrite").parquet(f"{place}/{name}")


def test_a_broken_copy_goes_on(spark, tmp_path, monkeypatch):
    source, place = str(tmp_path / "source"), str(tmp_path / "own")
    put(spark, source, (*catalog.NEEDED, "snapshot"))
    real, done = catalog.copy_table, []

    def failing(spark_, src, target, name):
        if len(done) == 4:
            # All tables are being written, so every folder is there.
            for other in catalog.NEEDED:
                os.makedirs(f"{target}/{other}/_temporary/0", exist_ok=True)
            raise OSError("gone")
        done.append(name)
        return real(spark_, src, target, name)

    monkeypatch.setattr(catalog, "copy_table", failing)
    with pytest.raises(OSError):
        catalog.dataset_place(spark, place, source, parallelism=1)
    with pytest.raises(FileNotFoundError):
        catalog.dataset_place(spark, place, None)
    again = []
    monkeypatch.setattr(catalog, "copy_table", lambda *a: (again.append(a[3]), real(*a))[1])
    written = {n: os.stat(f"{place}/{n}/_SUCCESS").st_mtime_ns for n in done}
    assert catalog.dataset_place(spark, place, source, parallelism=2) == place
    assert {n: os.stat(f"{place}/{n}/_SUCCESS").st_mtime_ns for n in done} == written  # checked ones are not copied again
    for name in (*catalog.NEEDED, "snapshot"):
        assert sorted(spark.read.parquet(f"{place}/{name}").collect()) == sorted(spark.read.parquet(f"{source}/{name}").collect())
        assert storage.read_text(spark, f"{place}/{catalog.MANIFEST}/{name}").startswith("20 ")
    assert catalog.dataset_place(spark, place, None) == place and not os.path.exists(f"{place}/{catalog.COPYING}")


def test_a_copy_that_differs_is_refused(spark, tmp_path, monkeypatch):
    source, place = str(tmp_path / "source"), str(tmp_path / "own")
    put(spark, source, ["origin"])
    real = catalog.fingerprint
    monkeypatch.setattr(catalog, "fingerprint", lambda df: [F.count(F.lit(1)).alias("rows"), F.sum(F.col("id") + (0 if df.inputFiles()[0].startswith(f"file://{source}") else 1)).cast("string").alias("hashes")])
    with pytest.raises(catalog.BrokenCopy):
        catalog.copy_table(spark, source, place, "origin")
    monkeypatch.setattr(catalog, "fingerprint", real)
    assert catalog.copy_table(spark, source, place, "origin").startswith("20 ")


def test_a_folder_with_unfinished_tables_lacks_them(spark, tmp_path):
    put(spark, str(tmp_path), catalog.NEEDED)
    assert catalog.lacking(spark, str(tmp_path)) == []
    os.makedirs(tmp_path / "origin" / "_temporary")
    os.makedirs(tmp_path / "none")
    assert catalog.lacking(spark, str(tmp_path)) == ["origin"]


def test_fingerprints_tell_tables_apart(spark):
    of = lambda rows: tuple((d := spark.createDataFrame(rows, "a long, b string")).agg(*catalog.fingerprint(d)).first())
    assert of([(1, "x"), (2, "y")]) == of([(2, "y"), (1, "x")]) != of([(1, "y"), (2, "x")])
    assert of([(1, "x")]) != of([(1, "x"), (1, "x")]) and of([]) == (0, None)


def test_scopes_leave_nothing(spark):
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before, known = storage.names(spark, storage.shared_dir(spark)), tables()
    with storage.scope(spark):
        tree.walk(roots(spark, "a"), graph(spark, [("a", "b")])).collect()
    assert storage.names(spark, storage.shared_dir(spark)) == before
    assert tables() == known
