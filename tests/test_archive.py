"""Heads, provenance, trees and selection on small hand-made archives."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as fn
from lodestone.operators import heads, select, tree
from lodestone.plans import prepare, schemas
from lodestone.sources import storage
from lodestone.sources.catalog import Catalog, MissingTable

DIR = "id binary, file_entries array<bigint>, dir_entries array<bigint>"
ENTRY = "id bigint, name binary, target binary"


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def test_heads(spark):
    rows = [(1, b"refs/heads/main", b"r1", "revision"), (2, b"refs/heads/master", b"r2", "revision"), (3, b"main", b"r1", "revision"), (4, b"refs/heads/Main", b"r1", "revision"), (5, None, b"r1", "revision"), (6, b"refs/heads/main", b"r1", "release"), (7, b"refs/heads/main", b"gone", "revision"), (8, b"refs/heads/main", b"r1", None)]
    branches = spark.createDataFrame(rows, "object_id bigint, name binary, target binary, target_type string")
    revision = spark.createDataFrame([(b"r1", b"d1"), (b"r2", b"d2"), (None, b"d3")], "id binary, directory binary")
    got = heads.main_revisions(branches, revision)
    assert got.columns == ["snapshot_id", "revision_id", "root_directory_id", "branch_name"]
    assert sorted(r[0] for r in got.collect()) == [1, 2]


def test_provenance(spark):
    h = spark.createDataFrame([(i, bytearray(b"r"), bytearray(b"d%d" % i), bytearray(b"m")) for i in range(1, 6)], "snapshot_id bigint, revision_id binary, root_directory_id binary, branch_name binary")
    to = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "branch_id bigint, snapshot_id bigint")
    visit = spark.createDataFrame([(7, 10), (8, 20), (7, 20), (99, 30), (None, 20)], "origin bigint, snapshot_id bigint")
    origin = spark.createDataFrame([(7, "https://b", "git"), (8, "https://a", "git")], "id bigint, url string, type string")
    got = {r["snapshot_id"]: r["repo_url"] for r in heads.add_repo_urls(h, to, visit, origin).collect()}
    assert got == {1: "https://b", 2: "https://a", 3: None, 4: None, 5: None}
    assert tuple(heads.url_coverage(heads.add_repo_urls(h, to, visit, origin)).first()) == (2, 5)


def archive(spark, dirs, files, subdirs):
    return spark.createDataFrame(dirs, DIR), spark.createDataFrame(files, ENTRY), spark.createDataFrame(subdirs, ENTRY)


def test_membership_counts_lists_once_and_entries_each(spark):
    d, f, s = archive(spark, [(b"a", [1, 1, 2, None], None), (b"a", [1, 1, 2, None], None), (b"b", [], []), (b"c", None, None)], [(1, b"x", b"1"), (1, b"y", b"1"), (2, b"z", b"2")], [(9, b"n", b"q")])
    roots = spark.createDataFrame([(b"a",), (b"b",), (b"c",), (b"a",), (None,)], "root_directory_id binary")
    got = tree.files_below(roots, d, f, s)
    assert sorted(r["path"] for r in got.collect()) == ["x", "y", "z"]


def test_shared_directories_dangling_and_flat(spark):
    dirs = [(b"root", [1], [10, 11, 12]), (b"left", None, [13]), (b"shared", [2], None)]
    files = [(1, b"top.py", b"1"), (2, b"deep.py", b"2")]
    subs = [(10, b"l", b"left"), (11, b"s", b"shared"), (12, b"gone", b"missing"), (13, b"s", b"shared")]
    roots = spark.createDataFrame([(b"root",)], "root_directory_id binary")
    a = archive(spark, dirs, files, subs)
    assert sorted(r["path"] for r in tree.files_below(roots, *a).collect()) == ["l/s/deep.py", "s/deep.py", "top.py"]
    assert [r["path"] for r in tree.files_below(roots, *a, recursive=False).collect()] == ["top.py"]
    content = spark.createDataFrame([(b"1",), (b"1",)], "sha1_git binary")
    assert sorted(r["path"] for r in tree.files_below(roots, *a, content=content).collect()) == ["l/s/deep.py", "s/deep.py", "top.py", "top.py"]


def test_cycles_are_an_error(spark):
    a = archive(spark, [(b"a", None, [1]), (b"b", None, [2])], [(5, b"f", b"x")], [(1, b"b", b"b"), (2, b"a", b"a")])
    with pytest.raises(tree.TooDeep):
        tree.files_below(spark.createDataFrame([(b"a",)], "root_directory_id binary"), *a, max_depth=5)


def test_walk_equals_recursive_model_and_sql(spark):
    rng = random.Random(5)
    n = 14
    dirs, files, subs = [], [], []
    for i in range(n):
        kids = [j for j in range(i + 1, n) if rng.random() < 0.25]
        names = [rng.choice("ab") for _ in kids]
        ids = [100 * i + k for k in range(len(kids))]
        subs += [(e, c.encode(), b"d%d" % j) for e, c, j in zip(ids, names, kids, strict=True)]
        own = [10000 + i] if rng.random() < 0.7 else []
        files += [(10000 + i, b"f%d" % i, b"x")] if own else []
        dirs.append((b"d%d" % i, own, ids + ids[:1]))

    def model(i, prefix):
        _, own, ids = dirs[i]
        out = [f"{prefix}f{i}"] if own else []
        for e, name, target in subs:
            if e in ids:
                out += model(int(target[1:]), f"{prefix}{name.decode()}/")
        return out

    a = archive(spark, dirs, files, subs)
    roots = spark.createDataFrame([(b"d0",), (b"d1",)], "root_directory_id binary")
    got = collections.Counter((bytes(r["root"]), r["path"]) for r in tree.files_below(roots, *a).collect())
    assert got == collections.Counter([(b"d0", p) for p in model(0, "")] + [(b"d1", p) for p in model(1, "")])
    edges = tree.dir_edges(tree.unique_directories(a[0]), a[2])
    assert bag(tree.walk_sql(roots, edges)) == bag(tree.walk(roots, edges))


def test_names_decode_like_python(spark):
    raw = [b"ab\xff\xfec\xe2\x82", b"\xed\xa0\x80", b"", "é".encode(), b"\xf4\x90\x80\x80", None]
    df = spark.createDataFrame([(r,) for r in raw], "name binary")
    assert [r[0] for r in df.select(tree.decoded(df)).collect()] == [r.decode("utf-8", "replace") if r is not None else None for r in raw]
    assert [tuple(r) for r in spark.createDataFrame([("", "a"), ("p", "a"), ("", None), ("p", None)], "p string, n string").select(fn.path_join(F.col("p"), F.col("n"))).collect()] == [("a",), ("p/a",), (None,), ("p/None",)]


NAMES = ["a.py", "A.PY", "x.py\n", "LICENSE", "licenſe.txt", "License.hunspell", "mylicense", None]


def test_selection(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert [r[0] for r in select.select_files(df, [".py"], ["(?i)^license"]).collect()] == ["a.py", "LICENSE", "licenſe.txt", "License.hunspell"]
    assert select.select_files(df).count() == len(NAMES)
    assert select.select_files(df, [], [r"\.py$"]).count() == 1


@pytest.mark.parametrize("bad", ["(?=a)", r"(a)\1", "(?U)a", "a++", "(?<=a)b", "[a", "a\\", "[[:nope:]]"])
def test_refused_patterns(bad):
    with pytest.raises(fn.BadPattern):
        fn.java_regex(bad)


def test_patterns_fail_on_the_driver(spark):
    with pytest.raises(fn.BadPattern):
        fn.java_regex("(", spark)
    compiled = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    matches = lambda p, t: compiled(fn.java_regex(p, spark)).matcher(t).find()
    assert matches("^(?P<n>[[:alpha:]]+)$", "abZ") and not matches("^(?P<n>[[:alpha:]]+)$", "ab\n") and not matches("[[:alpha:]]", "é")


def test_limit(spark):
    df = spark.createDataFrame([("b", None, "2"), ("a", "u", "1"), ("c", "u", "3")], "path string, repo_url string, sha1_git string")
    assert [select.limit_files(df, n).count() for n in (None, 0, 1, 9)] == [3, 3, 1, 3]
    assert select.limit_files(df, 1).first()["path"] == "a"
    with pytest.raises(ValueError):
        select.limit_files(df, -1)


def test_empty_metadata_keeps_its_schema(spark, tmp_path):
    prepare.write_metadata(spark.createDataFrame([], schemas.FILE_METADATA), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).schema == schemas.FILE_METADATA


def test_catalog(spark, tmp_path):
    spark.createDataFrame([(1, "u", "git")], "id bigint, url string, type string").write.parquet(str(tmp_path / "origin"))
    c = Catalog(spark, str(tmp_path)).load()
    assert list(c.tables) == ["origin"] and c["origin"].count() == 1
    with pytest.raises(MissingTable):
        c["revision"]
    with pytest.raises(FileNotFoundError):
        c["snapshot"]


def put_tables(spark, place, names):
    for name in names:
        spark.range(1).write.mode("overwrite").parquet(f"{place}/{name}")


def test_dataset_place(spark, tmp_path):
    from lodestone.sources import catalog

    source, place = f"file://{tmp_path}/source", f"file://{tmp_path}/own"
    with pytest.raises(FileNotFoundError):
        catalog.dataset_place(spark, place, None)
    for in_place in (True, False):  # an empty source is an error, not a dataset
        with pytest.raises(MissingTable):
            catalog.dataset_place(spark, place, source, in_place)
    put_tables(spark, source, catalog.NEEDED)
    assert catalog.dataset_place(spark, place, source, in_place=True) == source
    put_tables(spark, place, catalog.NEEDED[:2])  # a copy that was broken off
    assert catalog.dataset_place(spark, place, source) == place
    assert (tmp_path / "own" / catalog.COMPLETE).exists() and catalog.lacking(spark, place) == []
    assert catalog.dataset_place(spark, place, None) == place
    put_tables(spark, tmp_path / "third", catalog.NEEDED)
    assert catalog.dataset_place(spark, str(tmp_path / "third"), None) == str(tmp_path / "third")


def test_source_uri():
    from lodestone.sources.catalog import source_uri

    assert source_uri("s3://b/name/parquet/", "name") == "s3a://b/name/parquet" and source_uri("s3://b/other", "name") == "s3a://b/other/name"
    for bad in ("http://b", "s3://", "b/name"):
        with pytest.raises(ValueError):
            source_uri(bad, "name")


def test_settled_tables_go_with_their_scope(spark, tmp_path, monkeypatch):
    from lodestone.sources import storage

    def folders():
        import os

        root = storage.shared_dir(spark).removeprefix("file://")
        return {d for d in os.listdir(root) if d.startswith("lodestone-")}

    before = folders()
    kept = storage.alone(spark, lambda: storage.settle(storage.settle(spark.range(5)).where("id > 1")))
    assert kept.count() == 3 and len(folders() - before) == 1
    with pytest.raises(ZeroDivisionError), storage.scope(spark):
        storage.settle(spark.range(2))
        1 / 0
    storage.forget(kept)
    assert folders() == before


def test_other_masters_need_a_shared_folder():
    from types import SimpleNamespace

    from lodestone.sources import storage

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
        with pytest.raises(storage.NoSharedFolder):
            storage.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_urls_equal_the_whole_chain(spark):
    rng = random.Random(9)
    h = spark.createDataFrame([(i, bytearray(b"r%d" % (i % 3)), bytearray(b"d%d" % (i % 4)), bytearray(b"m")) for i in range(30)], "snapshot_id bigint, revision_id binary, root_directory_id binary, branch_name binary")
    to = spark.createDataFrame([(rng.randrange(30), rng.randrange(9)) for _ in range(60)], "branch_id bigint, snapshot_id bigint")
    visit = spark.createDataFrame([(rng.choice([None, 1, 2, 3, 4, 9]), rng.randrange(9)) for _ in range(40)], "origin bigint, snapshot_id bigint")
    origin = spark.createDataFrame([(1, "https://b", "git"), (2, None, "git"), (3, "https://a", None), (3, "https://a", "hg"), (4, "https://b", "svn")], "id bigint, url string, type string")
    assert bag(heads.add_repo_urls(h, to, visit, origin)) == bag(heads.one_url(heads.url_chain(h, to, visit, origin)))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, b"refs/heads/main", b"r", "revision", "extra")], "object_id bigint, name binary, target binary, target_type string, more string").write.parquet(str(tmp_path / "b"))
    plan = heads.branch_heads(spark.read.parquet(str(tmp_path / "b")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(target_type,revision)" in plan and "In(name" in plan and "more" not in plan.split("ReadSchema")[1]


def test_membership_plans_as_a_hash_or_merge_join(spark):
    a = archive(spark, [(b"a", [1], None)], [(1, b"x", b"1")], [(9, b"n", b"q")])
    plan = tree.file_edges(tree.unique_directories(a[0]), a[1])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan


def test_schemas():
    assert [f.name for f in schemas.DOWNLOAD_STATS] == ["sha1_git", "local_path", "success", "size", "status", "error_message"]
    assert isinstance(schemas.DOWNLOAD_STATS["size"].dataType, T.LongType)


def test_files_meet_their_repositories_by_way_of_directories(spark, monkeypatch):
    """The same bag as joining finished files by root, with equal repositories, hashes of several content rows, and no file moved by its root or hash."""
    d = spark.createDataFrame([(b"a", [1, 2], [1]), (b"a", [1, 2], [1]), (b"s", [3], []), (b"b", None, [1]), (b"e", [], None)], "id binary, file_entries array<bigint>, dir_entries array<bigint>")
    f = spark.createDataFrame([(1, b"x", b"h1"), (2, b"y", b"h2"), (3, b"z", b"h3")], "id bigint, name binary, target binary")
    s = spark.createDataFrame([(1, b"s", b"s")], "id bigint, name binary, target binary")
    content = spark.createDataFrame([(b"h1",), (b"h1",), (b"h1",), (b"h2",), (None,), (None,)], "sha1_git binary")
    repos = spark.createDataFrame([(b"a", "u"), (b"a", "u"), (b"b", None), (b"e", "v"), (None, "w")], "root_directory_id binary, repo_url string")
    want = collections.Counter({("x", "x", b"h1", "u"): 6, ("y", "y", b"h2", "u"): 2, ("s/z", "z", b"h3", "u"): 2, ("s/z", "z", b"h3", None): 1})
    for most in (tree.SEVERAL, 0):
        monkeypatch.setattr(tree, "SEVERAL", most)
        for got in (tree.repo_files_below(repos, d, f, s, content), tree.repo_files(repos, tree.files_below(repos, d, f, s, content))):
            assert collections.Counter((r["path"], r["name"], bytes(r["sha1_git"]), r["repo_url"]) for r in got.collect()) == want


def test_a_round_trip_writes_its_rows_once(spark, monkeypatch):
    from lodestone.plans import queries

    written, real = [], storage._write
    monkeypatch.setattr(storage, "_write", lambda df, path: (written.append(df.columns), real(df, path))[1])
    df = queries.QUERIES["parquet_roundtrip"](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and not [c for c in written if "path" in c]
