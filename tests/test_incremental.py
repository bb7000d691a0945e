"""Runs that follow runs: versions, outcomes, contents in any store, one budget for several tasks."""

import hashlib
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import fetch, outcomes
from lodestone.plans import prepare, schemas
from lodestone.plans.config import ApiConfig, Config, from_dict
from lodestone.sources import storage
from lodestone.sources.versions import Versions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests

SCHEMA = schemas.T.StructType([schemas.T.StructField("k", schemas.T.StringType()), schemas.T.StructField("n", schemas.T.LongType())])


def test_versions_append_read_and_compact(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t", SCHEMA)
    assert t.read().count() == 0 and t.last() == 0 and t.compact(lambda d: d) == 0
    assert [t.append(spark.createDataFrame([("a", n)], SCHEMA)) for n in (1, 2)] == [1, 2]
    # A number claimed by a writer that died, and a version without its mark, are seen by nobody.
    storage.create_new(spark, f"file://{tmp_path}/t/_claims/{3:010d}")
    spark.createDataFrame([("half", 9, 3)], "k string, n long, version long").write.parquet(f"{tmp_path}/t/v={3:010d}")
    assert t.append(spark.createDataFrame([("b", 3)], SCHEMA)) == 4
    rows = sorted(map(tuple, t.read().collect()))
    assert rows == [("a", 1, 1), ("a", 2, 2), ("b", 3, 4)] and sorted(map(tuple, t.read(since=1).collect())) == rows[1:]
    assert t.compact(lambda d: d.where("n > 1")) == 4 and sorted(map(tuple, t.read().collect())) == rows[1:]
    assert t.live() == [f"base={4:010d}"] and t.compact(lambda d: d.limit(0)) == 4
    assert t.append(spark.createDataFrame([("c", 5)], SCHEMA)) == 5 and t.read().count() == 3
    # A compaction that broke off before deleting: the base counts, what it replaced doesn't.
    spark.createDataFrame([("a", 2, 2)], t.whole).write.parquet(f"{tmp_path}/t/v={2:010d}")
    storage.touch(spark, f"file://{tmp_path}/t/v={2:010d}/_DONE")
    assert t.read().count() == 3


def test_one_number_for_one_writer(spark, tmp_path):
    assert storage.create_new(spark, f"file://{tmp_path}/x") and not storage.create_new(spark, f"file://{tmp_path}/x")


def test_latest_outcome_of_each_target(spark, tmp_path):
    log = outcomes.OutcomeLog(spark, f"file://{tmp_path}/log")

    def run(*rows):
        log.append(spark.createDataFrame([(t, "s", t, ok, 1, status, None) for t, ok, status in rows], outcomes.OUTCOME))

    run(("a", False, "timeout"), ("b", True, "success"), ("b", True, "skipped_already_exists"), (None, False, "unknown_error"))
    run(("a", True, "success"), ("c", False, "not_found"))
    run(("b", False, "timeout"), ("c", False, "timeout"))
    want = {"a": (True, 2), "b": (False, 3), "c": (False, 3), None: (False, 1)}
    for _ in range(2):
        assert {r["target"]: (r["success"], r["version"]) for r in log.latest().collect()} == want
        assert {r["target"]: r["version"] for r in log.fetched().collect()} == {"a": 2, "b": 1}
        log.compact()
    assert log.read().count() == 5


class Counting:
    """A fetcher whose requests leave a line each in a file."""

    def __init__(self, place, dies_at=None):
        self.place, self.dies_at = place, dies_at

    def __call__(self, config, hourly):
        def get(url, headers, timeout):
            sha1 = url.split(":")[-1].split("/")[0]
            if sha1 == self.dies_at and not os.path.exists(self.place + ".died"):
                open(self.place + ".died", "w").close()
                os._exit(1)
            with open(self.place, "a") as f:
                f.write(sha1 + "\n")
            return (404, {}, b"") if sha1.endswith("f") else (200, {}, sha1.encode() * 3)

        return fetch.Fetcher(config, 1 << 40, get, sleep=lambda s: None)


def settings(tmp_path, spark, files, **api):
    config = from_dict({"data_dir": f"file://{tmp_path}/data", "swh_api": {"requests_per_hour": 1 << 40, **api}})
    config.swh_api.bearer_token = None
    put(spark, config, files)
    return config


def put(spark, config, files):
    prepare.write_metadata(spark.createDataFrame([(p, p.split("/")[-1], bytes.fromhex(s), "https://u") for p, s in files], schemas.FILE_METADATA), config.layout().metadata)


def asked(place):
    return sorted(open(place).read().split()) if os.path.exists(place) else []


FILES = [(f"d/{i}.py", f"{i:02x}") for i in range(40)] + [("d/again.py", "03"), ("d/no.txt", "a0")]


@pytest.mark.parametrize("store", ["files", "table"])
def test_a_second_run_asks_for_nothing_that_is_there(spark, tmp_path, store):
    place, config = str(tmp_path / "asked"), settings(tmp_path, spark, FILES, store=store, wave=15)
    stats = lambda: {(r["sha1_git"], r["status"]): r for r in spark.read.parquet(prepare.download_data(spark, config, fetcher=Counting(place))).collect()}
    got = stats()
    hashes, gone = [f"{i:02x}" for i in range(40)], ["0f", "1f"]
    assert asked(place) == sorted(hashes + ["03"] * (store == "files"))  # a table holds each hash once
    assert {s for h, s in got if h not in gone} == {"success"} and {s for h, s in got if h in gone} == {"not_found"}
    os.remove(place)
    got = stats()
    assert asked(place) == gone  # only what failed
    assert {s for h, s in got if h not in gone} == {"skipped_already_exists"} and all(r["size"] == 6 and r["success"] for (h, _), r in got.items() if h not in gone)
    put(spark, config, [*FILES, ("e/new.py", "ab")])
    os.remove(place)
    got = stats()
    assert asked(place) == sorted([*gone, "ab"]) and ("ab", "success") in got
    if store == "files":
        base = fetch.local_folder(config.layout().contents)
        target = f"{base}/{hashlib.sha256(b'https://u').hexdigest()[:8]}/d/5.py"
        assert open(target, "rb").read() == b"050505"
        os.remove(target)
        os.remove(place)
        assert ("05", "success") in stats() and "05" in asked(place)
    else:
        held = {r["sha1_git"]: bytes(r["content"]) for r in prepare.read_contents(spark, config.layout().contents).collect()}
        assert held == {h: h.encode() * 3 for h in [*hashes, "ab"] if h not in gone}


@pytest.mark.parametrize("store", ["files", "table"])
def test_a_run_that_breaks_off_loses_at_most_a_wave(spark, tmp_path, store):
    place, config = str(tmp_path / "asked"), settings(tmp_path, spark, FILES[:30], store=store, wave=10)
    with pytest.raises(Exception, match="(?s).*"):
        prepare.download_data(spark, config, fetcher=Counting(place, dies_at="07"))
    log, table = outcomes.OutcomeLog(spark, config.layout().history), prepare.content_table(spark, config.layout().contents)
    kept = {r["sha1_git"] for r in (log if store == "files" else table).read().where("success").collect()}
    assert "07" not in kept
    before = asked(place)
    prepare.download_data(spark, config, fetcher=Counting(place))
    again = asked(place)
    for h in kept:
        assert again.count(h) == 1  # what was committed is asked for once
    assert set(again) == {s for _, s in FILES[:30]} and len(before) < len(again)
    if store == "table":
        assert prepare.read_contents(spark, config.layout().contents).count() == 29


def test_contents_go_to_any_store(spark, tmp_path):
    """By a path that only Hadoop can read."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lodestone.link./d", f"file://{tmp_path}")
    conf.set("fs.viewfs.impl.disable.cache", "true")
    place = str(tmp_path / "asked")
    config = from_dict({"data_dir": "viewfs://lodestone/d/data", "swh_api": {"requests_per_hour": 1 << 40}})
    put(spark, config, FILES[:5])
    assert not fetch.mounted(config.layout().contents) and not fetch.mounted("s3a://b/c") and fetch.mounted("file:///a") and fetch.mounted("/a")
    prepare.download_data(spark, config, fetcher=Counting(place))
    assert prepare.read_contents(spark, config.layout().contents).count() == 5 == len(asked(place))


def test_shares_use_the_whole_budget():
    assert fetch.shares(10, [3, 4]) == [3, 4] and fetch.shares(10, [100, 1]) == [10, 0] and fetch.shares(5, [0, 0]) == [0, 0]
    for budget, wanted in ((10, [30, 20, 1]), (7, [5, 5, 5]), (1, [9, 9])):
        got = fetch.shares(budget, wanted)
        assert sum(got) == budget and all(g <= w for g, w in zip(got, wanted, strict=True))


class Hours:
    """A fetcher with a clock of its own, which leaves the hour of each request in a file."""

    def __init__(self, place):
        self.place = place

    def __call__(self, config, hourly):
        now = [0.0]

        def get(url, headers, timeout):
            with open(self.place, "a") as f:
                f.write(f"{int(now[0] // 3600)} {os.getpid()}\n")
            return 200, {}, b"x"

        return fetch.Fetcher(config, hourly, get, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))


@pytest.mark.parametrize("as_table", [False, True])
def test_tasks_share_one_budget(spark, tmp_path, as_table):
    """However unequal their work, two tasks use the hour's budget up, and never more."""
    hashes = spark.range(4000).select(F.lpad(F.hex("id"), 6, "0").alias("sha1_git"), F.concat(F.lit(f"{tmp_path}/c/"), "id").alias("target"))
    key = "sha1_git" if as_table else "target"
    part = F.pmod(F.hash(key), F.lit(2))  # as Spark deals them
    few = hashes.where(part == 0).limit(90).unionByName(hashes.where(part == 1).limit(10))
    config, place = ApiConfig(bearer_token=None, requests_per_hour=20, max_retries=1), str(tmp_path / "hours")
    df = fetch.fetch_contents(few, config, 2, Hours(place)) if as_table else fetch.fetch_targets(few, f"{tmp_path}/c", config, tasks=2, fetcher=Hours(place))
    assert storage.settle(df).where("success").count() == 100
    hours = [int(x.split()[0]) for x in open(place)]
    assert [hours.count(h) for h in range(max(hours) + 1)] == [20] * 5
    assert len({x.split()[1] for x in open(place)}) == 2


class Alone:
    """A barrier of one task."""

    def allGather(self, message):
        return [message]

    def partitionId(self):
        return 0


def test_a_task_holds_two_blocks_of_its_work(tmp_path):
    """However much a task has to fetch, it reads on only as blocks are done, hands each one's outcomes on, and keeps to its hours."""
    read, done, place = [], 0, str(tmp_path / "hours")

    def blocks():
        for k in range(40):
            read.append(k)
            yield [f"{k:02x}{i:02x}" for i in range(5)]

    config = ApiConfig(bearer_token=None, requests_per_hour=30, max_retries=1)
    for k, got in enumerate(fetch._in_turns(Hours(place)(config, 30), blocks(), lambda sha1: (sha1,), config, Alone())):
        assert len(read) <= k + 2 and [x for x, in got] == [f"{k:02x}{i:02x}" for i in range(5)]
        done += 1
    assert done == 40
    worker = Hours(place)(config, 30)
    assert [row[0] for block in fetch._in_turns(worker, blocks(), worker.content, config, Alone()) for row in block] == [f"{k:02x}{i:02x}" for k in range(40) for i in range(5)]
    hours = [int(x.split()[0]) for x in open(place)]
    assert [hours.count(h) for h in range(7)] == [30] * 6 + [20]


def test_two_tasks_fetch_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fetch, "BLOCK", 3)
    config, place = ApiConfig(bearer_token=None, requests_per_hour=25, max_retries=1), str(tmp_path / "hours")
    rows = spark.range(100).select(F.lpad(F.hex("id"), 6, "0").alias("sha1_git"), F.concat(F.lit(f"{tmp_path}/c/"), F.col("id")).alias("target"))
    got = storage.settle(fetch.fetch_targets(rows, f"{tmp_path}/c", config, tasks=2, fetcher=Hours(place)))
    assert got.where("success").select("target").distinct().count() == got.count() == 100
    hours = [int(x.split()[0]) for x in open(place)]
    assert max(hours.count(h) for h in set(hours)) <= 25 and len(hours) == 100


def test_the_fetcher_and_the_columns_have_one_law(spark):
    rows = [(k, a, h) for k in ("429", "timeout", "network") for a in range(5) for h in (None, 7.0)]
    got = spark.createDataFrame(rows, "k string, a int, h double").select(fn.backoff(F.col("k"), F.col("a"), F.col("h"))).collect()
    assert [r[0] for r in got] == [h if k == "429" and h else fetch.pause(k, a) for k, a, h in rows]
    per_hour = [1, 120, 1200, 10**6]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in per_hour], "n long").select(fn.limiter_wait(F.col("n"))).collect()] == [fetch.limiter_pause(n) for n in per_hour]
    pairs = [(r, 100) for r in range(0, 101, 5)] + [(9, 100), (29, 100)]
    classes = spark.createDataFrame(pairs, "r long, l long").select(fn.rate_class(F.col("r"), F.col("l"))).collect()
    assert [c[0] for c in classes] == [fetch.RateInfo().update({"x-ratelimit-limit": str(n), "x-ratelimit-remaining": str(r)}) for r, n in pairs]


def test_counts_come_from_the_jobs_themselves(spark, tmp_path, caplog):
    import logging

    with caplog.at_level(logging.INFO, "lodestone"):
        prepare.download_data(spark, settings(tmp_path, spark, FILES), fetcher=Counting(str(tmp_path / "asked")))
    said = [r.getMessage() for r in caplog.records]
    assert "Selected 41 files" in said and any(x.startswith("Download complete: 41 total, 39 downloaded") for x in said)
    assert Config().swh_api.wave == 10_000
    with pytest.raises(ValueError):
        ApiConfig(store="tape")
