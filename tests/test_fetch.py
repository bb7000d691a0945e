"""The fetch state machine against a made-up service and clock; settings and commands."""

import logging
import sys

import pytest
from pyspark import cloudpickle

from lodestone.__main__ import main
from lodestone.operators import fetch
from lodestone.plans import prepare, schemas
from lodestone.plans.config import ApiConfig, Config, from_dict, load_config

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class World:
    def __init__(self, *answers):
        self.answers, self.now, self.slept, self.calls = list(answers), 0.0, [], 0

    def clock(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def get(self, url, headers, timeout):
        self.calls += 1
        a = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(a, Exception):
            raise a
        return a


def run(tmp_path, *answers, retries=3, per_hour=1000, target=None):
    w = World(*answers)
    f = fetch.Fetcher(ApiConfig(max_retries=retries, bearer_token=None), per_hour, w.get, w.clock, w.sleep)
    return f.fetch("ab", target or str(tmp_path / "d" / "f.py")), w


OK = (200, {}, b"data")


def test_success_skip_and_not_found(tmp_path):
    got, _ = run(tmp_path, OK)
    assert got[2:] == (True, 4, "success", None) and (tmp_path / "d" / "f.py").read_bytes() == b"data"
    got, w = run(tmp_path, OK)
    assert got[2:] == (True, 4, "skipped_already_exists", "File already exists") and w.calls == 0
    got, w = run(tmp_path, (404, {}, b""), target=str(tmp_path / "g"))
    assert got == ("ab", None, False, 0, "not_found", "Not found") and w.calls == 1


@pytest.mark.parametrize(
    "answers, status, message, calls, slept",
    [
        ([(429, {}, b"")], "max_retries_exceeded", "Max retries exceeded", 3, [2, 4, 8]),
        ([(429, {"retry-after": "7"}, b""), OK], "success", None, 2, [7]),
        ([(429, {"retry-after": "Thu, 01 Jan 1970 00:00:09 GMT"}, b""), OK], "success", None, 2, [9]),
        ([(429, {"retry-after": "soon"}, b""), OK], "success", None, 2, [2]),
        ([TimeoutError()], "timeout", "Timeout", 3, [1, 2]),
        ([fetch.NetworkError("refused")], "network_error", "refused", 3, [1, 2]),
        ([(500, {}, b"")], "max_retries_exceeded", "Max retries exceeded", 3, [1, 2]),
        ([(403, {}, b""), OK], "success", None, 2, [1]),
        ([RuntimeError("disk")], "unknown_error", "disk", 1, []),
    ],
)
def test_outcomes(tmp_path, answers, status, message, calls, slept):
    got, w = run(tmp_path, *answers)
    assert (got[4], got[5], w.calls, w.slept) == (status, message, calls, slept)


def test_no_attempts(tmp_path):
    got, w = run(tmp_path, OK, retries=0)
    assert got[4] == "max_retries_exceeded" and w.calls == 0


def test_limiter_counts_retries(tmp_path):
    _, w = run(tmp_path, (500, {}, b""), (500, {}, b""), OK, per_hour=2)
    assert w.slept[-1] == 1800.0 and w.now >= 3600


def test_rate_headers():
    info = fetch.RateInfo()
    assert info.update({"x-ratelimit-limit": "100", "x-ratelimit-remaining": "9"}) == "critical"
    assert info.update({"x-ratelimit-remaining": "10"}) == "warning"
    assert info.update({"x-ratelimit-remaining": "30"}) is None
    assert fetch.RateInfo().update({"x-ratelimit-remaining": "1"}) is None


def world(config, hourly):
    w = World(OK)
    return fetch.Fetcher(config, hourly, w.get, w.clock, w.sleep)


def test_fetch_files(spark, tmp_path):
    rows = [("aa", "u", "x.py"), ("bb", "u", "x.py"), ("cc", None, "y.py"), ("dd", "u", "../../evil"), ("ee", "u", None)]
    df = spark.createDataFrame(rows, "sha1_git string, repo_url string, path string")
    stats = fetch.fetch_files(df, str(tmp_path), ApiConfig(bearer_token=None), fetcher=world)
    assert stats.schema == schemas.DOWNLOAD_STATS
    stats.write.parquet(str(tmp_path / "stats"))
    got = {r["sha1_git"]: r for r in spark.read.parquet(str(tmp_path / "stats")).collect()}
    assert got["aa"]["status"] == "success", got["aa"]
    assert got["bb"]["status"] == "skipped_already_exists"
    assert got["cc"]["status"] == "success" and got["dd"]["status"] == "unknown_error"
    assert not (tmp_path.parent / "evil").exists()
    s = fetch.summary(spark.read.parquet(str(tmp_path / "stats"))).first()
    assert (s["total"], s["skipped"]) == (5, 1)


def test_commands(spark, tmp_path, caplog):
    config = Config(data_dir=str(tmp_path))
    config.s3_dataset.auto_download = False
    assert prepare.download_data(spark, config) is None
    raw = config.layout().tables

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{raw}/{name}")

    put("snapshot_branch", [(1, b"refs/heads/main", b"r", "revision")], "object_id bigint, name binary, target binary, target_type string")
    put("revision", [(b"r", b"d")], "id binary, directory binary")
    put("directory", [(b"d", [1, 2], None)], "id binary, file_entries array<bigint>, dir_entries array<bigint>")
    put("directory_entry_file", [(1, b"a.py", b"\x0a"), (2, b"b.txt", b"\x0b")], "id bigint, name binary, target binary")
    put("directory_entry_dir", [(1, b"z", b"z")], "id bigint, name binary, target binary")
    put("content", [(b"\x0a",)], "sha1_git binary")
    put("snapshot_branches", [(1, 5)], "branch_id bigint, snapshot_id bigint")
    put("origin_visit", [(3, 5)], "origin bigint, snapshot_id bigint")
    put("origin", [(3, "https://u", "git")], "id bigint, url string, type string")
    assert spark.read.parquet(prepare.prepare_dataset(spark, config)).count() == 2
    out = prepare.download_data(spark, config, fetcher=world)
    got = spark.read.parquet(out).collect()
    assert [(r["sha1_git"], r["status"], r["size"]) for r in got] == [("0a", "success", 4)]


def test_command_line_refuses_other_commands(spark):
    with pytest.raises(SystemExit):
        main(["serve"], spark)


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SWH_BEARER_TOKEN", "t0ken")
    c = load_config()
    assert (c.batch.batch_size, c.swh_api.max_concurrent, c.swh_api.max_retries, c.processing.file_patterns) == (10, 5, 5, ["(?i)^license"])
    assert c.swh_api.hourly == 1200 and c.swh_api.headers["Authorization"] == "Bearer t0ken" and "t0ken" not in str(c.shown())
    assert c.layout().tables.endswith(f"/raw/{c.s3_dataset.dataset_name}")
    far = from_dict({"data_dir": "s3a://bucket/data/"}).layout()
    assert far.metadata == "s3a://bucket/data/processed/file_metadata.parquet" and far.logs.is_absolute()
    with pytest.raises(ValueError):
        fetch.local_folder(far.contents)
    assert fetch.local_folder("file:///a/b") == fetch.local_folder("file:/a/b") == fetch.local_folder("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        from_dict({"batch": {"batch_size": 0}})
    (tmp_path / "e.yaml").write_text("")
    assert load_config(tmp_path / "e.yaml").batch.batch_size == 4
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    with pytest.raises(ValueError):
        from_dict({"swh_api": {"timeout": "long"}})
    assert from_dict({"ray": {"batch_size": 2}}).batch.batch_size == 2


def test_environment_file(tmp_path, monkeypatch):
    from lodestone.plans.config import environment

    (tmp_path / ".env").write_text("# a note\nOTHER=x\nexport LODESTONE_T = 'from file'\n")
    assert environment("LODESTONE_T", tmp_path) == "from file" and environment("LODESTONE_NONE", tmp_path) is None
    monkeypatch.setenv("LODESTONE_T", "set")
    assert environment("LODESTONE_T", tmp_path) == "set"


def test_connections_are_kept():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version, seen = "HTTP/1.1", []

        def do_GET(self):
            self.seen.append((self.client_address[1], self.path, self.headers["X-A"]))
            status = 302 if "moved" in self.path else 404 if "gone" in self.path else 200
            self.send_response(status)
            self.send_header("Content-Length", "2")
            if "close" in self.path:
                self.send_header("Connection", "close")
                self.close_connection = True
            self.end_headers()
            self.wfile.write(b"ok")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, get = f"http://127.0.0.1:{server.server_port}", fetch.Connections()
    assert [get(f"{base}/{p}", {"X-A": "1"}, 5)[::2] for p in ("a?q=1", "gone", "moved", "close", "b")] == [(200, b"ok"), (404, b"ok"), (302, b"ok"), (200, b"ok"), (200, b"ok")]
    assert [p for _, p, _ in Handler.seen] == ["/a?q=1", "/gone", "/moved", "/close", "/b"] and len({c for c, _, _ in Handler.seen[:4]}) == 1
    server.shutdown()
    server.server_close()
    with pytest.raises(fetch.NetworkError):
        fetch.Connections()(f"{base}/a", {}, 2)


def test_timer_logs_even_after_an_error(caplog):
    with caplog.at_level(logging.INFO, "lodestone"), pytest.raises(KeyError), prepare.timer("work"):
        raise KeyError
    assert any("work took" in r.message for r in caplog.records)
