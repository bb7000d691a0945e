"""File contents from an HTTP service with an hourly limit: one outcome for every file."""

from __future__ import annotations

import http.client
import logging
import os
import posixpath
import threading
import time
import urllib.parse
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from email.utils import parsedate_to_datetime
from itertools import chain
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import output_path
from lodestone.operators.select import limit_files, with_defaults
from lodestone.plans import schemas
from lodestone.plans.config import ApiConfig

log = logging.getLogger(__name__)

NOT_FOUND, TOO_MANY = 404, 429


class NetworkError(Exception):
    """A request that got no answer, other than by timeout."""


class Connections:
    """A transport that keeps one open connection to each host and thread. Redirects are answers like any other."""

    def __init__(self):
        self.held = threading.local()

    def _open(self, scheme: str, host: str, timeout: float, fresh: bool) -> http.client.HTTPConnection:
        kept = self.held.__dict__.setdefault("by_host", {})
        if fresh and (old := kept.pop((scheme, host), None)):
            old.close()
        if (scheme, host) not in kept:
            kept[scheme, host] = (http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection)(host, timeout=timeout)
        return kept[scheme, host]

    def __call__(self, url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
        """Status, headers (names in lower case) and body; TimeoutError or NetworkError if there is no answer."""
        parts = urllib.parse.urlsplit(url)
        target = urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, ""))
        for again in (False, True):  # a kept connection may have been closed by the other side meanwhile
            connection = self._open(parts.scheme, parts.netloc, timeout, again)
            used = connection.sock is not None
            try:
                connection.request("GET", target, headers=headers)
                answer = connection.getresponse()
                return answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read()
            except TimeoutError:
                connection.close()
                raise
            except (OSError, http.client.HTTPException) as e:
                connection.close()
                if again or not used:
                    raise NetworkError(str(e) or type(e).__name__) from e
        raise AssertionError


def mounted(place: str) -> bool:
    """Whether place is a folder of a mounted file system, as far as its name tells."""
    return ":" not in place.removeprefix("file:").split("/")[0]


def local_folder(place: str) -> str:
    """The path of a folder that all executors mount, for contents as files; other stores take them as a table."""
    local = place.removeprefix("file:")
    if not mounted(place):
        raise ValueError(f"files need a mounted folder, not {place}")
    return "/" + local.lstrip("/") if local.startswith("/") else local


class Limiter:
    """At most so many acquisitions in any hour; a blocked one sleeps and asks again."""

    def __init__(self, per_hour: int, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.per_hour, self.clock, self.sleep, self.taken, self.lock = max(1, per_hour), clock, sleep, deque(), threading.Lock()

    def acquire(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                while self.taken and self.taken[0] <= now - 3600.0:
                    self.taken.popleft()
                if len(self.taken) < self.per_hour:
                    self.taken.append(now)
                    return
            self.sleep(limiter_pause(self.per_hour))


class RateInfo:
    """What the service says about its own limit."""

    def __init__(self):
        self.limit = self.remaining = self.reset = None

    def update(self, headers: dict[str, str]) -> str | None:
        for name in ("limit", "remaining", "reset"):
            if (value := headers.get(f"x-ratelimit-{name}")) and value.strip().lstrip("-").isdigit():
                setattr(self, name, int(value))
        if not self.limit or self.remaining is None:
            return None
        ratio = self.remaining / self.limit
        kind = "critical" if ratio < 0.1 else "warning" if ratio < 0.3 else None
        if kind:
            log.log(logging.WARNING if kind == "critical" else logging.INFO, "Rate limit: %d/%d remaining, resets at %s", self.remaining, self.limit, self.reset)
        return kind


class OutOfBudget(Exception):
    """No request may be made before budgets are dealt anew."""


def pause(kind: str, attempt: int) -> float:
    """Seconds before the next try; attempts count from 0. The same law as functions.text.backoff."""
    return float(2 ** (attempt + 1)) if kind == "429" else 2.0**attempt


def limiter_pause(per_hour: int) -> float:
    """Seconds before a blocked request asks again. The same law as functions.text.limiter_wait."""
    return max(3600.0 / per_hour, 0.01)


def retry_after(value: str | None, attempt: int, now: float) -> float:
    """Seconds to wait after 429: the header's number or date, else 2^(attempt+1)."""
    if value:
        try:
            return max(0.0, float(value))
        except ValueError:
            try:
                return max(0.0, parsedate_to_datetime(value).timestamp() - now)
            except (TypeError, ValueError):
                pass
    return pause("429", attempt)


class Fetcher:
    """The state machine for one file after another; one for each task."""

    def __init__(self, config: ApiConfig, per_hour: int | None = None, transport=None, clock=time.time, sleep=time.sleep):
        self.config, self.transport, self.clock, self.sleep = config, transport or Connections(), clock, sleep
        self.limiter, self.rate = Limiter(per_hour or config.hourly, clock, sleep), RateInfo()
        self.slots = threading.Semaphore(max(1, config.max_concurrent))

    def request(self, sha1_git: str) -> tuple[str, bytes | None, str | None]:
        """Status, content and message of one file, after as many tries as allowed."""
        url = f"{self.config.base_url}/content/sha1_git:{sha1_git}/raw/"
        for attempt in range(self.config.max_retries):
            last = attempt == self.config.max_retries - 1
            self.limiter.acquire()
            with self.slots:
                try:
                    status, headers, body = self.transport(url, self.config.headers, self.config.timeout)
                except TimeoutError:
                    if last:
                        return "timeout", None, "Timeout"
                    self.sleep(pause("timeout", attempt))
                    continue
                except NetworkError as e:
                    if last:
                        return "network_error", None, str(e)
                    self.sleep(pause("network", attempt))
                    continue
                self.rate.update(headers)
                if 200 <= status < 300:
                    return "success", body, None
                if status == NOT_FOUND:
                    return "not_found", None, "Not found"
                if status == TOO_MANY:
                    self.sleep(retry_after(headers.get("retry-after"), attempt, self.clock()))
                elif not last:
                    self.sleep(pause("server", attempt))
        return "max_retries_exceeded", None, "Max retries exceeded"

    def fetch(self, sha1_git: str, target: str, skip_existing: bool = True) -> tuple:
        """The outcome (as DOWNLOAD_STATS) of one file, whose content then lies at target."""
        try:
            path = Path(target)
            if skip_existing and path.exists():
                return sha1_git, target, True, path.stat().st_size, "skipped_already_exists", "File already exists"
            status, body, message = self.request(sha1_git)
            if body is None:
                return sha1_git, None, False, 0, status, message
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_name(f".{path.name[:100]}.{uuid.uuid4().hex}")
            part.write_bytes(body)
            os.replace(part, path)
            return sha1_git, target, True, len(body), "success", None
        except OutOfBudget:
            raise
        except Exception as e:  # one file's trouble is its outcome, not the batch's
            return sha1_git, None, False, 0, "unknown_error", str(e)

    def content(self, sha1_git: str) -> tuple:
        """The outcome and content (as CONTENTS) of one hash."""
        try:
            status, body, message = self.request(sha1_git)
        except OutOfBudget:
            raise
        except Exception as e:
            status, body, message = "unknown_error", None, str(e)
        return sha1_git, body is not None, len(body or b""), status, message, body


def safe_target(base: str, target: str) -> bool:
    """Whether target, its dots resolved, lies below base."""
    root = posixpath.normpath(base)
    return posixpath.normpath(target).startswith(root.rstrip("/") + "/")


class Share:
    """A limiter with so many acquisitions until it gets more."""

    def __init__(self):
        self.left, self.lock = 0, threading.Lock()

    def grant(self, n: int) -> None:
        self.left = n

    def acquire(self) -> None:
        with self.lock:
            if self.left < 1:
                raise OutOfBudget
            self.left -= 1


def shares(budget: int, wanted: list[int]) -> list[int]:
    """budget dealt to tasks by what each wants: nobody gets more, and nothing is left while somebody wants; equal in every task."""
    if sum(wanted) <= budget:
        return list(wanted)
    out = [budget * w // sum(wanted) for w in wanted]
    for i in sorted(range(len(wanted)), key=lambda i: (-(budget * wanted[i] % sum(wanted)), i))[: budget - sum(out)]:
        out[i] += 1
    return out


def _in_turns(worker: Fetcher, blocks: Iterable[list], one: Callable, config: ApiConfig, context) -> Iterator[list]:
    """one(group) for every group, a list for each block. All tasks together make at most the hourly requests: each hour they
    tell each other what they want, and deal the hour's budget by that; what then is left of it they deal again.

    A task holds two blocks, whatever it has to do: with a last block at hand it wants what that may take, before
    that as much as there is. A group whose budget runs out starts anew when budget is dealt. Requests that wait for a
    server's pause may end after their hour; the next one begins when its budget is dealt.
    """
    worker.limiter, tries = Share(), max(1, config.max_retries)
    blocks = iter(blocks)
    block, after = next(blocks, None), next(blocks, None)
    left, done, budget, began = list(range(len(block or ()))), {}, 0, 0.0

    def attempt(i: int) -> bool:
        try:
            done[i] = one(block[i])
        except OutOfBudget:
            return False
        return True

    with ThreadPoolExecutor(max(1, config.max_concurrent)) as pool:
        while any(wanted := [int(n) for n in context.allGather(str(len(left) * tries + (config.hourly if after is not None else 0)))]):
            if budget < 1:
                began, budget = worker.clock(), config.hourly
            worker.limiter.grant(granted := shares(budget, wanted)[context.partitionId()])
            while block is not None:
                left = [i for i, ok in zip(left, pool.map(attempt, left), strict=True) if not ok]
                if left:
                    break
                yield [done[i] for i in range(len(block))]
                block, after, done = after, next(blocks, None), {}
                left = list(range(len(block or ())))
            told = [tuple(map(int, x.split())) for x in context.allGather(f"{len(left)} {granted - worker.limiter.left}")]
            budget -= sum(used for _, used in told)
            if budget < 1 and any(n for n, _ in told) and (rest := began + 3600.0 - worker.clock()) > 0:
                worker.sleep(rest)


BLOCK = 1 << 12  #: rows that a task fetches, and whose outcomes it holds, together


def targets(files: DataFrame, output_dir: str, max_files: int | None = None) -> DataFrame:
    """sha1_git, repo_url, path, target of the files to have: the first max_files, with where each one's content goes."""
    return limit_files(with_defaults(files), max_files).withColumn("target", output_path(output_dir, F.col("repo_url"), F.col("path")))


def fetch_targets(rows: DataFrame, output_dir: str, config: ApiConfig, skip_existing: bool = True, tasks: int = 1, fetcher: Callable[[ApiConfig, int], Fetcher] = Fetcher) -> DataFrame:
    """target and outcome (schema DOWNLOAD_STATS) for each row sha1_git, target; contents go to files below output_dir.

    output_dir must be a folder that all executors share. Rows are dealt by their target, so rows of
    one meet in one task: the first is fetched, and the others find its file. Several tasks run as
    one barrier stage and share the hourly limit by what each has left; a task holds blocks of BLOCK rows
    and hands on each one's outcomes before the next. The result has side effects: write it once and read that (and
    leave speculation off). Targets that leave the output folder are not fetched. A retried task
    finds the files of its first try.
    """

    def run(batches):
        worker = fetcher(config, config.hourly)

        def one_path(group: list) -> list:
            out = []
            for sha1, target in group:
                if target is None or not safe_target(output_dir, target):
                    out.append((target, sha1, None, False, 0, "unknown_error", f"path leaves the output folder: {target}"))
                else:
                    out.append((target, *worker.fetch(sha1, target, skip_existing)))
            return out

        def grouped(pdf) -> list:
            groups: dict = {}
            for sha1, target in zip(pdf["sha1_git"], pdf["target"], strict=True):
                groups.setdefault(target, []).append((sha1, target))
            return list(groups.values())

        def table(done: list) -> pd.DataFrame:
            return pd.DataFrame([row for group in done for row in group], columns=["target", *schemas.DOWNLOAD_STATS.names])

        blocks = (grouped(pdf.iloc[at : at + BLOCK]) for pdf in batches for at in range(0, len(pdf), BLOCK))
        for done in _in_turns(worker, blocks, one_path, config, BarrierTaskContext.get()) if tasks > 1 else (_limited(worker, block, one_path, config) for block in blocks):
            yield table(done)

    dealt = rows.select("sha1_git", "target").repartition(tasks, "target").sortWithinPartitions("target", "sha1_git")
    return dealt.mapInPandas(run, T.StructType([T.StructField("target", T.StringType()), *schemas.DOWNLOAD_STATS.fields]), barrier=tasks > 1)


def _limited(worker: Fetcher, groups: list, one: Callable, config: ApiConfig) -> list:
    """one(group) for every group, under the worker's own limiter."""
    with ThreadPoolExecutor(max(1, config.max_concurrent)) as pool:
        return list(pool.map(one, groups))


def fetch_files(files: DataFrame, output_dir: str, config: ApiConfig, max_files: int | None = None, skip_existing: bool = True, tasks: int = 1, fetcher: Callable[[ApiConfig, int], Fetcher] = Fetcher) -> DataFrame:
    """An outcome (schema DOWNLOAD_STATS) for each row of files: sha1_git (hex), repo_url, path; see fetch_targets."""
    return fetch_targets(targets(files, output_dir, max_files), output_dir, config, skip_existing, tasks, fetcher).drop("target")


CONTENTS_AT_ONCE = 32 << 20  #: bytes of contents that a task hands on together


def fetch_contents(hashes: DataFrame, config: ApiConfig, tasks: int = 1, fetcher: Callable[[ApiConfig, int], Fetcher] = Fetcher) -> DataFrame:
    """Outcome and content (schema CONTENTS) of each row sha1_git; each hash once, please. No side effect but the requests.

    Whatever Spark writes it to gets whole contents or none, in any store that it knows.
    """

    def run(batches):
        worker = fetcher(config, config.hourly)
        size = max(1, config.max_concurrent) * 8
        blocks = (batch.column(0).slice(at, size).to_pylist() for batch in batches for at in range(0, batch.num_rows, size))
        rows = chain.from_iterable(_in_turns(worker, blocks, worker.content, config, BarrierTaskContext.get()) if tasks > 1 else (_limited(worker, block, worker.content, config) for block in blocks))
        held, weight = [], 0
        for row in rows:
            held.append(row)
            weight += row[2]
            if weight > CONTENTS_AT_ONCE:
                yield _contents_batch(held)
                held, weight = [], 0
        if held:
            yield _contents_batch(held)

    return hashes.select("sha1_git").repartition(tasks, "sha1_git").mapInArrow(run, schemas.CONTENTS, barrier=tasks > 1)


def _contents_batch(rows: list) -> pa.RecordBatch:
    types = (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schemas.CONTENTS.names)


def still_there(known: DataFrame) -> DataFrame:
    """known's rows whose file (target) lies in the folder that all executors mount."""

    def run(batches):
        for batch in batches:
            there = pa.array([t is not None and os.path.exists(t) for t in batch.column(batch.schema.get_field_index("target")).to_pylist()], pa.bool_())
            yield batch.filter(there)

    return known.mapInArrow(run, known.schema)


def summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "skipped_already_exists").alias("skipped"), F.count_if(~F.col("success")).alias("failed"))
