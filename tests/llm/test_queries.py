"""Every query opN_ on whole small tables, against the libraries and brute force."""

import base64
import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lodestone.llm import mpeg, pii, queries, storage
from lodestone.sources.storage import names as stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if not (kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def pair_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    lib, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), collections.defaultdict(list)
    rows = run(spark, "op1_best_fit_packing")
    for r in rows:
        got[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        want = [(k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[doc]) == want
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in fill.values():
        assert [o for o, _ in sorted(at)] == np.cumsum([0, *(n for _, n in sorted(at))])[:-1].tolist() and sum(n for _, n in at) <= 4096


def test_op3(spark, texts):
    lib = pair_library()
    want = {}
    for doc, text in texts.items():
        ids = lib.encode_ordinary(text)
        want[doc] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op3_byte_level_bpe")} == want


def test_op4(spark, texts):
    lib, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for doc in sorted(texts):
        ids = [*lib.encode(texts[doc], add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op4_rans_tokens")) == want


def test_op5(spark, texts):
    """Ranking and calibration on rows that the model never saw."""
    rows = run(spark, "op5_random_indexing_quality")
    assert {r["doc_id"] for r in rows} == set(texts) and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    sf = SF.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    held = [(r["score"], labels[r["doc_id"]]) for r in queries.op5_random_indexing_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    score, y = (np.array(x, float) for x in zip(*held, strict=True))
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].sum() - (n := (y == 1).sum()) * (n - 1) / 2) / (n * (len(y) - n))
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(score[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    assert len(y) > 1000 and auc > 0.98 and ((score >= 0.5) == y).mean() > 0.97 and error < 0.05


def test_op6(spark, texts):
    for r in run(spark, "op6_candidate_boosting_pii"):
        base = plain(texts[r["doc_id"]])
        count = collections.Counter(k for k, *_ in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [count[k] for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256((",".join(f"{k}:{s}:{e}" for k, s, e in base)).encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(base) <= set(spans) and all(0 <= s < e <= len(texts[r["doc_id"]]) for _, s, e in spans)


def test_op7(spark, texts):
    for r in run(spark, "op7_mpeg_audio"):
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = mpeg.write(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_op8(spark, texts):
    rows = run(spark, "op8_hilbert_sharding")
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    shards = collections.defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    curves = [max(r["curve"] for r in rows if r["shard"] == k) for k in range(15)]
    assert all(c <= min(r["curve"] for r in rows if r["shard"] == k + 1) for k, c in enumerate(curves))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_only_the_result_stays_settled(spark, name):
    root = storage.shared_dir(spark)
    before = set(stored(spark, root))
    rows = queries.QUERIES[name](spark, SF)
    assert len(set(stored(spark, root)) - before) <= 1 and rows.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, df = db.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert collections.Counter(map(repr, map(tuple, df.collect()))) == collections.Counter(repr(tuple(r[i] for i in at)) for r in want.fetchall())
