"""Near-duplicate documents by word shingles: MinHash tables with tensored keys, links confirmed on full sets.

A document has two small collections of half keys, A and B, each of a few minhashes. The key of
table (i, j) is the pair (A_i, B_j), so that m + m half keys serve m * m tables. For a
similarity s and r minhashes a half key, a pair meets with (1 - (1 - s^r)^m)^2; the defaults give
0.9996 at 0.8 and nearly 1 at 0.85.

Work is never dealt by a group of copies as a whole, and buckets are not spread into pairs.
Documents with equal sets are one class; members of a table's bucket are compared with a leader,
twice, with the components found so far left out. What then still shares a bucket but no
component is settled exactly, by the shingles that few of these documents have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import storage
from lodestone.llm.graph import components
from lodestone.llm.storage import join_unique
from lodestone.llm.words import CHUNK, mix, points, span_hashes, spans_coded

HALVES, ROWS = 8, 2


def _multiplier(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_STEP = _multiplier(11, 64)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' code points with A-Z as a-z, starts and ends of their words, and where each text's words begin."""
    cp = points(" ".join(texts) + " ")
    cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
    gap = (cp == 32) | ((cp >= 9) & (cp <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    lens = np.array([len(t) + 1 for t in texts])
    return cp, start, end, np.searchsorted(start, np.concatenate(([0], np.cumsum(lens))))


def _sizes(first: np.ndarray, words: int) -> np.ndarray:
    """Shingles of texts whose words begin at first."""
    n = np.diff(first)
    return np.where(n >= words, n - words + 1, np.minimum(n, 1))


def shingle_hashes(texts: list[str | None], words: int, keys: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """For each key 64-bit hashes of every text's word shingles, text after text, repeats included; and the texts' bounds.

    A-Z become a-z; words are what stands between white space (space and U+0009 to U+000D). A
    text of fewer words is one shingle, one without words has none.
    """
    out, bounds, at = [], [0], 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to] or "") < CHUNK):
            size += len(texts[to] or "") + 1
            to += 1
        hashes, n = _chunk([t or "" for t in texts[at:to]], words, keys)
        out.append(hashes)
        bounds += (bounds[-1] + np.cumsum(n)).tolist()
        at = to
    return [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64) for k in range(len(keys))], np.array(bounds, np.int64)


def _chunk(texts: list[str], words: int, keys: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    cp, start, end, first = _words(texts)
    n_words, n, out = np.diff(first), _sizes(first, words), []
    keep = np.repeat(first[:-1], n) + _ramps(n)
    for key in keys:
        h = span_hashes(cp, start, end, key)
        padded = np.concatenate((h, np.zeros(words, np.uint64)))
        whole = mix(sum(padded[k : k + len(h)] * _STEP[k] for k in range(words)) + np.uint64(words))
        for d in np.flatnonzero((n_words > 0) & (n_words < words)):
            k, at = int(n_words[d]), int(first[d])
            whole[at] = mix((h[at : at + k] * _STEP[:k]).sum(keepdims=True) + np.uint64(k))[0]
        out.append(whole[keep])
    return out, n


def exact_shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of every text's shingles, equal where their words are, letter by letter; and the texts' bounds."""
    cp, start, end, first = _words(texts)
    code, distinct = spans_coded(cp, start, end)
    n, padded = _sizes(first, words), np.concatenate((code, np.full(words, distinct)))
    at = np.repeat(first[:-1], n) + _ramps(n)
    last = np.repeat(first[1:], n)
    out = padded[at]
    for k in range(1, words):
        out = pd.factorize(out * np.int64(distinct + 1) + np.where(at + k < last, padded[at + k], distinct))[0]
    return out, np.concatenate(([0], np.cumsum(n)))


def similar(a: list[str | None], b: list[str | None], words: int, num: int, den: int) -> list[bool]:
    """Whether den * intersection >= num * union for the full shingle sets of each pair of texts."""
    out, at = [], 0
    while at < len(a):
        size, to = 0, at
        while to < len(a) and (to == at or size < CHUNK):
            size += len(a[to] or "") + len(b[to] or "")
            to += 1
        codes, bounds = exact_shingles([t or "" for pair in zip(a[at:to], b[at:to], strict=True) for t in pair], words)
        for i in range(0, 2 * (to - at), 2):
            x, y = np.unique(codes[bounds[i] : bounds[i + 1]]), np.unique(codes[bounds[i + 1] : bounds[i + 2]])
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(den * both >= num * (len(x) + len(y) - both))
        at = to
    return out


def _ramps(n: np.ndarray) -> np.ndarray:
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) - np.repeat(total - n, n)


def distinct_sets(texts: list[str | None], words: int, keys: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's set of shingle hashes by the first key, sorted within it, those by other keys beside them; and the texts' bounds."""
    found, bounds = shingle_hashes(texts, words, keys)
    h = found[0]
    order = np.lexsort((h, np.repeat(np.arange(len(texts)), np.diff(bounds)))) if len(keys) > 1 else None
    if order is None:
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            h[s:e].sort()
    else:
        found = [x[order] for x in found]
        h = found[0]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][bounds[:-1] < len(h)]] = True
    return [x[new] for x in found], np.concatenate(([0], np.cumsum(new)))[bounds]


def signatures(docs: DataFrame, words: int, halves: int = HALVES, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (size of the set), d1 and d2 (a digest of the set, of two independent hashes of its words), half (2 * halves half keys; zeros: no set)."""
    mult, add = _multiplier(5, 2 * halves * rows), _multiplier(7, 2 * halves * rows)

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = batch.slice(at, 512)
                (sets, other), bounds = distinct_sets(got.column(1).to_pylist(), words, (0, 1))
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                half = np.zeros((len(n), 2 * halves), np.uint64)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    at_ = bounds[full]
                    for k in range(2 * halves):
                        key = np.full(len(full), k, np.uint64)
                        for r in range(rows):
                            i = k * rows + r
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((sets ^ add[i]) * mult[i], at_))
                        half[full, k] = key
                    d1[full] = np.add.reduceat(mix(sets ^ add[0]), at_)
                    d2[full] = np.add.reduceat(mix(other + add[1]), at_)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2 * halves, pa.int32()), pa.array(half.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([got.column(0), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], names=["id", "n", "d1", "d2", "half"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, "id long, n long, d1 long, d2 long, half array<long>")


def _candidates(classes: DataFrame, halves: int) -> DataFrame:
    """key, id, n, size, leader, leader_n: every class in each table's bucket of two or more."""
    half = storage.settle(classes.select("id", "n", F.posexplode("half").alias("k", "h")))
    shared = half.groupBy("k", "h").agg(F.count("*").alias("c")).where("c > 1").select("k", "h")
    kept = half.join(shared, ["k", "h"]).groupBy("id", "n").agg(F.collect_list(F.when(F.col("k") < halves, F.struct("k", "h"))).alias("a"), F.collect_list(F.when(F.col("k") >= halves, F.struct("k", "h"))).alias("b"))
    keys = storage.settle(kept.select("id", "n", F.explode("a").alias("a"), "b").select("id", "n", "a", F.explode("b").alias("b")).select(F.xxhash64("a.k", "a.h", "b.k", "b.h").alias("key"), "id", "n"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("leader"), F.min_by("n", "id").alias("leader_n")).where("size > 1")
    out = storage.settle(join_unique(keys, buckets, "key"))
    storage.forget(half, keys)
    return out


SALT = 512  #: pairs of one document that one task compares, at least


def _confirm(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """pairs (a, b), each with linked: whether den * intersection >= num * union on the full sets, words compared letter by letter.

    A document of very many pairs goes to several tasks, once each.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = storage.settle(docs.join(ids, "id", "left_semi").select("id", "text"))
    many = storage.settle(pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > SALT).select("a", F.ceil(F.col("c") / SALT).cast("int").alias("salts")))
    dealt = join_unique(pairs, many, "a", "left").withColumn("s", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(many, "a", "left").select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("s"))
    both = dealt.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "s"])

    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b, a, ta, tb = (batch.slice(at, 128).column(i) for i in range(4))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(similar(ta.to_pylist(), tb.to_pylist(), words, num, den), pa.bool_())], names=["a", "b", "linked"])

    out = storage.settle(both.select("b", "a", "ta", "tb").mapInArrow(compare, "a long, b long, linked boolean"))
    storage.forget(texts, many)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, halves: int = HALVES, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable by links, kept says whether that is the row's own.
    Texts without words (null, empty or blank) have an empty set and are linked with nothing. Rows
    of one id are one document: links of any of them count. A row whose id is null is linked like
    others but names no component: its component_id is that of the rest of its class of equal
    sets, or null (and kept) if there is none. Very long texts are hashed whole, in memory that
    grows with the text. Empty tables give no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = storage.settle(signatures(docs, words, halves, rows, "id", "text"))
    same = F.struct("n", "d1", "d2")
    classes = storage.settle(sig.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.any_value("half").alias("half")).where("id is not null"))
    several = storage.settle(sig.where("id is not null and n > 0").groupBy("id").agg(F.min(same).alias("least"), F.max(same).alias("most")).where("least < most").select("id"))
    split = sig.where("n > 0").join(several, "id", "left_semi").select("id", "n", "d1", "d2").distinct().join(classes.select("n", "d1", "d2", F.col("id").alias("rep")), ["n", "d1", "d2"])
    bridges = storage.settle(split.join(split.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")).where("a < b"))
    cand = _candidates(classes, halves)
    pool = storage.settle(docs.join(cand.select("id").distinct(), "id", "left_semi").select("id", "text"))

    # First each class with the smallest leader that it meets: most copies of a large group are joined by that alone.
    pairs = storage.settle(cand.where("id != leader").where(_fit("n", "leader_n", percent)).groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")))
    told = _confirm(pairs, pool, words, percent, 100)
    roots = components(told.where("linked").select("a", "b").unionByName(bridges))
    for exact in (False, True):
        own = storage.settle(cand.select("key", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
        apart = own.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min_by(F.struct("id", "n", "root"), F.xxhash64("id")).alias("l")).where("r1 < r2").select("key", "l")
        left = storage.settle(join_unique(own, apart, "key"))
        storage.forget(own)
        if left.isEmpty():
            storage.forget(left)
            break
        if exact:
            pairs = _rare_pairs(left.select("id", "root").distinct(), pool, words, percent)
        else:
            pairs = left.where("root != l.root").where(_fit("n", "l.n", percent)).select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b"))
        pairs = storage.settle(pairs.distinct().join(told.select("a", "b"), ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            told = told.unionByName(_confirm(pairs, pool, words, percent, 100))
            roots = components(told.where("linked").select("a", "b").unionByName(bridges))
        storage.forget(left, pairs)
    storage.forget(pool, cand, several, bridges)
    named = classes.select("n", "d1", "d2", "id").join(roots, "id", "left").select("n", "d1", "d2", F.coalesce("root", "id").alias("component"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    out = join_unique(sig, named, ["n", "d1", "d2"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _fit(x: str, y: str, percent: int):
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _rare_pairs(ids: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs of ids (with their roots) that can be linked, whose roots differ.

    Exact: with shingles ordered by how few of these documents have them, sets that are similar
    enough share one among their first n - ceil(n * percent / 100) + 1, at places that leave room
    for the overlap they need. What only a few common passages join has its own rare shingles
    in front, and so meets nobody.
    """

    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                got = batch.slice(at, 256)
                (h,), bounds = distinct_sets(got.column(1).to_pylist(), words)
                n = np.diff(bounds)
                uid = np.array([mix(h[s:e]).sum(dtype=np.uint64) for s, e in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([got.column(0), pa.array(uid.view(np.int64)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))], names=["id", "uid", "n", "h"])

    texts = docs.join(ids.select("id"), "id", "left_semi").select("id", "text")
    tokens = storage.settle(texts.mapInArrow(sets, "id long, uid long, n long, h array<long>").where("n > 0").select("id", "uid", "n", F.explode("h").alias("h")))
    shared = storage.settle(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    lists = tokens.join(shared, "h").groupBy("id", "uid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    lists = lists.withColumn("x", F.filter("x", lambda t, k: (k == 0) | (F.get("x", k - 1)["h"] != t["h"])))  # rows that repeat an id and its text
    first, alone = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1, F.col("n") - F.size("x")
    front = lists.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("x", F.lit(1), F.greatest(first - alone, F.lit(0)).cast("int"))).alias("k", "t")).select(F.col("t.h").alias("h"), "id", "n", (F.col("k") + F.col("alone")).alias("at"))
    every = storage.settle(front.join(ids, "id").select("h", "id", "n", "at", "root"))
    apart = every.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("h")
    front = storage.settle(every.join(apart, "h"))
    other = front.select("h", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "root")))
    room = (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
    met = front.join(other, "h").where((F.col("id") < F.col("id2")) & (F.col("root") != F.col("root2")) & room & _fit("n", "n2", percent))
    out = storage.settle(met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct())
    storage.forget(tokens, shared, every, front)
    return out


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, all columns: one document of each group.

    Of several rows with one id, one stays. Rows without id, which nothing can name, stay all.
    """
    id_name = storage.free_name(docs, "kept_id")
    found = storage.settle(near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(id_name)).agg(F.count("*").alias("c")))
    mine = docs[id_col].cast("long")
    once, often = found.where("c = 1").select(id_name), found.where("c > 1").select(id_name)
    out = docs.join(once, mine == F.col(id_name), "left_semi")
    if not often.isEmpty():
        out = out.unionByName(docs.join(often, mine == F.col(id_name), "left_semi").dropDuplicates([id_col]))
    return out.unionByName(docs.where(docs[id_col].isNull()))
