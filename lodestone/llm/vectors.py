"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors by a key of concatenated random hyperplane signs and compares every
one with a bounded window of those before it; verified pairs of all passes are united. A pair at
the threshold shares a sign with probability 1 - angle/pi, so the passes that a wanted chance of a
miss takes follow from the number of vectors and the window, and so does the length of the key's
prefix on which the pair has to agree in one of them. Vectors that share a prefix are one run. A
run that fits the window lies whole in one task, where windows reach over all of it; a longer one,
as dense regions have, is compared pair by pair in blocks. So the chance does not depend on how the
vectors are spread, and no candidate is dropped for being one of many. The passes carry sketches,
unit vectors in half precision, whose error has a bound: what it cannot decide is emitted and
compared in double precision, once. Windows and runs only have to connect a group: the exact step
after them compares the members of each component block by block, counting links without emitting
pairs. Equal vectors are one class.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import storage
from lodestone.llm.graph import components

WINDOW, MISS, LEAST_PASSES, BLOCK, KEY_BITS = 256, 1e-3, 16, 512, 62
RUN_BLOCK = 1024  #: vectors of a long run that meet as many others in one group


def passes_for(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a lone pair at the threshold is missed with this chance."""
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    met = same ** max(0.0, math.log2(max(1, n) / window))
    return max(LEAST_PASSES, math.ceil(math.log(miss) / math.log1p(-met)) if met < 1 else 1)


def prefix_bits(n: int, window: int = WINDOW) -> int:
    """Signs on which passes_for counts on a pair to agree, rounded down."""
    return min(KEY_BITS, max(0, math.floor(math.log2(max(1, n) / window))))


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(k: int, dim: int) -> np.ndarray:
    return np.random.default_rng([1009, k, dim]).standard_normal((dim, KEY_BITS))


def _classify(batches):
    """Rows id, dim, name (128 bits of the vector's hash; null: it links with nothing), vec (its doubles, scaled by a power of two, which is exact)."""
    for batch in batches:
        dims, names, vecs = [], [], []
        for v in batch.column(1).to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                x = np.ldexp(x, -int(np.frexp(top)[1])) if np.isfinite(top) and top > 0 else None
            data = None if x is None else (x + 0.0).tobytes()
            dims.append(0 if x is None else len(x))
            names.append(None if x is None else hashlib.blake2b(data, digest_size=16).digest())
            vecs.append(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(names, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "dim", "name", "vec"])


def _joined(mask: np.ndarray) -> np.ndarray:
    """The least index that each one reaches through mask."""
    label, n = np.arange(len(mask)), len(mask)
    while True:
        new = np.minimum(label, np.where(mask, label, n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def margin(dim: int) -> float:
    """What two sketches' product can be away from their vectors' cosine: rounding to 11 bits, twice, sums in single precision, and the least half."""
    return 2.0**-10 + 2.0**-20 + dim * 2.0**-22 + math.sqrt(dim) * 2.0**-24


def _sketch(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _links(cosine: np.ndarray, apart: np.ndarray | None, ids: np.ndarray, threshold: float, dim: int) -> pa.RecordBatch:
    """Sure links that join what sketches' products, a square, surely join; and each pair that may be linked beyond them. apart: the pairs to look at."""
    off = margin(dim)
    maybe = cosine >= threshold - off
    if apart is not None:
        maybe &= apart
    np.fill_diagonal(maybe, False)
    sure = maybe & (cosine >= threshold + off)
    root = _joined(sure | sure.T)
    new = np.flatnonzero(root != np.arange(len(ids)))
    x, y = np.nonzero(maybe & ~sure)
    open_ = root[x] != root[y]
    x, y = x[open_], y[open_]
    kinds = np.concatenate((np.ones(len(new), bool), np.zeros(len(x), bool)))
    a, b = ids[np.concatenate((root[new], x))], ids[np.concatenate((new, y))]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(kinds)], names=["a", "b", "sure"])


def _blocks(threshold: float):
    def compare(group: pa.Table) -> pa.Table:
        mine, i, j = (group.column(c).to_numpy() for c in ("mine", "i", "j"))
        x = _sketch(group.column("vec").to_pylist())
        return pa.Table.from_batches([_links(x @ x.T, mine[:, None] != mine if i[0] != j[0] else None, group.column("cid").to_numpy(), threshold, x.shape[1])])

    return compare


def _windows(threshold: float, window: int):
    def compare(batches):
        held_x, held_id, dim = None, None, None
        for batch in batches:
            dims, ids, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for s, e in zip(edges, edges[1:], strict=False):
                if dims[s] != dim:
                    dim, held_x, held_id = dims[s], np.zeros((0, dims[s]), np.float32), np.zeros(0, np.int64)
                for at in range(s, e, window):
                    x, own = _sketch(vecs[at : min(e, at + window)]), ids[at : min(e, at + window)]
                    both, both_id = np.concatenate((held_x, x)), np.concatenate((held_id, own))
                    cosine = np.full((len(both), len(both)), -2.0, np.float32)
                    cosine[len(held_x) :] = x @ both.T
                    if (cosine[len(held_x) :] >= threshold - margin(int(dim))).sum() > len(x):  # more than each with itself
                        yield _links(cosine, None, both_id, threshold, int(dim))
                    held_x, held_id = both[-window:], both_id[-window:]

    return compare


NEAR = 1e-9  #: cosines so near to the threshold are computed anew, each sum rounded once


def _doubles(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine that decides: sums of products, each rounded once, so it is the same whatever else is compared, and exact where it can be."""
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of x and each of y have a cosine of at least threshold."""
    out = (x @ y.T) / np.sqrt(np.outer((x * x).sum(axis=1), (y * y).sum(axis=1)))
    good = out >= threshold
    for i, j in zip(*np.nonzero(np.abs(out - threshold) <= NEAR), strict=True):
        good[i, j] = cosine(x[i], y[j]) >= threshold
    return good


def _verified(threshold: float):
    def compare(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.float64) for v in batch.column(i).to_pylist()] for i in (2, 3))
            good = [cosine(a, b) >= threshold for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return compare


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of df.

    n_links: other rows whose vector has a cosine (in doubles) of at least threshold with this one;
    component_id: the smallest id reachable by links; kept: whether it is the row's own. A vector
    that is null, empty, zero, or has null or non-finite parts links with nothing; vectors of
    different lengths are never linked. A cosine of exactly the threshold links, as cosine() rounds it. Equal vectors, rows of one id among them, are linked. A
    row without id counts for others' links, and is kept only if nothing in its component has an
    id. Empty tables give no rows; other columns are not read.
    """
    parts = T.ArrayType(T.DoubleType())
    rows = storage.settle(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(parts).alias("v")).mapInArrow(_classify, "id long, dim int, name binary, vec binary"))
    classes = rows.where("name is not null").groupBy("name", "dim").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
    classes = storage.settle(classes.withColumn("cid", F.monotonically_increasing_id()))
    total = classes.count()
    turns = passes_for(total, threshold, window, miss)

    shift = KEY_BITS - prefix_bits(total, window)

    def keys(whole: bool):
        def each(batches):
            weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
            for batch in batches:
                cid, dims, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    x = _unit([vecs[i] for i in own])
                    held = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
                    for k in range(turns):
                        key = (x @ _planes(k, int(dim)) > 0) @ weights
                        columns = [pa.array(np.full(len(own), k, np.int32)), pa.array(dims[own]), pa.array(key >> shift)]
                        more = [pa.array(key), pa.array(cid[own]), held] if whole else []
                        yield pa.RecordBatch.from_arrays(columns + more, names=["turn", "dim", "prefix", "key", "cid", "vec"][: len(columns + more)])

        return classes.select("cid", "dim", "vec").mapInArrow(each, "turn int, dim int, prefix long" + ", key long, cid long, vec binary" * whole)

    run = ["turn", "dim", "prefix"]
    long_runs = storage.settle(keys(False).groupBy(*run).agg(F.count("*").alias("n")).where(F.col("n") > window).select(*run, F.ceil(F.col("n") / RUN_BLOCK).cast("int").alias("blocks")))
    short = keys(True).join(long_runs, run, "left_anti").repartition(*run).sortWithinPartitions("turn", "dim", "key", "cid")
    mine = keys(True).join(long_runs, run).withColumn("mine", F.pmod(F.hash("cid"), F.col("blocks")))
    met = mine.select(*run, "cid", "vec", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    pair = "a long, b long, sure boolean"
    near = short.select("dim", "cid", "vec").mapInArrow(_windows(threshold, window), pair).unionByName(met.groupBy(*run, "i", "j").applyInArrow(_blocks(threshold), pair))
    met = storage.settle(near.where("a != b").groupBy("a", "b").agg(F.max("sure").alias("sure")))
    fetch = classes.select("cid", "vec")
    doubt = met.where("not sure").select("a", "b").join(fetch.select(F.col("cid").alias("a"), F.col("vec").alias("x")), "a").join(fetch.select(F.col("cid").alias("b"), F.col("vec").alias("y")), "b")
    found = storage.settle(met.where("sure").select("a", "b").unionByName(doubt.select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a long, b long")))
    storage.forget(long_runs, met)
    roots = components(found)
    members = storage.settle(classes.join(roots, classes.cid == roots.id).select("root", "cid", "copies", "vec"))
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = members.join(sizes, "root").withColumn("mine", F.pmod(F.hash("cid"), F.col("blocks")))
    dealt = block.select("root", "cid", "copies", "vec", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

    def count(group: pa.Table) -> pa.Table:
        mine, i, j = (group.column(c).to_numpy() for c in ("mine", "i", "j"))
        x, copies, cid = _doubles(group.column("vec").to_pylist()), group.column("copies").to_numpy(), group.column("cid").to_numpy()
        if i[0] == j[0]:
            n = alike(x, x, threshold) & ~np.eye(len(x), dtype=bool)
            links = n @ copies
        else:
            one = mine == i[0]
            n = alike(x[one], x[~one], threshold)
            links = np.zeros(len(x), np.int64)
            links[one], links[~one] = n @ copies[~one], n.T @ copies[one]
        return pa.table({"cid": cid, "links": links})

    links = dealt.groupBy("root", "i", "j").applyInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    least = members.select("root", "cid").join(classes.select("cid", "least"), "cid").groupBy("root").agg(F.min("least").alias("component"))
    named = classes.select("cid", "name", "least", "copies").join(links, "cid", "left").join(members.select("cid", "root").join(least, "root"), "cid", "left")
    named = named.select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "least").alias("component"))
    linked = storage.join_unique(rows.where("name is not null").select("id", "name"), storage.settle(named), "name", least=1).select("id", "n", "component")
    alone = rows.where("name is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = linked.unionByName(alone).select(F.col("id").alias("vec_id"), F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
