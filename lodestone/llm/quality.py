"""Document quality: random-indexing word vectors, pooled, and a two-layer network with a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import storage
from lodestone.llm.words import CHUNK, LETTER, classes, cuts, points, pretokens, span_hashes

BUCKETS, DIM, NONZERO, REACH = 1 << 15, 48, 4, 2
SAMPLE = 6000  #: labelled rows that the network is fitted on, at most
SLICES = 16  #: parts of the table of sums, each added up on its own
FAN, LEVELS = 64, 3  #: tables that one task adds up, and how often before the last addition
SHAPES = 5  #: lower, title, upper, mixed, no letters: a word's shape has a vector too
EXTRA = 3


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, one for each bucket and then each shape."""
    rng = np.random.default_rng(23)
    out, n = np.zeros((BUCKETS + SHAPES, DIM), np.int8), BUCKETS + SHAPES
    for _ in range(NONZERO):
        out[np.arange(n), rng.integers(0, DIM, n)] = rng.choice([-1, 1], n)
    return out


@lru_cache(maxsize=1)
def _upper() -> np.ndarray:
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of every word of the texts, and the texts' bounds."""
    mark = "\U0010ffff"
    cp = points(mark.join(t.replace(mark, " ") for t in texts) + mark)
    start, end = pretokens(cp, "word")
    h = span_hashes(cp, start, end)
    ups = np.concatenate(([0], np.cumsum(_upper()[cp])))
    n_up, n = ups[end] - ups[start], end - start
    shape = np.select([classes()[cp[start]] != LETTER, n_up == 0, (n_up == 1) & _upper()[cp[start]], n_up == n], [4, 0, 1, 2], 3)
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    return (h >> np.uint64(49)).astype(np.int64), shape, bounds


def _batches(texts: list[str | None]):
    """Runs of texts of about CHUNK characters: (first, texts); long ones in parts, so that no array grows with one text."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        for part in cuts(t) if t and len(t) > CHUNK else (t or "",):
            if held and size + len(part) > CHUNK:
                yield first, held
                held, size = [], 0
            if not held:
                first = k
            held.append((k, part))
            size += len(part) + 1
    if held:
        yield first, held


def contexts(texts: list[str | None], into: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words around it."""
    index = index_vectors()
    for _, held in _batches(texts):
        bucket, shape, bounds = words([t for _, t in held])
        if not len(bucket):
            continue
        own = index[bucket].astype(np.int32) + index[BUCKETS + shape]
        owner = np.repeat(np.arange(len(held)), np.diff(bounds))
        around = np.zeros_like(own)
        for d in range(1, REACH + 1):
            same = (owner[d:] == owner[:-d])[:, None]
            around[:-d] += own[d:] * same
            around[d:] += own[:-d] * same
        for row in (bucket, BUCKETS + shape):
            order = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.diff(row[order], prepend=-1))
            into[row[order[first]]] += np.add.reduceat(around[order], first, axis=0)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its words' vectors, and the logarithm of their number, the share of repeats, and the mean's length. Without words: zeros."""
    total, n, seen = np.zeros((len(texts), DIM)), np.zeros(len(texts)), np.zeros(len(texts))
    for _, held in _batches(texts):
        bucket, shape, bounds = words([t for _, t in held])
        who, count = np.array([k for k, _ in held]), np.diff(bounds)
        full = np.flatnonzero(count)
        if not len(full):
            continue
        sums = np.add.reduceat(vectors[bucket] + vectors[BUCKETS + shape], bounds[full], axis=0, dtype=np.float64)
        np.add.at(total, who[full], sums)
        np.add.at(n, who, count)
        order = np.lexsort((bucket, np.repeat(np.arange(len(held)), count)))
        b = bucket[order]
        new = np.ones(len(b), bool)
        new[1:] = b[1:] != b[:-1]
        new[bounds[full]] = True
        np.add.at(seen, who[full], np.add.reduceat(new, bounds[full], dtype=np.int64))
    mean = total / np.maximum(n, 1)[:, None]
    return np.column_stack((mean, np.log1p(n), 1 - seen / np.maximum(n, 1), np.linalg.norm(mean, axis=1)))


@dataclass
class Network:
    """Input standardised, a tanh layer, a logistic unit, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 3) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature is fitted on the rest.

    Without rows, or with one label only, the score is that label's share everywhere.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    rng, k = np.random.default_rng(seed), x.shape[1]
    net = Network(x.mean(0) if len(x) else np.zeros(k), (x.std(0) if len(x) else np.zeros(k)) + 1e-3, np.zeros((k, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    held = np.arange(len(y)) % 5 == 4
    xt, yt = np.clip((x[~held] - net.mean) / net.scale, -6, 6), y[~held]
    p = [rng.normal(0, 1 / np.sqrt(k), (k, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(net.b2)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, epochs + 1):
        z = np.tanh(xt @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(z @ p[2] + p[3], -40, 40))) - yt) / len(yt)
        back = np.outer(g, p[2]) * (1 - z * z)
        grads = [xt.T @ back + decay * p[0] / len(yt) ** 0.5, back.sum(0), z.T @ g + decay * p[2] / len(yt) ** 0.5, g.sum()]
        for i, gr in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * gr, 0.999 * v[i] + 0.001 * gr * gr
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3])
    z, yh = net.logits(x[held]), y[held]
    loss = lambda temp: np.logaddexp(0, np.where(yh > 0, -z, z) / temp).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss)) if len(yh) else 1.0
    return net


@dataclass
class Model:
    vectors: np.ndarray
    net: Network

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, score for every row; null and empty texts have the score of no words.

        Null ids stay null, repeated rows come again with equal scores, an empty table gives none;
        texts over CHUNK characters are pooled in parts. Other columns are not read.
        """
        vectors, net = self.vectors, self.net

        def rate(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    got = batch.slice(at, 1024)
                    yield pa.RecordBatch.from_arrays([got.column(0), pa.array(net.score(pooled(got.column(1).to_pylist(), vectors)))], names=["doc_id", "score"])

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(rate, "doc_id long, score double")

    def keep(self, docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
        """The rows of docs whose score is at least least; all columns stay."""
        vectors, net = self.vectors, self.net

        @F.pandas_udf("boolean")
        def good(texts):
            import pandas as pd

            return pd.Series(np.concatenate([net.score(pooled(texts[i : i + 1024].tolist(), vectors)) >= least for i in range(0, len(texts), 1024)] or [np.zeros(0, bool)]))

        return docs.where(good(F.col(text_col)))


def held_out(id_col):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 3, is 1; rows without id are."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def word_sums(texts: DataFrame, fan: int = FAN, levels: int = LEVELS) -> np.ndarray:
    """The sums of contexts() over all rows of texts (one column), null ones included as empty.

    Each task makes one table, cut into SLICES. Tables are added up in a tree: at every level a
    task gets one slice of fan neighbours' tables, so that no task gets those of all. Sums are whole
    numbers: the order of additions changes nothing.
    """
    schema = "slice int, part long, used binary, sums binary"

    def out(k: int, part: int, own: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(own.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int64()), pa.array([used.astype("<i4").tobytes()]), pa.array([own[used].astype("<i8").tobytes()])], names=["slice", "part", "used", "sums"])

    def gather(batches):
        into = np.zeros((BUCKETS + SHAPES, DIM), np.int64)
        for batch in batches:
            contexts(batch.column(0).to_pylist(), into)
        if into.any():
            part = TaskContext.get().partitionId()
            for k in range(SLICES):
                yield out(k, part, into[k::SLICES])

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, part = (int(x.as_py()) for x in key)
        own = np.zeros((len(range(k, BUCKETS + SHAPES, SLICES)), DIM), np.int64)
        for batch in tables:
            for used, sums in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own[np.frombuffer(used, "<i4")] += np.frombuffer(sums, "<i8").reshape(-1, DIM)
        yield out(k, part, own)

    parts = texts.mapInArrow(gather, schema)
    for level in range(levels + 1):
        group = F.floor(F.col("part") / fan) if level < levels else F.lit(0).cast("long")
        parts = parts.withColumn("part", group).groupBy("slice", "part").applyInArrow(add, schema)
    total = np.zeros((BUCKETS + SHAPES, DIM), np.int64)
    for k, _, used, sums in parts.collect():
        total[k::SLICES][np.frombuffer(bytes(used), "<i4")] = np.frombuffer(bytes(sums), "<i8").reshape(-1, DIM)
    return total


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from labelled rows that are not held out.

    Word vectors are summed over every row of docs, labelled or not; the network is fitted on at
    most sample labelled rows, those whose hashed ids come first. Labels that are null, or whose
    document is missing, are skipped; an id with several labels has the least of them. Words share
    BUCKETS places by their hashes, so a large corpus has several words in one. Sums and pooled
    rows are made on executors (see word_sums); the driver gets one table and a row of numbers for
    each sampled document.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.min(label_col).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    known = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = storage.settle(known.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).repartition(8))

    total = word_sums(known.select("t"))
    vectors = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)).astype(np.float32)

    def pool(batches):
        for batch in batches:
            x = pooled(batch.column(2).to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["k", "y", "x"])

    got = sorted(map(tuple, rows.select("k", "y", "t").mapInArrow(pool, "k long, y int, x array<double>").collect()))
    storage.forget(rows)
    x = np.array([r[2] for r in got]).reshape(len(got), DIM + EXTRA)
    order = np.random.default_rng(1).permutation(len(got))
    return Model(vectors, train(x[order], np.array([r[1] for r in got], np.float64)[order]))


__all__ = ["Model", "Network", "contexts", "fit", "held_out", "pooled", "train", "word_sums", "words"]
