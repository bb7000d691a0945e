"""Ranked lexical search, score at a time, over postings that lie by descending impact.

A posting's impact is the exact whole number that it adds to a document's score. Documents lie in
shards; in a shard each term's postings are grouped by equal impact, groups from the greatest
down. An item takes the groups of all its terms in descending order, a turn of them after another,
until the bounds of what remains prove that no document without a posting so far can be among the k
best, and that few of the others can: these get their complete scores from their own rows. A task
carries each item's best scores from shard to shard, so that the proof comes sooner and sooner.
Nothing is skipped without it, so results equal those of a full evaluation; scores never move
between machines but those of each task's best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import storage

K1000, HALF = 1_000_000_000, 50
PAIRS = 1 << 16  #: (item, term) pairs that are searched at once; more items are searched in slices
SHARD = 1 << 20  #: postings that a shard's documents have, but for one document's
STEP = 2  #: each turn goes on to impacts that are so many times smaller
FEW = 8  #: completing a score counts as so many postings for each of a document's terms
PART = 1 << 20  #: bytes of a text that are split at once

# What is no ASCII letter or digit separates terms; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(raw: bytes):
    """Lists of a UTF-8 text's terms, a bounded part of it after another."""
    at = 0
    while len(raw) - at > PART:
        cut = raw.find(b" ", at + PART)
        if cut < 0:
            break
        yield raw[at:cut].translate(_FOLD).split()
        at = cut
    yield raw[at:].translate(_FOLD).split()


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, term (binary): the distinct terms of each item; rows of one id are one item."""

    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {w for part in words(raw or b"") for w in part}
                ids += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def _counted(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary), tf: one row for each document."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            n, terms, tf = [], [], []
            for raw in batch.column(1).to_pylist():
                total, counts = 0, {}
                for part in words(raw or b""):
                    total += len(part)
                    for w in part:
                        if (t := known.get(w)) is not None:
                            counts[t] = counts.get(t, 0) + 1
                n.append(total)
                terms.append(list(counts))
                tf.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def _sums(docs: np.ndarray, values: np.ndarray, n: int, terms: int) -> np.ndarray:
    """Exact sums for each of n documents; doubles hold those of 2^17 terms."""
    if terms <= 1 << 17:
        return np.bincount(docs, values, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, docs, values)
    return out


class Shard:
    """Some documents' postings: by term from the greatest impact down, and by document."""

    def __init__(self, m: np.ndarray, first: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        """m of each document, where its terms begin (and the last ends), terms and tf of all of them."""
        self.n, self.first, self.terms = len(m), first, terms
        doc = np.repeat(np.arange(len(m)), np.diff(first))
        self.own = weights[terms] * ((K1000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.lexsort((-self.own, terms))
        self.impact, self.doc = self.own[order], doc[order]
        self.falling, self.begin = -self.impact, np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.asked = np.zeros(len(weights), bool)

    def best(self, terms: np.ndarray, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the shard that can be among the k best, and their scores (above 0); held: k or fewer scores of other documents."""
        begin, end = self.begin[terms], self.begin[terms + 1]
        some = end > begin
        begin, end, n_terms = begin[some], end[some], len(terms)
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, at, level = np.zeros(self.n, np.int64), begin, int(self.impact[begin].max())
        while True:
            level //= STEP
            to = np.array([a + np.searchsorted(self.falling[a:e], -level, side="right") for a, e in zip(at, end, strict=True)])
            spans = [slice(a, e) for a, e in zip(at.tolist(), to.tolist(), strict=True) if e > a]
            if spans:
                low += _sums(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.impact[s] for s in spans]), self.n, n_terms)
            at = to
            left = np.where(at < end, self.impact[np.minimum(at, end - 1)], 0)
            rest, pool = int(left.sum()), np.concatenate((low, held))
            kth = max(1, int(-np.partition(-pool, k - 1)[k - 1]) if len(pool) >= k else 1)
            if not rest:
                found = np.flatnonzero(low >= kth)
                return found, low[found]
            if kth > rest:
                # At most: what a document has, and the greatest impact left of each term that it was not met with.
                met = _sums(np.concatenate([self.doc[a:e] for a, e in zip(begin, at, strict=True)]), np.repeat(left, at - begin), self.n, n_terms)
                found = np.flatnonzero(low + rest - met >= kth)
                if FEW * int((self.first[found + 1] - self.first[found]).sum()) <= int((end - at).sum()):
                    scores = self._complete(found, terms)
                    good = scores >= kth
                    return found[good], scores[good]

    def _complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        n = self.first[docs + 1] - self.first[docs]
        place = np.repeat(self.first[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.asked[terms] = True
        mine = self.asked[self.terms[place]]
        self.asked[terms] = False
        return _sums(np.repeat(np.arange(len(docs)), n)[mine], self.own[place[mine]], len(docs), len(terms))


class Best:
    """An item's k best so far: scores descending, then ids, null ones first."""

    def __init__(self, k: int):
        self.k, self.scores, self.known, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        scores, known, ids = np.append(self.scores, scores), np.append(self.known, known), np.append(self.ids, ids)
        order = np.lexsort((ids, known, -scores))[: self.k]
        self.scores, self.known, self.ids = scores[order], known[order], ids[order]


def _searched(batches, asks: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, most: int):
    """Batches doc_id, n, terms, tf -> q, doc_id, score: the k best of all of them for each of asks."""
    best = [Best(k) for _ in asks]
    for batch in batches:
        known, ids = np.asarray(batch.column(0).is_valid()), batch.column(0).fill_null(0).to_numpy()
        m = HALF + (HALF * batch.column(1).to_numpy() * n_docs) // n_terms
        sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
        terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        first = np.concatenate(([0], np.cumsum(sizes)))
        a = 0
        while a < len(m):
            e = max(a + 1, int(np.searchsorted(first, first[a] + most, side="right")) - 1)
            shard = Shard(m[a:e], first[a : e + 1] - first[a], terms[first[a] : first[e]], tf[first[a] : first[e]], weights)
            for own, mine in zip(best, asks, strict=True):
                docs, scores = shard.best(mine, k, own.scores)
                if len(docs):
                    own.add(scores, known[a:e][docs], ids[a:e][docs])
            a = e
    for q, own in enumerate(best):
        if len(own.scores):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.scores), q, np.int32)), pa.array(own.ids, mask=~own.known), pa.array(own.scores)], names=["q", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pairs_at_once: int = PAIRS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by doc_id.

    Null and empty texts have no terms. Every row of docs is a document, repeated ids too (their
    order among equal scores and ids is any); null ids come first among equals, as in any sort.
    Rows of one item id, null among them, are one item with all their terms. Items without terms,
    or whose terms no document holds, have no rows; empty tables give none. Other columns are not
    read. Long texts are split in parts; only the items' terms of a document are kept.

    Only the items' terms go to all tasks: at most pairs_at_once in a slice of the items (but never
    less than one item's), and a slice is searched after another. A task holds a shard, of at most
    that many postings or one document, and k scores of each item of the slice.

    Settles tables: call it in a scope.
    """
    pairs = storage.settle(_items(items, item_col, item_text_col))
    slices = max(1, -(-pairs.count() // pairs_at_once))
    place = F.pmod(F.xxhash64("item_id"), F.lit(slices))
    found = [_search(docs, pairs.where(place == s) if slices > 1 else pairs, k, id_col, text_col, shard) for s in range(slices)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(docs: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str, shard: int) -> DataFrame:
    spark, asked, known = docs.sparkSession, {}, {}
    for item, term in pairs.toLocalIterator():
        asked.setdefault(item, []).append(known.setdefault(bytes(term), len(known)))
    shared = spark.sparkContext.broadcast(known)
    rows = storage.settle(_counted(docs, shared, id_col, text_col))
    shared.destroy()
    total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = int(total[0]), max(1, int(total[1] or 0))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    frequency = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weights = np.zeros(max(1, len(known)), np.int64)
    for t, w in frequency.select("t", weight).toLocalIterator():
        weights[t] = w
    asks = spark.sparkContext.broadcast([np.array(sorted(t for t in terms if weights[t] > 0), np.int64) for terms in asked.values()])
    best = rows.select("doc_id", "n", "terms", "tf").mapInArrow(lambda batches: _searched(batches, asks.value, weights, n_docs, n_terms, k, shard), "q int, doc_id long, score long")
    last = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = storage.settle(best).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(asked)), "q int, item_id long")
    return ranked.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = """WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w)) AS n_terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), totals),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * n_docs) // n_terms AS BIGINT))))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
