"""Byte-level byte-pair encoding and decoding.

A word's bytes are a list of token ids; a higher-order fold replaces, merge after merge, the pair
with the lowest rank, until no pair has one. Ranks come from a literal map: a perfect hash over
the pairs of tokens whose bytes together are a token. A bounded table
of folded words that are frequent in a sample goes to all tasks; what other words some texts have
is folded where they are, once for the texts of a chunk, so no text or word travels. Decoding joins
the tokens' pieces.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import storage
from lodestone.llm.words import CHUNK, UNKNOWN, classes, cuts, points, spelled

SAMPLE_DOCS, TABLE_WORDS, TABLE_BYTES = 1 << 16, 1 << 19, 64
HOT_WORDS = 1 << 14  #: longer words, up to LONG bytes, are in the table if they are more than one in so many of the sample's words
CHUNK_ROWS, CHUNK_BYTES = 2048, 1 << 23  #: rows, and bytes of text beyond one row's, whose ids lie together and whose other words are folded together
HELD = 1 << 17  #: words that a task counts before it hands their counts on
LONG, BLOCK = 1024, 0.5  #: words of more bytes are folded in blocks of BLOCK * sqrt(bytes) tokens
_EDGE, _NONE = 65535, 65536
_P, _S, _C, _D = 65521, 196613, 668265261, 40503  # sizes and factors of the perfect hash
_SEP = "\u0100"  #: no byte's character


class Ranks:
    """The vocabulary's literals: byte ids, the pair table, and pieces, a character for each byte."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if len(ranks) > _EDGE or max(ranks.values()) >= _EDGE:
            raise ValueError("the vocabulary has more than 65,535 tokens")
        pairs = {(ranks[t[:i]] << 16) + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        pairs.setdefault(0, _NONE)
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.shift, self.table = perfect_hash(pairs)
        self.pieces = [""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.pieces[r] = t.decode("latin-1")


def perfect_hash(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Shifts by key mod _P, and a table with (key << 16) + value at (key * _C + shift * _D) mod _S; empty places hold 0,
    which only key 0 would match: it must be among the pairs."""
    keys = np.fromiter(pairs, np.int64, len(pairs))
    home = (keys * _C) % _S
    order = np.argsort(keys % _P, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff((keys % _P)[order])) + 1)
    taken, shift, table = np.zeros(_S, bool), [0] * _P, [0] * _S
    for g in sorted(groups, key=len, reverse=True):
        if len(set(home[g].tolist())) < len(g):
            raise ValueError("two pairs can't be told apart by this hash")
        for s in range(_S):
            at = (home[g] + s * _D) % _S
            if not taken[at].any():
                break
        else:
            raise ValueError("the pair table is too full")
        taken[at] = True
        shift[int(keys[g[0]] % _P)] = s
        for k, a in zip(keys[g].tolist(), at.tolist(), strict=True):
            table[a] = (k << 16) + pairs[k]
    return shift, table


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _strings(values: list[str]) -> Column:
    return F.split(F.lit(_SEP.join(values)), _SEP)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once; unlike a transform, an aggregate copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def fold(word: Column, r: Ranks) -> Column:
    """The ids of one word (array<bigint>): its bytes, merged by rank."""
    tables = F.struct(storage.long_array(r.shift).alias("shift"), storage.long_array(r.table).alias("table"), storage.long_array(r.bytes).alias("first"))
    return _let(tables, lambda q: F.when(F.octet_length(word) > LONG, _fold_blocks(word, q)).otherwise(_fold_plain(word, q)))


def _rank(pair: Column, q: Column) -> Column:
    """Of a pair (left * 2^16 + right) the merged token, or _NONE."""
    return _let(pair, lambda k: F.least(F.lit(_NONE).cast("bigint"), F.get(q["table"], F.pmod(k * F.lit(_C) + F.get(q["shift"], F.pmod(k, F.lit(_P))) * F.lit(_D), F.lit(_S))).bitwiseXOR(k * F.lit(65536))))


def _ranked(keys: Column, q: Column) -> Column:
    return F.transform(keys, lambda k: _rank(k, q))


def _bytes(word: Column, q: Column) -> Column:
    chars = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.get(q["first"], F.ascii(c)))


def _neighbours(t: Column) -> Column:
    return F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: a * F.lit(65536) + b)


def _fold_plain(word: Column, q: Column) -> Column:
    """Every merge makes one list anew, of tokens between two edges, each one number: the rank of its pair with the next * 2^32
    + its place at the start * 2^16 + its id. So the least number is the pair to merge: the first of those with the least rank."""

    def of(n: int) -> Column:
        return F.lit(n).cast("bigint")

    def token(x: Column) -> Column:
        return x.bitwiseAND(of(65535))

    def first(t: Column) -> Column:
        return F.transform(t, lambda x, i: _rank(x * F.lit(65536) + F.coalesce(F.get(t, i + 1), of(_EDGE)), q) * of(1 << 32) + i * of(65536) + x)

    def merge(acc: Column, _: Column) -> Column:
        def with_least(least: Column) -> Column:
            def at(i: Column) -> Column:
                best = F.shiftright(least, 32)
                left = _let(F.get(acc, i - 2), lambda x: _rank(token(x) * F.lit(65536) + best, q) * of(1 << 32) + x.bitwiseAND(of((1 << 32) - 1)))
                own = _rank(best * F.lit(65536) + token(F.get(acc, i + 1)), q) * of(1 << 32) + least.bitwiseAND(of(0xFFFF0000)) + best
                return F.flatten(F.array(F.slice(acc, F.lit(1), i - 2), F.array(left, own), F.slice(acc, i + 2, F.size(acc))))

            return F.when(least >= of(_NONE << 32), acc).otherwise(_let(F.array_position(acc, least).cast("int"), at))

        return _let(F.array_min(acc), with_least)

    edge = F.array(of((_NONE << 32) + _EDGE))
    start = _let(_bytes(word, q), lambda t: F.flatten(F.array(edge, first(t), edge)))
    done = F.aggregate(F.array_repeat(F.lit(0), F.octet_length(word) - 1), start, merge)
    return F.filter(F.transform(done, token), lambda i: i != F.lit(_EDGE))


def _fold_blocks(word: Column, q: Column) -> Column:
    """The same for long words: tokens lie in blocks, and a merge makes anew one block, or three at a block's edge, and the list of blocks.

    A block has tokens t, of each the rank r of its pair with the next, and the least of these, m.
    """
    edge = F.lit(_EDGE).cast("bigint")
    room = F.ceil(F.sqrt(F.octet_length(word)) * F.lit(BLOCK)).cast("int")

    def block(t: Column, r: Column, at: Column, n: Column) -> Column:
        return _let(F.slice(r, at, n), lambda own: F.struct(F.slice(t, at, n).alias("t"), own.alias("r"), F.array_min(own).alias("m")))

    def dealt(t: Column, r: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(t) / size).cast("int") - 1), lambda k: block(t, r, k * size + 1, size))

    start = _let(_bytes(word, q), lambda t: _let(_ranked(_neighbours(F.concat(t, F.array(edge))), q), lambda r: dealt(t, r, room)))

    def merge(acc: Column, _: Column) -> Column:
        def with_least(least: Column) -> Column:
            def with_best(best: Column) -> Column:
                def in_block(j: Column) -> Column:
                    own = F.get(acc, j - 1)["r"]
                    return _let(F.array_position(own, best).cast("int"), lambda i: _let(F.when((i > 1) & (i < F.size(own)), F.struct(j.alias("low"), j.alias("high"))).otherwise(F.struct(F.greatest(j - 1, F.lit(1)).alias("low"), F.least(j + 1, F.size(acc)).alias("high"))), among))

                def among(reach: Column) -> Column:
                    low, high = reach["low"], reach["high"]
                    near, after = F.slice(acc, low, high - low + 1), F.coalesce(F.get(F.get(acc, high)["t"], F.lit(0)), edge)

                    def with_near(x: Column) -> Column:
                        t, r = x["t"], x["r"]

                        def at(i: Column) -> Column:
                            before = F.when(i > 1, F.get(t, i - 2)).otherwise(edge)
                            then = F.coalesce(F.get(t, i + 1), after)

                            def with_pair(pair: Column) -> Column:
                                r_left = F.when(i > 1, F.concat(F.slice(r, F.lit(1), i - 2), F.slice(pair, 1, 1))).otherwise(F.array().cast("array<bigint>"))
                                merged = F.struct(F.concat(F.slice(t, F.lit(1), i - 1), F.array(best), F.slice(t, i + 2, F.size(t))).alias("t"), F.concat(r_left, F.slice(pair, 2, 1), F.slice(r, i + 2, F.size(r))).alias("r"))
                                return _let(merged, lambda y: dealt(y["t"], y["r"], F.ceil(F.size(y["t"]) / F.ceil(F.size(y["t"]) / room)).cast("int")))

                            return _let(_ranked(F.array(before * F.lit(65536) + best, best * F.lit(65536) + then), q), with_pair)

                        return _let(F.array_position(r, best).cast("int"), at)

                    new = _let(F.struct(F.flatten(F.transform(near, lambda b: b["t"])).alias("t"), F.flatten(F.transform(near, lambda b: b["r"])).alias("r")), with_near)
                    return F.concat(F.slice(acc, F.lit(1), low - 1), new, F.slice(acc, high + 1, F.size(acc)))

                return F.when(best >= _NONE, acc).otherwise(_let(F.array_position(least, best).cast("int"), in_block))

            return _let(F.array_min(least), with_best)

        return _let(F.transform(acc, lambda b: b["m"]), with_least)

    return F.flatten(F.transform(F.aggregate(F.array_repeat(F.lit(0), F.octet_length(word) - 1), start, merge), lambda b: b["t"]))


@lru_cache(maxsize=2)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def occurrences(texts: list[str | None], pattern: str):
    """Runs of texts, long ones in parts: (text of each part, code of each word, where each part's begin, the distinct words).

    The distinct words are compared letter by letter. Words are all matches of pattern; for the
    public pattern without a search, unless a text has code points that this Python does not know.
    """
    import public_tokenizers

    quick = pattern == public_tokenizers.PATTERN

    def searched(k: int, text: str):
        numbers: dict[str, int] = {}  # pandas would compare strings up to their first NUL
        code = np.array([numbers.setdefault(w, len(numbers)) for w in _matcher(pattern).findall(text)], np.int64)
        return [k], code, np.array([0, len(code)]), list(numbers)

    def split(held: list[tuple[int, str]]):
        code, bounds, words = spelled([t for _, t in held], "byte")
        return [k for k, _ in held], code, bounds, words

    held, size = [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if not quick or not text.isascii() and (classes()[points(text)] >= UNKNOWN).any():
            yield searched(k, text)
            continue
        for part in cuts(text) if len(text) > CHUNK else (text,):
            if held and size + len(part) > CHUNK:
                yield split(held)
                held, size = [], 0
            held.append((k, part))
            size += len(part) + 1
    if held:
        yield split(held)


class Table:
    """Folded words: a list of ids each, and a mark for every other word."""

    def __init__(self, table: pa.Table):
        """table: w (string) and ids (list of whole numbers)."""
        self.place = dict(zip(table.column("w").to_pylist(), range(table.num_rows), strict=True))
        ids = [c.flatten().to_numpy() for c in table.column("ids").chunks]
        self.ids = np.concatenate([*ids, [_EDGE]]).astype(np.uint16)
        self.n = np.append(pa.compute.list_value_length(table.column("ids")).to_numpy().astype(np.int64), 1)
        self.at = np.cumsum(self.n) - self.n

    def coded(self, texts: list[str | None], pattern: str) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
        """Of each text: ids with a mark in place of each word that is not here, which word that is, and these words."""
        out: list[list] = [[] for _ in texts]
        for who, code, bounds, words in occurrences(texts, pattern):
            here = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
            at = here[code] if len(code) else np.zeros(0, np.int64)
            n = self.n[at]
            total = np.concatenate(([0], np.cumsum(n)))
            ids = self.ids[np.repeat(self.at[at] - total[:-1], n) + np.arange(total[-1])]
            gap = np.flatnonzero(at < 0)
            owner = np.searchsorted(bounds, gap, side="right") - 1
            which, pairs = pd.factorize(owner * np.int64(len(words) + 1) + code[gap])
            pair_owner, pair_word = pairs // (len(words) + 1), pairs % (len(words) + 1)
            first, last = np.searchsorted(pair_owner, np.arange(len(who))), np.searchsorted(pair_owner, np.arange(len(who)), side="right")
            cut = np.searchsorted(owner, np.arange(len(who) + 1))
            for p, k in enumerate(who):
                out[k].append((ids[total[bounds[p]] : total[bounds[p + 1]]], which[cut[p] : cut[p + 1]] - first[p], [words[w] for w in pair_word[first[p] : last[p]]]))
        return [_joined(x) for x in out]


def _joined(parts: list[tuple[np.ndarray, np.ndarray, list[str]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    if not parts:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64), []
    if len(parts) == 1:
        return parts[0]
    seen: dict[str, int] = {}
    gaps = [np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)[which] for _, which, words in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate(gaps), list(seen)


def _frequent(texts: DataFrame, pattern: str, most: int) -> DataFrame:
    """Words of the texts, with the greatest counts, at most so many: w. Only a histogram of counts goes to the driver."""

    def count(batches):
        counts: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for _, code, _, words in occurrences(batch.column(0).slice(at, 512).to_pylist(), pattern):
                    for w, n in zip(words, np.bincount(code, minlength=len(words)).tolist(), strict=True):
                        counts[w] = counts.get(w, 0) + n
                if len(counts) > HELD:
                    yield rows()
                    counts.clear()
        yield rows()

    every = storage.settle(texts.select("t").mapInArrow(count, "w string, n long").where(F.octet_length("w") <= LONG).groupBy("w").agg(F.sum("n").alias("n")))
    hot = F.col("n") * HOT_WORDS > (every.agg(F.sum("n")).first()[0] or 0)  # fewer than HOT_WORDS
    long_ = F.octet_length("w") > TABLE_BYTES
    counted = every.where(~long_)
    left, least = most, None
    step = F.floor(F.log2("n") * 8)
    for k, n in sorted(counted.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = k
    return counted.where(step >= least if least is not None else F.lit(False)).select("w").unionByName(every.where(long_ & hot).select("w"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, ids (decimal ids joined by one space) of every row of docs.

    Null and empty texts have no ids (an empty string). Null ids and repeated rows are rows like
    any other; an empty table gives no rows; other columns are not read. Long texts are split in
    parts, long words folded in blocks, in time that grows little more than linearly.

    The table of frequent words comes from about sample_docs rows and has at most table_words of
    at most TABLE_BYTES bytes, and fewer than HOT_WORDS longer ones; these bound what goes to the
    driver and to every task, and change nothing but the time. Words outside it are rare or very long: each is
    folded once for each chunk of rows that has it, and nothing moves. Texts are read once after the sample; ids with gaps
    and the ids of the gaps' words are settled in between, so that a task has one Python worker at a time.

    tokens (the ids as a list) come with them.
    """
    r, spark = ranks(path), docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = texts.count()
    with storage.scope(spark):
        known = _frequent(texts.sample(min(1.0, sample_docs / rows), 5) if rows > sample_docs else texts, pattern, table_words) if rows else texts.select(F.col("t").alias("w")).limit(0)
        folded = known.select("w", fold(F.col("w"), r).cast("array<int>").alias("ids")).repartition(spark.sparkContext.defaultParallelism).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, folded.schema) as out:
        out.write_table(folded)
    del folded, out
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    del sink
    name = uuid.uuid4().hex

    def coded(batches):
        import zstandard

        zip_, table = zstandard.ZstdCompressor(3), _table(name, shared)
        for batch in batches:
            for got in _chunks(batch):
                rows, words = table.coded(got.column(1).to_pylist(), pattern), {}
                gaps = [np.array([words.setdefault(w, len(words)) for w in own], np.int64)[which] for _, which, own in rows]
                lists = [got.column(0).to_pylist(), [len(x[0]) for x in rows], [len(x) for x in gaps]]
                ids, gaps = (zip_.compress(np.concatenate(x).astype(kind).tobytes()) for x, kind in (([x[0] for x in rows], "<u2"), (gaps, "<u4")))
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(pa.int64())) for x in lists), pa.array([ids], pa.binary()), pa.array([gaps], pa.binary()), pa.array([list(words)], pa.list_(pa.string()))], names=["doc_id", "n_ids", "n_gaps", "ids", "gaps", "words"])

    def assembled(batches):
        import zstandard

        unzip, names = zstandard.ZstdDecompressor(), list(map(str, range(_EDGE)))
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, n_ids, n_gaps, ids, gaps, found = (c.slice(at, 1).flatten() if pa.types.is_list(c.type) else c[at].as_py() for c in batch.columns)
                ids, gaps = np.frombuffer(unzip.decompress(ids), "<u2"), np.frombuffer(unzip.decompress(gaps), "<u4")
                ids, size = _filled(ids, gaps, found.flatten().to_numpy(), pa.compute.list_value_length(found).to_numpy())
                end = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n_ids.to_numpy()))]
                words = list(map(names.__getitem__, ids.tolist()))
                lines = [" ".join(words[a:b]) for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(lines, pa.string()), pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids", "tokens"])

    chunks = "doc_id array<long>, n_ids array<long>, n_gaps array<long>, ids binary, gaps binary, words array<string>"
    found = F.transform("words", lambda w: fold(w, r)).cast("array<array<int>>").alias("found")
    once = storage.settle(texts.mapInArrow(coded, chunks).select("doc_id", "n_ids", "n_gaps", "ids", "gaps", found))
    return once.mapInArrow(assembled, "doc_id long, ids string, tokens array<int>")


def _chunks(batch: pa.RecordBatch):
    """Runs of rows of at most CHUNK_ROWS, and of CHUNK_BYTES of text or one row's."""
    size = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = min(at + CHUNK_ROWS, max(at + 1, int(np.searchsorted(size, before + CHUNK_BYTES, side="right"))))
        yield batch.slice(at, end - at)
        at, before = end, int(size[end - 1])


def _filled(ids: np.ndarray, gaps: np.ndarray, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with those of word gaps[k], which lie one word after another in flat (n of each), in place of the k-th mark; and how many came of each place."""
    size, begin = np.ones(len(ids), np.int64), np.arange(len(ids))
    hole, n = np.flatnonzero(ids == _EDGE), n.astype(np.int64)
    size[hole], begin[hole] = n[gaps], len(ids) + (np.cumsum(n) - n)[gaps]
    total = np.cumsum(size)
    source = np.concatenate((ids, flat.astype(np.uint16)))
    return source[np.repeat(begin - (total - size), size) + np.arange(int(size.sum()))], size


_held: tuple[str, Table] | None = None


def _table(name: str, shared) -> Table:
    """One for each worker, while it works on one table."""
    global _held
    if _held is None or _held[0] != name:
        _held = (name, Table(pa.ipc.open_stream(shared.value).read_all()))
    return _held[1]


def decode(ids: Column, path: str) -> Column:
    """The bytes of a line of decimal ids: its tokens' pieces, one after another."""
    return F.when(ids == "", F.lit(b"")).otherwise(decode_tokens(F.split(ids, " ").cast("array<int>"), path))


def decode_tokens(tokens: Column, path: str) -> Column:
    """The same of a list of ids."""
    pieces = _strings(ranks(path).pieces)
    return F.encode(F.array_join(F.transform(tokens, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def count(ids: Column) -> Column:
    return F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.translate(ids, " ", "")) + 1).cast("long")
