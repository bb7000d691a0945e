"""Packing, pair encoding, token files: against the libraries and brute force."""

import base64
import bisect
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, packing, rans, storage
from lodestone.llm.words import Encoder, cuts

WORD, BYTE, RANK = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("path, style", [(WORD, "word"), (BYTE, "byte")])
def test_encoder_equals_the_library(path, style):
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["", "it's 'super 's \n's  'll''re", "İ ΣΑΣ é", "\U0003fff0 's", "x\r\n\r\n  y\n z", "<|endoftext|> a"]
    texts += ["".join(rng.choice(" '\nasltrevdmé12.!\t ΣİǄ́") for _ in range(rng.randrange(50))) for _ in range(300)]
    enc = Encoder(path, style)
    enc.LIMIT = 400  # the memory is cleared several times
    for _ in range(2):
        got = enc.encode(texts)
        assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path, style", [(WORD, "word"), (BYTE, "byte")])
def test_added_tokens_equal_the_unmodified_library(path, style):
    lib, enc = Tokenizer.from_file(path), Encoder(path, style, added=True)
    contents = [t.content for t in lib.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in contents
    texts = [f"{a}{c}{b}" for c in [*contents, "<|EndOfText|>", "<|endoftext"] for a in ("", "a ", "É\n") for b in ("", " b", "<|endoftext|>x")]
    texts += ["plain words, no mark", "", "x" * 500_000 + " <|endoftext|> y"]
    assert [g.tolist() for g in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_queries_of_tokens_equal_the_unmodified_library(spark, tmp_path):
    from lodestone.llm import queries

    texts = {1: "a <|endoftext|> b", 2: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, path, end in ((queries.op1_best_fit_packing, WORD, 1), (queries.op4_rans_tokens, BYTE, 2)):
        lib = Tokenizer.from_file(path)
        want = {d: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for d, t in texts.items()}
        assert {r["doc_id"]: r["ids_crc32"] for r in query(spark, str(tmp_path)).collect()} == want


def twins(n=1024):
    """Two words of n letters that a polynomial modulo 2^64 cannot tell apart, whatever its odd base."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


@pytest.mark.parametrize("path, style", [(WORD, "word"), (BYTE, "byte")])
def test_words_that_polynomials_mix_up(path, style):
    lib = Tokenizer.from_file(path)
    texts = [w for n in (512, 1024, 2048, 4096) for w in twins(n)] + [" ".join(twins()), "x"]
    assert [g.tolist() for g in Encoder(path, style).encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path, style", [(WORD, "word"), (BYTE, "byte")])
def test_words_are_compared_and_not_only_their_hashes(path, style, monkeypatch):
    from lodestone.llm import words

    plain = words._spelled

    def weak(*a):  # only 16 hashes
        h, chars, first = plain(*a)
        return h % np.uint64(16), chars, first

    monkeypatch.setattr(words, "_spelled", weak)
    lib, enc = Tokenizer.from_file(path), Encoder(path, style)
    for texts in (["one", "two"], ["three four five six seven eight nine ten", "one", "", "a b c d e f g h i j k l m n o p q r s t"], ["one", "two 7 ''"]):
        assert [g.tolist() for g in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_words():
    from lodestone.llm.words import Memory

    m, rng, known = Memory(), np.random.default_rng(1), {}
    for _ in range(40):
        h = np.setdiff1d(rng.integers(0, 1 << 14, 300).astype(np.uint64) << np.uint64(8), np.array(list(known), np.uint64))
        n = rng.integers(1, 9, len(h))
        m.add(h, np.repeat(h, n).astype(np.uint32), n, np.repeat(h, n).astype(np.uint32), n)
        known |= dict(zip(h.tolist(), n.tolist(), strict=True))
    h = np.array([*known, 1, 2, 3], np.uint64)
    at = m.find(h)
    assert (at[-3:] == -1).all() and (m.keys[at[:-3]] == h[:-3]).all()
    ids, n = m.gather(at[:-3])
    assert n.tolist() == list(known.values()) and (ids == np.repeat(h[:-3], n).astype(np.uint32)).all()


def test_long_texts_are_cut_where_no_token_can_be():
    text = "ab  cd e\n f " * 3000
    parts = list(cuts(text, 1000))
    assert "".join(parts) == text and len(parts) > 10
    enc = Encoder(BYTE, "byte")
    assert np.concatenate(enc.encode(parts)).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def best_fit_bins(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        r = rooms.pop(i) if i < len(rooms) else capacity
        n += r == capacity and i >= len(rooms)
        bisect.insort(rooms, r - x)
    return rooms


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randrange(1, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(120))]
        runs = packing.plan({x: lengths.count(x) for x in set(lengths)}, capacity)
        fill, rank = {}, 0
        order = sorted(lengths, reverse=True)
        starts = [r[0] for r in runs] + [len(lengths)]
        for (first, length, per, b, off), end in zip(runs, starts[1:], strict=True):
            for k in range(end - first):
                assert order[rank] == length
                at = fill.setdefault(b + k // per, [])
                at.append((off + k % per * length, length))
                rank += 1
        assert rank == len(lengths)
        for at in fill.values():
            assert [o for o, _ in sorted(at)] == [sum(n for _, n in sorted(at)[:i]) for i in range(len(at))]
            assert sum(n for _, n in at) <= capacity
        assert sorted(capacity - sum(n for _, n in at) for at in fill.values()) == sorted(best_fit_bins(lengths, capacity))


def test_pack_documents(spark, odd, nothing):
    got = packing.pack_documents(odd, WORD).collect()
    lib = Tokenizer.from_file(WORD)
    lib.encode_special_tokens = True
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4
            at += r["length"]
        assert at <= 4096
    for doc, text in {(r["doc_id"], r["text"]) for r in odd.collect()} - {(7, "word")}:
        pieces = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["piece"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist()
        assert ids == lib.encode(text or "", add_special_tokens=False).ids + [1]
        assert all(r["length"] == 4096 for r in pieces[:-1])
    assert sum(r["doc_id"] == 7 for r in got) == 2
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_pack_other_columns_and_lengths(spark):
    df = spark.createDataFrame([(5, "a", 9), (None, "b", 9), (0, "c", 9), (5, "d", 9)], "length int, order string, sequence_id int")
    got = {r["order"]: (r["sequence_id"], r["offset"]) for r in packing.pack(df, capacity=10, ties=("order",)).collect()}
    assert got["b"] == got["c"] == (None, None) and got["a"] == (0, 0) and got["d"] == (0, 5)
    with pytest.raises(ValueError):
        packing.pack(df, capacity=4)


def test_rans_round_trip_and_segments():
    rng = np.random.default_rng(0)
    for n in (0, 1, 15, 17, 1000, 200_000):
        ids = (rng.zipf(1.3, n) % 50000).astype(np.uint32)
        freq = rans.quantise(np.bincount(ids, minlength=50258))
        assert n == 0 or freq.sum() == 1 << rans.BITS
        t = rans.Tables(freq)
        data = rans.pack_block(t, np.array([5]), np.array([0]), np.array([n], np.uint32), ids)
        block = rans.Block(data)
        assert (block.ids(t) == ids).all()
        assert (np.concatenate([block.ids(t, i) for i in range(len(block.offsets) + 1)]) == ids).all()
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(rans.Corrupt):
            rans.Block(bytes(broken))
    with pytest.raises(ValueError):
        t.encode(np.array([50257], np.uint32))


def test_token_files(spark, odd, nothing):
    lib = Tokenizer.from_file(BYTE)
    lib.encode_special_tokens = True
    for docs in (odd, nothing):
        path = storage.new_path(spark)
        rans.write_tokens(docs, path, BYTE)
        got = rans.read_tokens(spark, path).collect()
        want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: -1 if x[0] is None else x[0])
        at = 0
        for r, (doc, text) in zip(sorted(got, key=lambda r: r["start"]), want, strict=True):
            if doc != 7:
                ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
                assert (r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (doc, len(ids) // 4, zlib.crc32(ids), ids)
            assert r["start"] == at
            at += r["n_tokens"]


def test_token_files_of_repeated_ids_and_like_words(spark):
    a, b = twins()
    rows = [(5, "x y"), (5, "x"), (5, "x y z"), (3, a), (4, b), (None, "n"), (None, "m m"), *[(6, "same")] * 50]
    lib, want = Tokenizer.from_file(BYTE), None
    for parts in (1, 7):
        path = storage.new_path(spark)
        rans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), path, BYTE)
        got = sorted(map(tuple, rans.read_tokens(spark, path, keep_ids=False).collect()), key=lambda r: r[1])
        assert want is None or got == want
        want = got
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r[0]), r[3]) for r in got) == sorted((str(d), crc(t)) for d, t in rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def pair_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pair_encoding(spark, odd, nothing):
    lib = pair_library()
    a, b = twins()
    rng = random.Random(12)
    more = spark.createDataFrame([(20, a), (21, b), (22, "other words here " * 40_000 + "and a last one"), (24, "".join(rng.choice("abcdefghij") for _ in range(3000))), (25, "\U0003fff0 's \U0010ffff q"), *[(26, "many equal texts")] * 300], "doc_id long, text string")
    docs = odd.where("n = 0").select("doc_id", "text").unionByName(more)
    want = sorted((str(r["doc_id"]), (ids := lib.encode_ordinary(r["text"] or "")) and " ".join(map(str, ids)) or "", len(ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    for sample, table in ((1 << 16, 1 << 16), (30, 50)):  # words from the table, or few of them
        coded = bpe.encode(docs, RANK, P.PATTERN, sample_docs=sample, table_words=table)
        got = coded.select("doc_id", "ids", bpe.count(F.col("ids")).alias("n"), F.sha2(bpe.decode(F.col("ids"), RANK), 256).alias("d")).collect()
        assert sorted((str(r["doc_id"]), r["ids"], r["n"], r["d"]) for r in got) == want
    assert bpe.encode(nothing, RANK, P.PATTERN).count() == 0
    assert bpe.encode(docs.where("text is null or text = ''"), RANK, P.PATTERN).where("ids <> ''").count() == 0


def test_a_very_long_word(spark):
    word = "x" * 12_000 + "".join(random.Random(3).choice("abcdefghij") for _ in range(8_000))
    got = bpe.encode(spark.createDataFrame([(1, word)], "doc_id long, text string"), RANK, P.PATTERN).first()["ids"]
    assert got == " ".join(map(str, pair_library().encode_ordinary(word)))


def test_folds_of_words(spark, monkeypatch):
    lib, rng = pair_library(), random.Random(4)
    words = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in ("abc", "etaoinshr ", "é日Ж1") for n in (*range(1, 30), 100, 300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for long, block in ((1024, 0.5), (3, 0.1), (3, 0.5), (3, 2), (3, 30)):
        monkeypatch.setattr(bpe, "LONG", long)
        monkeypatch.setattr(bpe, "BLOCK", block)
        got = {r["w"]: r["ids"] for r in df.select("w", bpe.fold(F.col("w"), bpe.ranks(RANK)).alias("ids")).collect()}
        assert got == {w: lib._encode_single_piece(w.encode()) for w in words}


def test_a_merge_of_a_fold_makes_one_list_anew(spark):
    """A word's ranks and tokens lie in one list: equal to the library for equal ranks side by side, and few steps a merge."""
    lib = pair_library()
    words = ["a", "aaaaaaaaa", "ababababab", " andonrethou", " dieenerachie", "ééééé", "\x00\x00\x00", "z" * 1024, "abc" * 341]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["ids"] for r in df.select("w", bpe.fold(F.col("w"), bpe.ranks(RANK)).alias("ids")).collect()}
    assert got == {w: lib._encode_single_piece(w.encode()) for w in words}
    q = F.struct(*(F.array(F.lit(0).cast("bigint")).alias(n) for n in ("shift", "table", "first")))
    plan = df.select(bpe._fold_plain(F.col("w"), q).alias("ids"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("slice(") == 2


def test_texts_in_parts_keep_their_other_words(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr("lodestone.llm.words.CHUNK", 40)
    table = bpe.Table(pa.table({"w": [" b", "a"], "ids": [[7, 8], [9]]}))
    texts = ["a b c b d", None, " b" * 60 + " x", " x y" * 30 + " b z x", ""]
    ids, gaps, words = map(list, zip(*table.coded(texts, P.PATTERN), strict=True))
    assert words[0] == [" c", " d"] and words[2] == [" x"] and words[3] == [" x", " y", " z"] and words[4] == []
    assert gaps[3].tolist() == [0, 1] * 30 + [2, 0] and ids[0].tolist() == [9, 7, 8, 65535, 7, 8, 65535]
    assert ids[2].tolist() == [7, 8] * 60 + [65535]


def test_pair_encoding_of_odd_texts_equals_the_library(spark):
    """NUL beside code points that this Python does not know, long words that are common, and all kinds of characters."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK, "rb"))}
    lib, rng = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), random.Random(8)
    letters = " '\nasltrevdmé12.!\t ΣİǄ́\x00͸\U0010ffff🙂日\x01Ā\xff"
    texts = ["͸ a.\x00 b. c.", "\U0010ffff\x00\x00 x\x00", "Ā\x01ÿ\x00"] + ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(600)]
    texts += ["=" * 80 + " " + "-" * 100] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    coded = bpe.encode(df, RANK, P.PATTERN)
    got = {r["doc_id"]: (r["ids"], bytes(r["bytes"])) for r in coded.select("doc_id", "ids", bpe.decode(F.col("ids"), RANK).alias("bytes")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (" ".join(map(str, lib.encode_ordinary(t))), t.encode()), repr(t)


def test_words_outside_the_table_are_folded_where_they_are(spark, monkeypatch):
    """No bucketed table, no join, no shuffle after the sample; the list of ids decodes as the line does."""
    monkeypatch.setattr(storage, "bucketed", None)
    rows = [(i, f"odd{i % 7} w{i} " * (i % 5) + "x" * (i % 90)) for i in range(300)]
    df, lib = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), pair_library()
    coded = bpe.encode(df, RANK, P.PATTERN, sample_docs=20, table_words=10)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: (r["tokens"], r["ids"], bytes(r["b"])) for r in coded.withColumn("b", bpe.decode_tokens(F.col("tokens"), RANK)).collect()}
    for i, t in rows:
        ids = lib.encode_ordinary(t)
        assert got[i] == (ids, " ".join(map(str, ids)), t.encode())


def test_chunks_are_bounded_by_rows_and_bytes(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (k * 7 % 90) for k in range(50)])], names=["doc_id", "t"])
    for most, size in ((7, 1 << 20), (1 << 20, 100), (1 << 20, 1), (1 << 20, 1 << 20)):
        monkeypatch.setattr(bpe, "CHUNK_ROWS", most)
        monkeypatch.setattr(bpe, "CHUNK_BYTES", size)
        got = list(bpe._chunks(batch))
        assert [r for c in got for r in c.to_pylist()] == batch.to_pylist()
        assert all(0 < c.num_rows <= most and (c.num_rows == 1 or sum(map(len, c.column(1).to_pylist())) <= size) for c in got)
