"""Source divergence, ranked search and the streaming encoder: against brute force, the library and edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lodestone.llm import divergence, search, storage, transducer

BYTE = P.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, least=10, top=10):
    docs = [((r["lang"] or ""), (r["source"] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))) for r in rows]
    df, n, groups = collections.Counter(), collections.Counter(), {(lang, src) for lang, src, _ in docs}
    for lang, src, terms in docs:
        df.update((lang, t) for t in set(terms))
        n.update((lang, src, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for x, t in df if x == lang and df[x, t] >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(counts, kept=kept):
            total = sum(counts) + 2 * len(kept)
            return [1 + 10**9 * (c + 2) // total for c in counts]

        p = {s: shares([n[lang, s, t] for t in kept]) for s in sources}
        q = shares([sum(n[lang, s, t] for s in sources) for t in kept])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            term = [(t, f(a, b)) for t, a, b in zip(kept, p[s], q, strict=True) if n[lang, s, t] and a > b]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


def test_divergence_of_odd_rows(spark, odd, nothing):
    rng = random.Random(5)
    words = ["Über", "ZOO", "zoo", "a", "b", "c", "日本", "x1y", "é"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None]), None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(300)]
    rows += [("one", "alone", "zoo " * 20), ("bare", "x", "q"), ("bare", "y", "r"), ("bare", "z", None)]
    made = spark.createDataFrame([(*r, 0, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(3)
    for df, least in ((made, 10), (odd, 10), (odd, 1), (made.where("lang = 'bare'"), 10)):
        assert sorted(map(tuple, divergence.divergence(df, least).collect())) == plain_divergence(df.collect(), least)
    assert divergence.divergence(nothing).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    for n, total, kept in ((0, 0, 1), (8_999_999_998, 10**10, 7), (10**12, 3 * 10**12 + 1, 10**8), (10**15, 10**15, 1)):
        got = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.share("n", "total", "kept")).first()[0]
        assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def plain_search(docs, items, k):
    terms = lambda t: [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms, df = sum(bool(w) for _, w in held), sum(len(w) for _, w in held), collections.Counter()
    for _, w in held:
        df.update(set(w))
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, want in asked.items():
        scores = []
        for d, w in held:
            tf, m = collections.Counter(w), 50 + 50 * len(w) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in want if tf[t])
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, pairs", [(1 << 20, 1 << 16), (300, 1 << 16), (1, 40)])
def test_search_equals_brute_force(spark, shard, pairs):
    """However documents lie in shards, and in however many slices items are searched; with very common words, copies, ties."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(40)))) for i in range(400)]
    docs += [(1000 + i, "W1 w2, w3-w4") for i in range(60)] + [(None, "w5 w5"), (7, "w5 w5"), (2000, None), (2001, ""), (2002, "... !"), (2003, "w0 " * 3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "w1"), (52, "w2 w3"), (None, "w4 w5"), (53, "w0 w0")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, score long, rank int").repartition(4)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in search.search(d, q, k=10, shard=shard, pairs_at_once=pairs).collect()]
    assert sorted(got, key=repr) == plain_search(docs, items, 10)


def test_bounds_stop_before_all_postings_are_met():
    """Far from all postings are met when the best are few and clear; results are those of all."""
    rng = np.random.default_rng(2)
    n, weights = 4000, np.array([9000, 8000, 7000, 300, 200, 100], np.int64)
    rows = [sorted({3, 4, 5} | ({0, 1, 2} if i % 97 == 0 else set()) - ({4} if i % 3 else set())) for i in range(n)]
    first, terms = np.cumsum([0, *map(len, rows)]), np.array([t for r in rows for t in r])
    shard = search.Shard(rng.integers(60, 140, n), first, terms, rng.integers(1, 4, len(terms)), weights)
    asked, met, sums = np.arange(6), [], search._sums
    full = sums(np.repeat(np.arange(n), np.diff(first)), shard.own, n, 6)
    try:
        search._sums = lambda docs, *rest: (met.append(len(docs)), sums(docs, *rest))[1]
        docs, scores = shard.best(asked, 10, np.zeros(0, np.int64))
    finally:
        search._sums = sums
    assert sum(met) < len(terms) / 4
    want = np.lexsort((np.arange(n), -full))[:10]
    assert [(full[i], i) for i in want] == sorted(zip(scores.tolist(), docs.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:10]


def test_search_of_nothing(spark, odd, nothing):
    q = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.search(nothing, q).count() == 0 and search.search(odd, q.limit(0)).count() == 0
    assert search.search(odd, q.withColumn("text", q.text.substr(1, 0))).count() == 0


def test_words_of_long_texts_in_parts():
    text = ("Ab é9_x " * (search.PART // 4)).encode()
    assert len(list(search.words(text))) > 1 and [w for part in search.words(text) for w in part] == [w.encode() for w in ("ab", "é9", "x")] * (search.PART // 4)


def odd_texts():
    rng = random.Random(3)
    letters = " '\nasltrevdmé12.!\t ΣİǄ́\x00͸\U0010ffff🙂日"
    texts = [None, "", "it's 'super 's \n's  'll''re <|endoftext|>x", "͸ a.\x00 b. c.", "<|endoftext|><|endoftext|>", "<|endoftext", "a" * 5000, " " * 3000 + "x", "ÃÂ" * 2000, "-" * 4000, "=-" * 3000]
    texts += ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choices("abetinghors", k=rng.randrange(3000))) for _ in range(20)]
    return texts + ["".join(rng.choices(["ÃÂ", "Ã", "Â", "-", "--", "=", "==", " ", "aa", "a", "0", "00"], k=rng.randrange(3000))) for _ in range(60)]


def test_stream_equals_the_library(spark):
    lib, texts = Tokenizer.from_file(BYTE), odd_texts()
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, ids binary").repartition(3)
    coded = storage.settle(transducer.encode(df, BYTE))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in transducer.digests(coded, BYTE).collect()}
    assert len(got) == len(texts)
    for i, ids in want.items():
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: r["text"] for r in transducer.decode(coded, BYTE).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_stream_holds_a_window_and_emits_only_final_tokens():
    m, rng = transducer.machine(BYTE), random.Random(4)
    for text in (t for t in odd_texts() if t and len(t) > 2000):
        data, machine, out, at = text.encode(), transducer.Transducer(m), [], 0
        while at < len(data):
            step = rng.randrange(1, 900)
            out += machine.feed(data[at : at + step])
            at += step
            assert len(machine.held) < 2 * m.window
        assert out + machine.finish() == m.fold(data)


def test_lookahead_follows_the_chains_of_merges():
    a, b, c, d = b"a", b"b", b"c", b"d"
    assert transducer.sufficient_lookahead([]) == 0
    assert transducer.sufficient_lookahead([(a, b)]) == 1
    # ab changes when c follows: bc first, then a stays alone; d a when a stays alone.
    assert transducer.sufficient_lookahead([(b, c), (a, b), (d, a)]) == 3
    for broken in ([(b"ab", c)], [(a, b), (b"ab", c), (b, c), (a, b"bc")]):
        with pytest.raises(ValueError):
            transducer.sufficient_lookahead(broken)
    # Every small list: what a stream with this lookahead emits is final.
    rng = random.Random(1)
    for _ in range(60):
        made, merges = [a, b, c], []
        for _ in range(rng.randrange(1, 7)):
            u, v = rng.choice(made), rng.choice(made)
            if u + v not in made:
                made.append(u + v)
                merges.append((u, v))
        far = transducer.sufficient_lookahead(merges)

        def fold(s, merges=merges):
            t = [bytes([x]) for x in s]
            for u, v in merges:
                i = 0
                while i < len(t) - 1:
                    if t[i] == u and t[i + 1] == v:
                        t[i : i + 2] = [u + v]
                    i += 1
            return t

        for _ in range(60):
            whole = bytes(rng.choices(b"abc", k=24))
            cut = rng.randrange(25)
            end, final = 0, []
            for t in fold(whole[:cut]):
                end += len(t)
                if end <= cut - far:
                    final.append(t)
            assert fold(whole)[: len(final)] == final


def test_decoder_is_incremental():
    m = transducer.machine(BYTE)
    decoder, ids = transducer.TextDecoder(m), m.fold("é日🙂x".encode())
    assert "".join([decoder.feed([i]) for i in ids] + [decoder.finish()]) == "é日🙂x"
    broken = [m.first[0xE6], m.first[0x97], m.first[0x41], m.first[0xFF], 10**6, m.first[0xF0]]
    assert decoder.feed(broken) + decoder.finish() == Tokenizer.from_file(BYTE).decode(broken, skip_special_tokens=False) == "�A��"


def test_stream_of_odd_rows(spark, odd, nothing):
    lib = Tokenizer.from_file(BYTE)
    got = sorted((repr(r["doc_id"]), len(r["ids"]) // 4) for r in transducer.encode(odd, BYTE).collect())
    assert got == sorted((repr(r["doc_id"]), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert transducer.digests(transducer.encode(nothing, BYTE), BYTE).count() == 0
