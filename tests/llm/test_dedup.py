"""Near-duplicates of texts and vectors against brute force, and components."""

import collections
import random
import re

import numpy as np

from lodestone.llm import minhash, vectors
from lodestone.llm.graph import components


def union(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(pairs * 2, "a long, b long")
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = union(real, {i for p in real for i in p})
    assert {r["id"]: r["root"] for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    pairs = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                pairs.append((a, b))
    return sets, union(pairs, {d for d, _ in rows})


def test_near_duplicates(spark, odd, nothing):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(60)]
    for i in range(150):  # a large family around the threshold, far and near
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(60)] = rng.choice(words)
        rows.append((1000 + i, " ".join(t)))
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 30))]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join([*t[:-1], "end"]))]
    rows += [(500, "One two THREE four"), (501, "one  two\nthree four"), (502, "One"), (503, "one"), (504, "É"), (505, "é")]
    sets, want = brute(rows, 4, 80)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=4).collect()
    assert sorted(map(tuple, got)) == sorted((d, len(s), want[d], want[d] == d) for d, s in sets)
    assert len(set(want.values())) < len(rows) - 60
    odds = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()}
    assert odds[2][1:] == (1, False) and odds[3] == (0, 3, True) and odds[5] == (0, 5, True) and odds[7] == (1, 7, True) and odds[None] == (1, None, True)
    assert minhash.near_duplicates(nothing).count() == 0


def test_like_words_and_weak_hashes_link_nothing(spark, monkeypatch):
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    b = a.translate({97: 98, 98: 97})
    rows = [(1, a), (2, b), (3, f"{a} {a} {b} {b} {a}"), (4, f"{b} {b} {a} {a} {b}"), (5, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    plain = __import__("lodestone.llm.words", fromlist=["x"])._spelled
    monkeypatch.setattr("lodestone.llm.words._spelled", lambda *a: (plain(*a)[0] % np.uint64(3), *plain(*a)[1:]))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "C", "dd"]) for _ in range(rng.randrange(9))) for _ in range(400)]
    x, y = texts[::2], texts[1::2]
    s = [(shingles(t, 3), shingles(u, 3)) for t, u in zip(x, y, strict=True)]
    assert minhash.similar(x, y, 3, 50, 100) == [100 * len(t & u) >= 50 * len(t | u) for t, u in s]


def test_rows_of_hot_keys_stay(spark):
    from lodestone.llm.storage import join_unique, settle

    left = settle(spark.range(3000).selectExpr("if(id < 1000, null, if(id < 2000, 7, id)) k", "id v"))
    right = spark.range(0, 2500).selectExpr("id k", "id * 2 w")
    for how in ("inner", "left"):
        assert sorted(map(str, join_unique(left, right, "k", how, least=1).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_rare_step_takes_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:29_000], *(f"v{i}" for i in range(1000))])), (3, " ".join(reversed(words)))]
    docs = spark.createDataFrame(rows, "id long, text string")
    roots = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, root long")
    assert list(map(tuple, minhash._rare_pairs(roots, docs, 5, 80).collect())) == [(1, 2)]


def test_one_id_with_two_texts_joins_them(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {1}


def test_deduplicate_keeps_columns(odd, nothing):
    out = minhash.deduplicate(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "3", "4", "5", "None", "7", "8", "9", "10"])
    assert minhash.deduplicate(nothing).count() == 0


def test_hashes_do_not_depend_on_neighbours():
    texts = ["x y z w v", "", "one two three four five six", "One TWO three"]
    alone = [minhash.distinct_sets([t], 4)[0][0].tolist() for t in texts]
    (h,), b = minhash.distinct_sets(texts, 4)
    assert (minhash.distinct_sets(texts, 4, (0, 1))[0][0] == h).all()
    assert [h[s:e].tolist() for s, e in zip(b[:-1], b[1:], strict=True)] == alone


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24))
    centre = rng.standard_normal(24)
    x[:80] = centre + rng.standard_normal((80, 24)) * 0.28
    for i in range(100, 160, 2):
        x[i + 1] = x[i] * 3 + rng.standard_normal(24) * 0.2
    x[200] = x[201] = x[202]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (None, x[5].tolist()), (907, x[7].tolist()), (907, x[7].tolist()), (908, [1e200] * 24), (909, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = vectors.near_duplicate_vectors(df, window=32).collect()
    every = [(i, np.array(v, float)) for i, v in rows + odd if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    every = [(i, v / np.abs(v).max()) for i, v in every]
    links, pairs = collections.Counter(), []
    for k, (i, v) in enumerate(every):
        for m, (j, w) in enumerate(every):
            if k != m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                links[k] += 1
                pairs.append((k, m))
    root = union(pairs, range(len(every)))
    least = {}
    for k, (i, _) in enumerate(every):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = [(i, links[k], least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(every)]
    named = {i for i, _ in every}
    want += [(i, 0, i, True) for i, _ in odd if i not in named]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_passes_grow_with_the_logarithm():
    assert vectors.passes_for(10, 0.9) == vectors.LEAST_PASSES
    assert vectors.passes_for(10**6, 0.9) < vectors.passes_for(10**9, 0.9) < 300


def test_lone_pairs_in_a_dense_cone_are_found(spark):
    rng = np.random.default_rng(6)
    dim, cone, lone = 64, 2400, 200
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    axis = unit(rng.standard_normal((1, dim)))
    free = lambda n: unit((v := rng.standard_normal((n, dim))) - (v @ axis.T) * axis)
    around = free(cone)
    close = around[:lone]
    across = free(lone)
    across = unit(across - (across * close).sum(1, keepdims=True) * close)
    c = (0.902 - 0.8) / 0.2
    around = np.concatenate((around, c * close + np.sqrt(1 - c * c) * across))
    x = np.concatenate((np.sqrt(0.8) * axis + np.sqrt(0.2) * around, unit(rng.standard_normal((4000, dim)))))
    near = x @ x.T >= 0.9
    want = near.sum(axis=1) - 1
    assert (want > 0).sum() >= 2 * lone
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(rows, window=16).collect()}
    root = union(np.argwhere(np.triu(near, 1)).tolist(), range(len(x)))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == [(want[i], root[i]) for i in range(len(x))]


def test_ties_at_the_threshold_link_everywhere(spark):
    """Pairs of small whole numbers whose cosine is exactly 0.9: counts, components and the SQL agree."""
    import duckdb

    from lodestone.llm import queries

    rng, pairs = random.Random(5), []
    for k in range(60):  # 9 / (1 * 10), and 9 / (2 * 5), at odd scales
        a, b = rng.choice([([1, 0, 0, 0, 0, 0], [9, *rng.sample([3, -3, 1], 3), 0, 0]), ([1, 1, 1, 1, 0, 0], [*rng.sample([4, 2, 2, 1], 4), 0, 0])])
        pairs.append(([(2 * k + 1) * x for x in a], b))
    rows = []
    for k, (a, b) in enumerate(pairs):  # each pair in a place of its own, so that it meets no other
        wide = lambda v, k=k: [0.0] * (6 * k) + [float(x) for x in v] + [0.0] * (6 * (59 - k))
        rows += [(2 * k, wide(a)), (2 * k + 1, wide([3 * x for x in b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicate_vectors(df).collect()}
    assert got == {i: (1, i - i % 2) for i in range(120)}
    db = duckdb.connect()
    table = df.toArrow()
    db.register("embeddings", table)
    assert {r[0]: (r[1], r[2]) for r in db.sql(f"SELECT vec_id, n_links, component_id FROM ({queries.ORACLES['op2_projection_near_dedup']})").fetchall()} == got


def test_one_formula_decides():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-9, 10, (80, 6)).astype(float), rng.integers(-9, 10, (80, 6)).astype(float)
    x[(x == 0).all(axis=1)] = y[(y == 0).all(axis=1)] = 1
    for threshold in (0.9, 0.5, 0.0):
        whole = vectors.alike(x, y, threshold)
        assert (whole == [[vectors.cosine(a, b) >= threshold for b in y] for a in x]).all()
        assert (vectors.alike(y, x, threshold) == whole.T).all() and (vectors.alike(x[:1], y, threshold) == whole[:1]).all()
