"""How far the sources of a language differ in their words: plain relational.

Matches are exploded and counted by group, groups meet the kept vocabulary so that zeros count too,
and groups of one language are compared term by term in a join of that table with itself. All of it
is integers, so results are exact and do not depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import storage

#: Fixed value: ASCII letters, lower-cased before, and all that is not ASCII.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
_TWO_LEVELS = "spark.sql.codegen.aggregate.map.twolevel.enabled"  #: a small map before the large one, which so many terms only pass through
SPREAD = 10_000  #: rows of a language that one task meets with another's


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) of three columns, exactly; in decimals where 64 bits don't suffice."""
    over, under = f"({count} + 2)", f"({total} + 2 * {kept})"
    wide = f"(cast({SCALE} as decimal(10,0)) * cast({over} as decimal(20,0))) div cast({under} as decimal(20,0))"
    return F.expr(f"1 + if({over} < 9000000000, ({SCALE}L * {over}) div {under}, {wide})")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); fits 64 bits, as shares are at most 10^9 + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _meet(left: DataFrame, right: DataFrame, key: str, parts: int) -> DataFrame:
    """left joined with right on key, rows of one key dealt to so many tasks: left's each to one, right's to all."""
    part = storage.free_name(left, "part")
    dealt = left.withColumn(part, F.pmod(F.xxhash64(*left.columns), F.lit(parts)))
    copied = right.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(copied, [key, part]).drop(part)


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    part "pair": every other source of the language with the sum of distances over all kept terms;
    part "term": the group's top kept terms with a greater share than in its language. A language
    keeps the terms that at least least_docs of its rows hold. Null texts, languages and sources
    count as empty; rows are documents of their own, repeated or not; equal values rank by item, in
    the order of UTF-8. A language that keeps nothing has pairs of value 0; one source alone has no
    pairs; an empty table gives no rows. Other columns are not read. A text's matches are one
    array, so memory grows with the longest text, and with nothing else.

    Settles tables: call it in a scope.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).alias("text"))
    terms = docs.select("lang", "source", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    # Each text's terms twice: as often as they occur, and once each.
    both = F.explode(F.array(F.struct(F.col("terms"), F.lit(1).alias("n"), F.lit(0).alias("docs")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("docs"))))
    matches = terms.select("lang", "source", both.alias("b")).select("lang", "source", F.explode("b.terms").alias("term"), "b.n", "b.docs")
    with storage.setting(docs.sparkSession, _TWO_LEVELS, "false"):
        counted = storage.settle(matches.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))

    vocabulary = counted.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    vocabulary = storage.settle(vocabulary.select(F.monotonically_increasing_id().alias("t"), "lang", "term", "in_lang"))
    langs = storage.settle(vocabulary.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("kept")))
    kept = storage.settle(counted.join(vocabulary.select("lang", "term", "t"), ["lang", "term"]).select("lang", "source", "term", "t", "n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = storage.settle(groups.select(F.monotonically_increasing_id().alias("g"), "lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "lang_total"))))
    storage.forget(counted)

    found = storage.settle(storage.join_unique(kept, groups.select("lang", "source", "g"), ["lang", "source"]).select("g", "t", "n"))
    parts = max(1, -(-vocabulary.count() // SPREAD))
    zeros = _meet(vocabulary.select("lang", "t"), groups.where("kept > 0").select("lang", "g", "total", "kept"), "lang", parts)
    dense = zeros.join(found, ["t", "g"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    dense = storage.settle(dense.select("t", "g", share("n", "total", "kept").alias("p")))
    one, other = dense.select("t", F.col("g").alias("a"), "p"), dense.select("t", F.col("g").alias("b"), F.col("p").alias("q"))
    sums = storage.settle(one.join(other, "t").where("a < b").groupBy("a", "b").agg(F.sum(distance("p", "q")).alias("value")))  # the distance is symmetric

    bare = groups.where("kept = 0").select("lang", F.col("g").alias("a"))
    spread = max(1, -(-bare.count() // SPREAD))
    nothing = _meet(bare, bare.withColumnRenamed("a", "b"), "lang", spread).where("a <> b").select("a", "b", F.lit(0).cast("long").alias("value"))
    pairs = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).unionByName(nothing)
    items = groups.select(F.col("g").alias("b"), F.col("source").alias("item"))
    order = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.join(items, "b").select(F.col("a").alias("g"), F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))

    shares = kept.select("lang", "source", "term", "t", "n").where("n > 0").join(vocabulary.select("t", "in_lang"), "t")
    shares = storage.join_unique(storage.settle(shares), groups, ["lang", "source"]).select("g", F.col("term").alias("item"), share("n", "total", "kept").alias("p"), share("in_lang", "lang_total", "kept").alias("q"))
    most = shares.where("p > q").select("g", F.lit("term").alias("part"), "item", distance("p", "q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(most).join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", "rank")


ORACLE = """WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
m AS (SELECT lang, source, regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(terms) AS term FROM m) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM m) GROUP BY ALL HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
l AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
parts AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10"""
