"""One query for each operator, over whole tables; and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, divergence, licences, minhash, mpeg, packing, pii, quality, rans, search, sharding, storage, transducer, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def packed() -> DataFrame:
        pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added=True)
        digests = storage.settle(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
        return packing.pack(digests, ties=("doc_id", "piece"))

    return storage.alone(spark, packed)


def op2_projection_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.alone(spark, lambda: vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9))


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = F.col("ids")
    digests = (F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(bpe.decode_tokens(F.col("tokens"), path), 256).alias("decoded_sha256"))
    return storage.alone(spark, lambda: bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select("doc_id", *digests))


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    def written() -> DataFrame:
        path = storage.new_path(spark)
        rans.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)
        return rans.read_tokens(spark, path, keep_ids=False)

    return storage.alone(spark, written)


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_candidate_boosting_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(mpeg.store_texts(_table(spark, sf_dir, "documents")))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = storage.alone(spark, lambda: sharding.shard_documents(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.alone(spark, lambda: minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.alone(spark, lambda: divergence.divergence(_table(spark, sf_dir, "documents")))


def op12_impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.alone(spark, lambda: search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return transducer.digests(transducer.encode(_table(spark, sf_dir, "documents"), path), path)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_projection_near_dedup, op3_byte_level_bpe, op4_rans_tokens, op5_random_indexing_quality, op6_candidate_boosting_pii, op7_mpeg_audio, op8_hilbert_sharding, op9_licence_dice, op10_minhash_near_dedup, op11_source_divergence, op12_impact_ordered_search, op13_streaming_bpe)}

_COMPONENTS = """links(a, b) AS ({links}),
reach(id, root) AS (SELECT {id}, {id} FROM {rows} UNION SELECT b, root FROM reach JOIN links ON a = id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

# All pairs, which only small tables allow.
_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * x)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
{_COMPONENTS.format(links="SELECT p.vec_id, q.vec_id FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_inner_product(p.e, q.e) / sqrt(p.n * q.n) >= 0.9", id="vec_id", rows="v")}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON id = vec_id"""

# Every pair of documents with a common shingle.
_SHINGLES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n + q.n AS total, count(*) AS c FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
{_COMPONENTS.format(links="SELECT a, b FROM shared WHERE 100 * c >= 80 * (total - c)", id="doc_id", rows="documents")}
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON id = doc_id"""

ORACLES: dict[str, str] = {"op2_projection_near_dedup": _VECTORS, "op9_licence_dice": licences.oracle(), "op10_minhash_near_dedup": _SHINGLES, "op11_source_divergence": divergence.ORACLE, "op12_impact_ordered_search": search.ORACLE}
