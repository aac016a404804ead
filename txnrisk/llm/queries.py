"""Registered queries of the training-data operators and their DuckDB twins.

Each query applies its operator to the whole table with production
parameters and derives digest columns from the operator's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnrisk.llm import (embedding_dedup, exact_dedup, fuzzy_fingerprint, hard_negatives, jaccard_join, language_id, lexical_search,
                         line_dedup, quality_pu, sentencepiece_codec, source_mix, substring_dedup, toxicity_knn)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query()
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def held_out_fifth():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality_pu.train(docs.where(~held_out_fifth()), labels.where(~held_out_fifth()))
    score = F.col("quality_score")
    return (quality_pu.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out_fifth().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted")))


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = language_id.train(docs.where(~held_out))
    return (language_id.predict(docs, model)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "distance"))


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
      FROM l WHERE trim(line) <> ''),
w AS (SELECT a.doc_id, a.seq, a.line || chr(10) || b.line || chr(10) || c.line AS run
      FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.seq = a.seq + 1 JOIN n c ON c.doc_id = a.doc_id AND c.seq = a.seq + 2),
f AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) AS nth FROM w),
g AS (SELECT DISTINCT n.doc_id, n.i FROM f JOIN n ON n.doc_id = f.doc_id AND n.seq BETWEEN f.seq AND f.seq + 2 WHERE f.nth > 1),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN g USING (doc_id, i)
      WHERE g.doc_id IS NULL GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_runs(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_removed").cast("long").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("""
WITH RECURSIVE s AS (SELECT source IS NULL AS no_source, coalesce(source, '') AS name, count(*) AS n FROM documents GROUP BY 1, 2),
t AS (SELECT sum(n)::DOUBLE AS all_n, sum(sqrt(n)) AS all_w FROM s),
r AS (SELECT no_source, name, all_n / all_w * sqrt(n) / n AS rate FROM s, t),
c AS (SELECT no_source, name, rate, 0 AS j, exp(-rate) AS p, exp(-rate) AS c FROM r
      UNION ALL SELECT no_source, name, rate, j + 1, p * rate / (j + 1), c + p * rate / (j + 1) FROM c WHERE j < 80),
d AS (SELECT doc_id, source, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null') || '|2024|0'), 1, 13))::BIGINT
             / 4503599627370496.0 AS u FROM documents),
k AS (SELECT doc_id, source, count(*) AS n FROM d JOIN c ON c.no_source = (source IS NULL) AND c.name = coalesce(source, '') AND c.c <= d.u
      GROUP BY ALL)
SELECT doc_id, source, unnest(range(n))::INTEGER AS copy FROM k
""")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "source", F.col("__copy").alias("copy"))


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(
        _read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"),
        columns=("n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity_knn.train(docs, labels.where(~held_out_fifth()))
    return (toxicity_knn.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out_fifth().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                    "neighbours", "terms"))


@query()
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(_read(spark, sf_dir, "embeddings"))


@query(r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM d GROUP BY 1, 2),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
a AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
q AS (SELECT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS times FROM i GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term, nn),
s AS (SELECT q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * a.nn) // a.l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n ON n.doc_id = tf.doc_id, a GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents"))


@query("""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query()
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_fingerprint.next_likeness(_read(spark, sf_dir, "documents"))
