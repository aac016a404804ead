"""Corpus pipeline: the stages that turn raw documents into token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet under the shared folder and read again as the next one's
documents.  All but the last return the columns of ``documents``.

Every stage takes null ids and texts, empty and very long texts, repeated
rows, empty tables and further columns of any name (kept as they are, but for
the last stage): a null text counts as empty; rows without an id are never
near duplicates; of equal rows one stays after the exact stage.
"""

from __future__ import annotations

import gc

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnrisk.llm import exact_dedup, jaccard_join, quality_pu, sentencepiece_codec, source_mix
from txnrisk.llm.common import staged

#: Documents scored under this are rejected.
LEAST_QUALITY = 0.3
TOKENIZER = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    model = quality_pu.train(docs.where(learn), labels.where(learn))
    return quality_pu.score(docs, model, out_col="__quality").where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near-duplicates."""
    return jaccard_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their target weights, shuffled globally."""
    return source_mix.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digests of their byte spans and of the round trip."""
    return sentencepiece_codec.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER),
                                                columns=("ids", "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near_duplicates),
          ("source mix", mix), ("SentencePiece encoding", encode)]

#: A trained classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        gc.collect()  # lets Spark drop the broadcasts and plans of the stages before
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "_"))
    return docs
