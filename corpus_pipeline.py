"""From raw documents to token ids: identified, deduplicated by line and by document, decontaminated, encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.llm.decontaminate import remove_contaminated
from sessionlore.llm.hyperminhash import keep_first
from sessionlore.llm.language_id import keep_identified, train
from sessionlore.llm.line_dedup import dedup_lines
from sessionlore.llm.piece_codec import encode_decode
from sessionlore.llm.queries import session
from sessionlore.llm.texts import packed
from sessionlore.session import materialize

#: Shingles of the near-duplicate stage, in words, and the similarity of a group's neighbours in percent.
SHINGLE, SIMILAR = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the labels that ``docs`` has."""
    session(spark)
    return keep_identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share."""
    session(spark)
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    session(spark)
    return keep_first(docs, size=SHINGLE, percent=SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    session(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of the ids and of the text decoded from them, and the ids."""
    session(spark)
    found = encode_decode(packed(docs), public_tokenizers.path("piece_bpe_32k.model"), ids=True)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("encode", encode)]
#: SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a folder, each on the written rows of the one before."""
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
