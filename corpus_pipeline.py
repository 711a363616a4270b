"""The corpus pipeline: language ID, near-duplicates, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents; the
last returns doc_id, lang, source, the ids and the count of tokens. Stages read nothing but docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm import bpe, langid, minhash, mixing, queries
from bytemill.llm.shared import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept, with lang as predicted. Null texts and texts without letters go."""
    model = langid.train(docs)
    found = langid.predict(docs, model, carry=["doc_id", "text", "source", "n_chars"])
    return found.where("not rejected").withColumnRenamed("lang_pred", "lang").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the least id. Of rows with equal id and text one stays."""
    return minhash.deduplicated(docs, width=5, percent=80).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that brings source, language and topic to their target weights, 60 % of the tokens."""
    out = mixing.mix(queries.mix_dims(docs), ["mix_source", "mix_lang", "mix_topic"], "mix_tokens", queries.MIX_SHARE)
    return out.where("mix_kept").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and whether they decode to its very text."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN, carry=["lang", "source", "text"], decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", tokenize)]
#: Models, signatures and merges are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
