"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm import bpe, chat, hnsw, kdshard, langid, licenses, minhash, mixing, ppm, sql, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text that they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: four-word shingles, similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return ppm.score(docs, ppm.train(docs.where(~held_out)), carry={"held_out": held_out})


def op2_kdshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts share a shard."""
    placed = kdshard.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors by integer inner product for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, how well it matches, and how many parts match one."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license", F.round("dice", 9).alias("dice"), F.size("matches").cast("long").alias("n_matches"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, formatted into prefix trees and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.pack(rows.union(extra)), ordered=True)


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that link with a cosine of 0.9 or more, whatever their labels."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9).drop("recall")


#: The dimensions of the mix: column name, expression in Spark and DuckDB alike.
MIX = {
    "source": "source",
    "lang": "lang",
    "topic": "CASE WHEN text IS NULL THEN 'none' WHEN text LIKE '%|%' THEN 'tabular' WHEN text LIKE '%http%' OR text LIKE '%@%' THEN 'contacts' WHEN octet_length({text}) >= 4000 THEN 'long' ELSE 'prose' END",
}
MIX_SHARE = 0.6


def mix_dims(df: DataFrame) -> DataFrame:
    """df with the columns mix_source, mix_lang, mix_topic and mix_tokens."""
    return df.withColumns({f"mix_{k}": F.expr(e.format(text="text")) for k, e in MIX.items()} | {"mix_tokens": mixing.tokens(F.col("text"))})


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked weight, its probability, and whether the sample keeps it: 60 % of the tokens, shares by square roots."""
    docs = mix_dims(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text", "source", "lang")
    out = mixing.mix(docs, ["mix_source", "mix_lang", "mix_topic"], "mix_tokens", MIX_SHARE)
    total = F.col("mix_weight") / F.col("mix_total")
    return out.select("doc_id", *[F.col(f"mix_{k}").alias(k) for k in MIX], F.col("mix_tokens").alias("n_tokens"), F.round(total, 9).alias("weight"), F.round("mix_p", 9).alias("p"), F.col("mix_kept").alias("kept"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, by models of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_symbols", "cross_entropy", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ppm": op1_ppm, "op3_bpe": op3_bpe, "op2_kdshard": op2_kdshard, "op4_minhash": op4_minhash, "op5_topk": op5_topk, "op6_licenses": op6_licenses, "op7_chat": op7_chat, "op8_hnsw": op8_hnsw, "op9_mixing": op9_mixing, "op10_langid": op10_langid}


def oracle_sql() -> dict[str, str]:
    dims = {k: e.format(text="encode(text)") for k, e in MIX.items()}
    return {"op4_minhash": sql.NEAR_DUPLICATES, "op5_topk": sql.TOP_K, "op7_chat": sql.CHAT, "op8_hnsw": sql.NEAR_VECTORS, "op9_mixing": mixing.sql(dims, "coalesce(octet_length(encode(text)), 0) // 4 + 1", MIX_SHARE)}
