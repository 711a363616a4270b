"""Strategies compared: what each would make of the same chunks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytemill.functions.scalars import ratio
from bytemill.operators import chunking, labeling, selection
from bytemill.schema import ARCHIVE_CHUNK, NOT_SEARCHED

#: Codecs that every benchmark runs.
NAMES = ["store", "gzip", "bzip2", "lzma", "zstd"]


def load_chunks(sources: DataFrame, chunk_size: int = ARCHIVE_CHUNK) -> DataFrame:
    """Fixed-size chunks of all sources."""
    return chunking.fixed(sources, chunk_size)


def run_all(chunks: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """name, total_original, total_compressed, ratio, seconds for always_store, always_gzip, always_zstd, brute_force_ceiling and, with a model, model_predicted.

    Every codec runs once on every chunk; the strategies only choose among the sizes. Seconds are the sums of the codec
    times that a strategy needs (for the ceiling: of all codecs in the search).
    """
    if model is not None:
        chunks = selection.predict(chunks, model)
    return strategies(labeling.sizes(chunks, NAMES, keep=["algorithm"] if model is not None else None))


def strategies(rows: DataFrame) -> DataFrame:
    """The same from rows that have length and the sizes and seconds of NAMES; model_predicted if they have an algorithm."""
    searched = [c for c in NAMES if c not in NOT_SEARCHED]
    made = [F.struct(F.lit(f"always_{c}").alias("name"), F.col(f"size_{c}").alias("size"), F.col(f"time_{c}").alias("s")) for c in ("store", "gzip", "zstd")]
    best, spent = F.least(*[F.col(f"size_{c}") for c in searched]), sum(F.col(f"time_{c}") for c in searched)
    made.append(F.struct(F.lit("brute_force_ceiling").alias("name"), best.alias("size"), spent.alias("s")))
    if "algorithm" in rows.columns:
        pick = lambda kind: F.try_element_at(F.create_map(*[x for c in NAMES for x in (F.lit(c), F.col(f"{kind}_{c}"))]), F.col("algorithm"))
        made.append(F.struct(F.lit("model_predicted").alias("name"), pick("size").alias("size"), pick("time").alias("s")))
    flat = rows.select("length", F.explode(F.array(*made)).alias("r")).select("length", "r.*")
    total = flat.groupBy("name").agg(F.sum("length").alias("total_original"), F.sum("size").alias("total_compressed"), F.sum("s").alias("seconds"))
    return total.select("name", "total_original", "total_compressed", ratio(F.col("total_original"), F.col("total_compressed")).alias("ratio"), "seconds")


def against_ceiling(results: DataFrame) -> DataFrame:
    """results with percent_of_ceiling (of the ratio) and speedup (ceiling's seconds by own)."""
    every = Window.partitionBy(F.lit(0))
    of = lambda c: F.max(F.when(F.col("name") == "brute_force_ceiling", F.col(c))).over(every)
    return results.withColumn("percent_of_ceiling", 100 * F.col("ratio") / of("ratio")).withColumn("speedup", F.when(F.col("seconds") > 0, of("seconds") / F.col("seconds")))
