"""The labelled dataset: features, winner and sizes of every chunk, one partition per source, built so that it can resume."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from bytemill.operators import chunking, features, labeling
from bytemill.schema import DATASET_CHUNK, check_chunking


def featured(labelled: DataFrame) -> DataFrame:
    """Dataset rows of labelled chunks that still have their content: features, and whatever else they have, with source_file for path."""
    rest = [c for c in labelled.columns if c not in ("path", "chunk_idx", "length", "content")]
    return features.feature_rows(labelled, keep=rest).withColumn("source_file", F.col("path")).drop("path")


def rows(sources: DataFrame, chunker: str = "fixed_size", chunk_size: int = DATASET_CHUNK, errors: bool = False) -> DataFrame:
    """features, size_ and time_ columns, best_algorithm, best_size, source_file of every chunk, in one narrow stage; with errors also the column error."""
    return featured(labeling.label(chunking.chunk(sources, chunker, chunk_size), keep=["content"], errors=errors))


def config_key(chunker: str, chunk_size: int) -> str:
    """The part of a shard's name that changes whenever what is in it would."""
    return hashlib.sha256(json.dumps([chunker, chunk_size]).encode()).hexdigest()[:12]


def pending(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources that aren't among the done paths."""
    return sources.join(done.select("path").distinct(), "path", "left_anti")


#: Columns that only the shards have: what went wrong with a chunk, and the build that made a row.
_OWN = ("error", "build")


def build(sources: DataFrame, shard_folder: str, chunker: str = "fixed_size", chunk_size: int = DATASET_CHUNK, force: bool = False) -> DataFrame:
    """Writes rows for the sources that have none yet (all with force) and returns the dataset for exactly these sources.

    Shards lie below the key of the configuration, so another chunk size never reuses them; sources that are gone since are left out. A
    source with a chunk that can't be labelled ends no build: it is left out and named by `failures`, and the next build tries it again.
    Rows are only ever added, with the number of their build; a source's latest build counts, so force on some sources leaves others alone.
    """
    check_chunking(chunker, chunk_size)
    spark, folder = sources.sparkSession, f"{shard_folder.rstrip('/')}/{config_key(chunker, chunk_size)}"
    held = None if force else _held(spark, folder)
    todo = sources if held is None else pending(sources, _sound(held).select(F.col("source_file").alias("path")))
    made = rows(todo, chunker, chunk_size, errors=True)
    made.withColumn("build", F.lit(time.time_ns())).write.mode("append").parquet(folder)
    return _sound(merged(spark, folder)).join(sources.select(F.col("path").alias("source_file")), "source_file", "left_semi").drop(*_OWN)


def failures(sources: DataFrame, shard_folder: str, chunker: str = "fixed_size", chunk_size: int = DATASET_CHUNK) -> DataFrame:
    """source_file and error of the sources that the dataset lacks: those whose latest build has an error (the first one), and, where
    sources have a length, those with bytes but no rows: they could not be read (see corpus.files, `tolerant`; take the list before the build)."""
    spark = sources.sparkSession
    shards = merged(spark, f"{shard_folder.rstrip('/')}/{config_key(chunker, chunk_size)}")
    bad = _latest(shards).where("error is not null").groupBy("source_file").agg(F.min("error").alias("error"))
    found = bad.join(sources.select(F.col("path").alias("source_file")), "source_file", "left_semi")
    if "length" in sources.columns:
        listed = sources.where("length > 0").select(F.col("path").alias("source_file"))
        found = found.union(listed.join(shards.select("source_file"), "source_file", "left_anti").withColumn("error", F.lit("could not be read")))
    return found


def _held(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return merged(spark, folder)
    except AnalysisException:
        return None


def _latest(shards: DataFrame) -> DataFrame:
    """The rows of each source's latest build."""
    last = shards.groupBy("source_file").agg(F.max("build").alias("build"))
    return shards.join(last, ["source_file", "build"], "left_semi")


def _sound(shards: DataFrame) -> DataFrame:
    """The rows of each source's latest build, without sources in which a chunk failed."""
    found = _latest(shards)
    return found.join(found.where("error is not null").select("source_file"), "source_file", "left_anti")


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """All shards in one; columns that a shard lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(folder)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dataset from Parquet if the path says so, else from CSV with a header."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def save(df: DataFrame, path: str) -> None:
    """Parquet, or CSV with flat columns if the path ends so."""
    if path.endswith(".csv"):
        keep = [c for c in df.columns if c not in ("hist", "bigram")]
        flat = [F.col("hist")[i].alias(f"hist_{i}") for i in range(256)] + [F.col("bigram")[i].alias(f"bigram_top{i}") for i in range(10)]
        df.select(*keep, *(flat if "hist" in df.columns else [])).write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
