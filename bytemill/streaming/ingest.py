"""Files that arrive in a folder, labelled or packed as a stream. The checkpoint takes the place of a list of done files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytemill.operators import archives, dataset
from bytemill.schema import ARCHIVE_CHUNK, DATASET_CHUNK, check_chunking

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 256) -> DataFrame:
    """A stream of (path, content)."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.where(~F.col("path").endswith("/.gitkeep")).select("path", "content")


def _run(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")  # a repeated batch overwrites itself

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_stream(stream: DataFrame, target: str, checkpoint: str, chunker: str = "fixed_size", chunk_size: int = DATASET_CHUNK) -> StreamingQuery:
    """Dataset rows of all files that have arrived, then stops; run again for those that arrive later."""
    check_chunking(chunker, chunk_size)
    return _run(stream, lambda b: dataset.rows(b, chunker, chunk_size), target, checkpoint)


def pack_stream(stream: DataFrame, target: str, checkpoint: str, layout: str = "checked", chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK, algorithm: str | None = None) -> StreamingQuery:
    """(path, archive) of all files that have arrived."""
    check_chunking(chunker, chunk_size)
    return _run(stream, lambda b: archives.pack(b, layout, chunker, chunk_size, algorithm), target, checkpoint)
