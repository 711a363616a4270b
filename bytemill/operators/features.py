"""Features of chunks: one Arrow kernel for all, and the same from native expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.functions import kernels
from bytemill.schema import FEATURES, SCALARS

_WIDE = 5 + 256


def feature_rows(chunks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """path, chunk_idx, the five scalars, hist (256 shares) and bigram (ten shares), and the columns keep of chunks.

    What needs a chunk's other columns beside its features keeps them here, so nothing is joined and no byte crosses a shuffle.
    """
    carried = {f"_{i}": c for i, c in enumerate(keep or [])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = kernels.features(batch.column("content"))
            hist = pa.FixedSizeListArray.from_arrays(pa.array(f[:, 5:_WIDE].ravel()), 256).cast(pa.list_(pa.float64()))
            pairs = pa.FixedSizeListArray.from_arrays(pa.array(f[:, _WIDE:].ravel()), f.shape[1] - _WIDE).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("chunk_idx"), pa.array(f[:, 0].astype(np.int32)), *(pa.array(f[:, i]) for i in range(1, 5)), hist, pairs, *(batch.column(c) for c in carried)], names=["path", "chunk_idx", *SCALARS, "hist", "bigram", *carried])

    source = chunks.select("path", "chunk_idx", "content", *[F.col(c).alias(n) for n, c in carried.items()])
    kept = "".join(f", {n} {source.schema[n].dataType.simpleString()}" for n in carried)
    made = source.mapInArrow(run, "path string, chunk_idx int, length int, entropy double, printable_ratio double, byte_mean double, byte_variance double, hist array<double>, bigram array<double>" + kept)
    return made.select(*made.columns[: len(made.columns) - len(carried)], *[F.col(n).alias(c) for n, c in carried.items()])


def wide(features: DataFrame) -> DataFrame:
    """One column for each name in FEATURES, besides path and chunk_idx."""
    columns = [F.col(c) for c in SCALARS] + [F.col("hist")[i].alias(f"hist_{i}") for i in range(256)] + [F.col("bigram")[i].alias(n) for i, n in enumerate(FEATURES[_WIDE:])]
    return features.select("path", "chunk_idx", *columns)


def with_vector(features: DataFrame, column: str = "features") -> DataFrame:
    """features with the ML vector in the order of FEATURES."""
    numbers = F.concat(F.array(*[F.col(c).cast("double") for c in SCALARS]), "hist", "bigram")
    return features.withColumn(column, array_to_vector(numbers))


def byte_counts(chunks: DataFrame) -> DataFrame:
    """path, chunk_idx, byte, n for the byte values that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = kernels.counts(*kernels.flat(batch.column("content")))
            row, byte = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(row)), batch.column("chunk_idx").take(pa.array(row)), pa.array(byte.astype(np.int32)), pa.array(c[row, byte].astype(np.int64))], names=["path", "chunk_idx", "byte", "n"])

    return chunks.select("path", "chunk_idx", "content").mapInArrow(run, "path string, chunk_idx int, byte int, n long")


def native_byte_counts(chunks: DataFrame) -> DataFrame:
    """The same by exploding bytes and grouping: slower, but all inside the JVM."""
    at = F.explode(F.sequence(F.lit(1), F.octet_length("content")))
    bytes_ = chunks.where("length > 0").select("path", "chunk_idx", "content", at.alias("k"))
    value = F.ascii(F.decode(F.substring(F.col("content"), F.col("k"), F.lit(1)), "ISO-8859-1"))
    return bytes_.groupBy("path", "chunk_idx", value.alias("byte")).agg(F.count(F.lit(1)).alias("n"))


def scalars_from_counts(counts: DataFrame) -> DataFrame:
    """path, chunk_idx and the five scalars out of (path, chunk_idx, byte, n)."""
    n, v, c = F.sum("n"), F.col("byte"), F.col("n")
    printable = F.sum(F.when(v.isin(9, 10, 13) | v.between(32, 126), c).otherwise(0))
    mean, square = F.sum(v * c) / n, F.sum(v * v * c) / n
    return counts.groupBy("path", "chunk_idx").agg(
        n.cast("int").alias("length"), (F.log2(n) - F.sum(c * F.log2(c)) / n).alias("entropy"), (printable / n).alias("printable_ratio"), mean.alias("byte_mean"), F.greatest(F.lit(0.0), square - mean * mean).alias("byte_variance"))
