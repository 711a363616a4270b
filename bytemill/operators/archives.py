"""Archives as DataFrame operations: choose a codec for each chunk, lay payloads out, assemble, and read back.

Chunks are chosen and compressed where they are; one shuffle by path brings a source's compressed chunks together. An
archive is assembled by streaming them in order, in memory (pack) or into a file (write).
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytemill.functions import codecs
from bytemill.functions.layouts import LAYOUTS, Layout, unpack
from bytemill.functions.scalars import packed, unsigned
from bytemill.operators import chunking, labeling
from bytemill.schema import ARCHIVE_CHUNK

MODES = ("brute_force", "model")


def chosen(chunks: DataFrame, algorithm: str | None = None, mode: str = "brute_force", predict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """chunks with algorithm and payload: a named codec, the smallest by trial, or what `predict` (chunks to chunks with algorithm) says."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if algorithm is not None:
        codecs.check_names(algorithm)
        named = chunks.withColumn("algorithm", F.lit(algorithm))
        return named.withColumn("payload", F.col("content") if algorithm == "store" else codecs.compressed("content", "algorithm"))
    if mode == "brute_force":
        return labeling.squeezed(chunks)
    if predict is None:
        raise ValueError("mode 'model' needs a predictor")
    return predict(chunks).withColumn("payload", codecs.compressed("content", "algorithm"))


def laid_out(parts: DataFrame) -> DataFrame:
    """parts (path, chunk_idx, offset, length, algorithm, payload, content) with algorithm_id, compressed_length, checksum, payload_offset."""
    before = Window.partitionBy("path").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    sized = parts.select("path", "chunk_idx", "offset", "length", "algorithm", "payload", codecs.id_column(F.col("algorithm")).alias("algorithm_id"), F.octet_length("payload").cast("long").alias("compressed_length"), F.sha2("content", 256).alias("checksum"))
    return sized.withColumn("payload_offset", F.coalesce(F.sum("compressed_length").over(before), F.lit(0)).cast("long"))


def header_bytes(layout: Layout, size, sha_hex, chunks):
    """The header as a native expression over columns."""
    return F.concat(F.lit(layout.magic), packed(F.lit(1), 1), packed(size, 8), F.unhex(sha_hex), packed(chunks, 4))


def entry_bytes(layout: Layout):
    """A table entry as a native expression over the columns of laid_out."""
    head = [packed(F.col("algorithm_id"), 1), packed(F.col("length"), 4), packed(F.col("compressed_length"), 4)]
    return F.concat(*head, *([F.unhex("checksum")] if layout.checked else []), packed(F.col("payload_offset"), 8))


def pack(sources: DataFrame, layout: str = "checked", chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK, algorithm: str | None = None, mode: str = "brute_force", predict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path and archive (binary) for each source; an empty source has an archive without chunks."""
    made = LAYOUTS[layout]
    parts = laid_out(chosen(chunking.chunk(sources, chunker, chunk_size), algorithm, mode, predict))
    one = parts.withColumn("entry", entry_bytes(made)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "entry", "payload"))).alias("c"))
    whole = sources.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha"))
    every = whole.join(one, "path", "left").select("path", header_bytes(made, F.col("size"), F.col("sha"), F.greatest(F.coalesce(F.size("c"), F.lit(0)), F.lit(0))).alias("head"), F.col("c.entry").alias("entries"), F.col("c.payload").alias("payloads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("head", "entries", "payloads"))
            archives = [b"".join([h, *(e or []), *(p or [])]) for h, e, p in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(archives, pa.binary())], names=["path", "archive"])

    return every.mapInArrow(run, "path string, archive binary")


def write(sources: DataFrame, folder: str, layout: str = "checked", suffix: str = ".bmz", **options) -> DataFrame:
    """Writes an archive for each source below a folder that executors share: path, file, size.

    One task streams the compressed chunks of a source in order into a temporary file, the table first with zeros; it
    is put in place by a rename, so a repeated or failed task leaves no half of an archive.
    """
    made = LAYOUTS[layout]
    os.makedirs(folder, exist_ok=True)
    chunk = {k: options.pop(k) for k in ("chunker", "chunk_size") if k in options}
    parts = laid_out(chosen(chunking.chunk(sources, **chunk), **options)).withColumn("entry", entry_bytes(made))
    n = parts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    whole = sources.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha")).join(n, "path", "left").fillna(0, ["n"])
    heads = whole.select("path", F.lit(-1).alias("chunk_idx"), header_bytes(made, F.col("size"), F.col("sha"), F.col("n")).alias("entry"), F.lit(None).cast("binary").alias("payload"))
    both = heads.union(parts.select("path", "chunk_idx", "entry", "payload"))
    # one partition more than usual: a shuffle that the sides' own partitioning can't stand in for
    apart = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    rows = both.repartition(apart, "path").sortWithinPartitions("path", "chunk_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, table, temporary = None, None, [], ""

        def close() -> Iterator[pa.RecordBatch]:
            if out:
                out.seek(made.table_at())
                out.write(b"".join(table))
                out.seek(0, os.SEEK_END)
                size = out.tell()
                out.close()
                target = os.path.join(folder, hashlib.sha256(now.encode()).hexdigest()[:32] + suffix)
                os.replace(temporary, target)
                yield pa.RecordBatch.from_pydict({"path": [now], "file": [target], "size": [size]})

        try:
            for batch in batches:
                for path, entry, payload in zip(*(batch.column(c).to_pylist() for c in ("path", "entry", "payload")), strict=True):
                    if path != now:
                        yield from close()
                        now, table, temporary = path, [], os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
                        out = open(temporary, "w+b")  # noqa: SIM115
                        out.write(entry)
                        out.write(bytes(made.entry.size * made.read_header(entry)["chunks"]))
                    else:
                        table.append(entry)
                        out.write(payload)
            yield from close()
        except BaseException:
            if out and not out.closed:
                out.close()
                os.unlink(temporary)
            raise

    return rows.mapInArrow(run, "path string, file string, size long")


def headers(archives: DataFrame, layout: str) -> DataFrame:
    """path, magic, version, original_size, sha256, chunk_count of (path, archive), by native expressions."""
    a = F.col("archive")
    return archives.select("path", F.decode(F.substring(a, 1, 4), "ISO-8859-1").alias("magic"), unsigned(a, 4, 1).cast("int").alias("version"), unsigned(a, 5, 8).alias("original_size"), F.lower(F.hex(F.substring(a, 14, 32))).alias("sha256"), unsigned(a, 45, 4).alias("chunk_count"))


def entries(archives: DataFrame, layout: str) -> DataFrame:
    """path, chunk_idx, algorithm, original_length, compressed_length, payload_offset, checksum (null in the plain layout), by native expressions."""
    made = LAYOUTS[layout]
    rows = archives.withColumn("n", unsigned(F.col("archive"), 45, 4).cast("int")).where("n > 0").select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("archive"), i * made.entry.size + made.table_at() + 1, F.lit(made.entry.size)))).alias("chunk_idx", "e"))
    e = F.col("e")
    checksum = F.lower(F.hex(F.substring(e, 10, 32))) if made.checked else F.lit(None).cast("string")
    return rows.select("path", "chunk_idx", codecs.name_column(unsigned(e, 0, 1)).alias("algorithm"), unsigned(e, 1, 4).alias("original_length"), unsigned(e, 5, 4).alias("compressed_length"), unsigned(e, made.entry.size - 8, 8).alias("payload_offset"), checksum.alias("checksum"))


def unpacked(archives: DataFrame, layout: str = "checked") -> DataFrame:
    """path, content and error (the error's class, null if all holds) of (path, archive)."""
    made = LAYOUTS[layout]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, error = [], []
            for archive in batch.column("archive").to_pylist():
                try:
                    content.append(unpack(archive or b"", made))
                    error.append(None)
                except made.error as e:
                    content.append(None)
                    error.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary()), pa.array(error, pa.string())], names=["path", "content", "error"])

    return archives.select("path", "archive").mapInArrow(run, "path string, content binary, error string")


def summary(archives: DataFrame, sources: DataFrame, layout: str = "checked") -> DataFrame:
    """path, original_size, compressed_size (the whole archive), ratio, chunk_count."""
    sizes = sources.select("path", F.octet_length("content").cast("long").alias("original_size"))
    found = archives.select("path", F.octet_length("archive").cast("long").alias("compressed_size"), unsigned(F.col("archive"), 45, 4).alias("chunk_count"))
    return sizes.join(found, "path").select("path", "original_size", "compressed_size", F.when(F.col("compressed_size") == 0, float("inf")).otherwise(F.col("original_size") / F.col("compressed_size")).alias("ratio"), "chunk_count")


def counted(rows: DataFrame) -> DataFrame:
    """algorithm, chunk_count, share (percent, one decimal) of rows that have an algorithm, most frequent first."""
    found = rows.groupBy("algorithm").agg(F.count(F.lit(1)).alias("chunk_count"))
    share = F.round(100 * F.col("chunk_count") / F.sum("chunk_count").over(Window.partitionBy(F.lit(0))), 1)
    return found.withColumn("share", share).orderBy(F.desc("chunk_count"), "algorithm")


def algorithm_counts(archives: DataFrame, layout: str = "checked") -> DataFrame:
    """The same of the chunks of archives."""
    return counted(entries(archives, layout))
