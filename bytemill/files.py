"""Single files, driver side: manifest, encode, decode, compress, decompress, pack, unpack. Work on chunks runs in Spark.

Sources are read in blocks through the block data source, so a file of any size is never one row: the fixed-size chunker has its chunks as
blocks, the content-aware one finds its runs over blocks of BLOCK bytes and reads each run by its range.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import warnings
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.functions import codecs
from bytemill.functions.layouts import CHECKED, LAYOUTS, restore, unpack
from bytemill.operators import archives, chunking, manifests, selection
from bytemill.schema import ARCHIVE_CHUNK, OVERSIZE, WINDOW, EncodeError, ManifestError, check_chunking
from bytemill.sources.archive import read_tables, register


#: Bytes of the blocks over which runs are found: a multiple of the window.
BLOCK = 1024 * WINDOW


class OversizedChunkWarning(UserWarning):
    """Chunks are longer than any the selector was trained on."""


@contextmanager
def placed(target: str) -> Iterator:
    """A file that takes the target's place when all is written, and leaves nothing behind otherwise."""
    temporary = f"{target}.{uuid.uuid4().hex[:8]}.partial"
    try:
        with open(temporary, "w+b") as f:
            yield f
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def file_sha256(path: str) -> str:
    """Of a file of any size, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of one file; Spark's own reader skips a file without bytes."""
    if not os.path.getsize(path):
        return spark.createDataFrame([(path, b"")], "path string, content binary")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def ranged(rows: DataFrame) -> DataFrame:
    """path, chunk_idx, offset, length, content of ranges (path, chunk_idx, offset, length), read by tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row a batch: a run may be long
                row = batch.slice(i, 1)
                with open(row.column("path")[0].as_py(), "rb") as f:
                    f.seek(row.column("offset")[0].as_py())
                    data = f.read(row.column("length")[0].as_py())
                yield pa.RecordBatch.from_arrays([row.column("path"), row.column("chunk_idx"), row.column("offset"), pa.array([len(data)], pa.int32()), pa.array([data], pa.binary())], names=["path", "chunk_idx", "offset", "length", "content"])

    return rows.select("path", "chunk_idx", "offset", "length").mapInArrow(read, "path string, chunk_idx int, offset long, length int, content binary")


def file_chunks(spark: SparkSession, path: str, chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK) -> DataFrame:
    check_chunking(chunker, chunk_size)
    register(spark)
    blocks = spark.read.format("bytemill_blocks")
    if chunker == "fixed_size":
        return blocks.option("block", chunk_size).load(os.path.abspath(path))
    return ranged(chunking.runs_of_blocks(blocks.option("block", BLOCK).load(os.path.abspath(path))).repartition("chunk_idx"))


def build_manifest(spark: SparkSession, path: str, chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK, model: PipelineModel | None = None, algorithm: str | None = None) -> dict:
    """A manifest with the codec that the model picks for each chunk, or the named one for all."""
    if algorithm is not None:
        codecs.check_names(algorithm)
    elif model is None:
        raise ValueError("give a model or an algorithm")
    parts = file_chunks(spark, path, chunker, chunk_size)
    if chunker == "content_aware" and (found := chunking.oversized(parts).first())["n"]:
        warnings.warn(f"{found['n']} chunks are longer than {OVERSIZE} bytes, the longest has {found['max_length']}; the selector saw none such", OversizedChunkWarning, stacklevel=2)
    named = parts.withColumn("algorithm", F.lit(algorithm)) if algorithm else selection.predict(parts, model)
    rows = manifests.records(named).orderBy("chunk_idx").collect()
    return {"source_file": os.path.abspath(path), "source_size": os.path.getsize(path), "source_sha256": file_sha256(path), "chunks": [{k: r[k] for k in ("offset", "length", "algorithm", "checksum")} for r in rows], "version": manifests.VERSION}


def validate(manifest: dict, source: str | None = None) -> None:
    """ManifestError unless version, size, checksum, order and codecs of a manifest fit its source."""
    path = source or manifest["source_file"]
    wrong = None
    if manifest["version"] != manifests.VERSION:
        wrong = f"version {manifest['version']}"
    elif not os.path.exists(path) or os.path.getsize(path) != manifest["source_size"]:
        wrong = "the source's size differs"
    elif file_sha256(path) != manifest["source_sha256"]:
        wrong = "the source's checksum differs"
    at = 0
    for i, c in enumerate(manifest["chunks"]):
        if wrong:
            break
        if c["offset"] < 0 or c["length"] < 0:
            wrong = f"chunk {i} is negative"
        elif c["offset"] != at:
            wrong = f"chunk {i} starts at {c['offset']}, not at {at}"
        elif c["algorithm"] not in codecs.CODECS:
            wrong = f"chunk {i} has the unknown codec {c['algorithm']!r}"
        at += c["length"]
    if not wrong and at != manifest["source_size"]:
        wrong = f"chunks end at {at}, the source at {manifest['source_size']}"
    if wrong:
        raise ManifestError(f"{path}: {wrong}")


def encode(spark: SparkSession, manifest_path: str, output: str) -> None:
    """A checked archive as a manifest says. Chunks are read, checked and compressed by tasks and streamed to the file in order."""
    m = manifests.load(manifest_path)
    validate(m)
    codecs.check_names(*{c["algorithm"] for c in m["chunks"]})
    rows = [(i, c["offset"], c["length"], c["algorithm"], c["checksum"]) for i, c in enumerate(m["chunks"])]
    plan = spark.createDataFrame(rows, "chunk_idx int, offset long, length long, algorithm string, checksum string")
    source = m["source_file"]

    def work(batches):
        for pdf in batches:
            out = []
            with open(source, "rb") as f:
                for r in pdf.itertuples():
                    f.seek(r.offset)
                    data = f.read(r.length)
                    if len(data) < r.length:
                        raise EncodeError(f"chunk {r.chunk_idx}: the source ends too early")
                    if hashlib.sha256(data).hexdigest() != r.checksum:
                        raise EncodeError(f"chunk {r.chunk_idx} doesn't match its checksum")
                    out.append(codecs.compress(data, r.algorithm))
            yield pdf.assign(payload=out)[["chunk_idx", "payload"]]

    with placed(output) as f:
        f.write(CHECKED.pack_header(m["source_size"], bytes.fromhex(m["source_sha256"]), len(rows)))
        f.write(bytes(CHECKED.entry.size * len(rows)))
        table, at = [], 0
        made = plan.repartitionByRange(max(1, len(rows) // 2000), "chunk_idx").sortWithinPartitions("chunk_idx").mapInPandas(work, "chunk_idx int, payload binary") if rows else None
        try:
            for r in made.toLocalIterator() if made else ():
                _, _, length, name, checksum = rows[r["chunk_idx"]]
                table.append(CHECKED.pack_entry(codecs.id_of(name), length, len(r["payload"]), at, bytes.fromhex(checksum)))
                f.write(r["payload"])
                at += len(r["payload"])
        except Exception as e:
            if "EncodeError" in str(e):
                raise EncodeError(str(e).split("EncodeError: ")[-1].split("\n")[0]) from e
            raise
        f.seek(CHECKED.table_at())
        f.write(b"".join(table))


def decode(archive: str, output: str, layout: str = "checked") -> None:
    """The source of an archive file, chunk by chunk; the output appears only if all checks hold."""
    made = LAYOUTS[layout]
    header, table = read_tables(archive, made)
    whole, size = hashlib.sha256(), 0
    with placed(output) as out, open(archive, "rb") as f:
        for e in table:
            f.seek(made.payload_at(header["chunks"]) + e["offset"])
            data = f.read(e["compressed"])
            if len(data) < e["compressed"]:
                raise made.error("payload ends behind the archive")
            data = restore(made, e, data)
            whole.update(data)
            size += len(data)
            out.write(data)
        if size != header["size"]:
            raise made.error(f"source has {size} bytes, the header says {header['size']}")
        if whole.digest() != header["sha256"]:
            raise made.error("source doesn't match its checksum")


def pack(spark: SparkSession, source: str, output: str, algorithm: str | None = None, mode: str = "brute_force", chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK, model: PipelineModel | None = None) -> None:
    """A plain archive of one file."""
    if algorithm is not None:
        codecs.check_names(algorithm)
    predict = (lambda c: selection.predict(c, model)) if model is not None else None
    row = archives.pack(whole_file(spark, source), "plain", chunker, chunk_size, algorithm, mode, predict).first()
    with placed(output) as f:
        f.write(row["archive"])


def unpack_file(archive: str, output: str) -> None:
    data = unpack(Path(archive).read_bytes(), LAYOUTS["plain"])
    with placed(output) as f:
        f.write(data)


def compress(spark: SparkSession, source: str, output: str, chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK, model: PipelineModel | None = None, algorithm: str | None = None, manifest_path: str | None = None, keep_manifest: bool = True) -> dict:
    """Manifest, then archive; a summary of sizes, ratio (of the whole archive) and codecs. The manifest goes if it isn't to be kept, also after a failure."""
    target = manifest_path or f"{output}.manifest.json"
    m = build_manifest(spark, source, chunker, chunk_size, model, algorithm)
    manifests.write(m, target)
    try:
        encode(spark, target, output)
    finally:
        if not keep_manifest:
            Path(target).unlink(missing_ok=True)
    size = os.path.getsize(output)
    return {"input": source, "output": output, "manifest": target if keep_manifest else None, "original_size": m["source_size"], "compressed_size": size, "ratio": m["source_size"] / size if size else float("inf"), "chunk_count": len(m["chunks"]), "algorithm_counts": dict(Counter(c["algorithm"] for c in m["chunks"]).most_common())}
