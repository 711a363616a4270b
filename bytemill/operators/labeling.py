"""Labels of chunks: the codec that makes each smallest.

Ties go to the smaller codec id, so store comes first and the best size is never above the length.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.functions import codecs
from bytemill.operators.spread import spread
from bytemill.schema import CODECS


def sizes(chunks: DataFrame, algorithms: list[str] | None = None, keep: list[str] | None = None, errors: bool = False) -> DataFrame:
    """path, chunk_idx, length, keep, and size_<codec> and time_<codec> (seconds) for each codec, by default those of a search that can run.

    With errors, a chunk that can't be compressed does not end the job: its sizes are null and the column error says why.
    """
    tried = algorithms if algorithms is not None else codecs.names(installed=True)
    codecs.check_names(*tried)
    kept = ["path", "chunk_idx", *(keep or [])]
    taken = [f"_{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = {c: codecs.get(c).compressor(codecs.get(c).level) for c in tried}
        for batch in batches:
            data = batch.column("content").to_pylist()
            columns, failed = {}, [None] * len(data)
            for c, f in press.items():
                size, spent = [], []
                for i, x in enumerate(data):
                    began = time.perf_counter()
                    try:
                        size.append(len(f(x)))
                    except Exception as e:
                        if not errors:
                            raise
                        size.append(None)
                        failed[i] = f"{c}: {e}"
                    spent.append(time.perf_counter() - began)
                columns[f"size_{c}"], columns[f"time_{c}"] = pa.array(size, pa.int64()), pa.array(spent, pa.float64())
            if errors:
                columns["error"] = pa.array(failed, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in taken), pa.array([len(x or b"") for x in data], pa.int32()), *columns.values()], names=[*kept, "length", *columns])

    source = spread(chunks).select(*[F.col(c).alias(n) for n, c in zip(taken, kept, strict=True)], "content")
    kinds = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(kept, source.schema.fields, strict=False)]
    return source.mapInArrow(run, ", ".join([*kinds, "length int", *(f"size_{c} long, time_{c} double" for c in tried), *(["error string"] if errors else [])]))


def best(sized: DataFrame, among: list[str] | None = None) -> DataFrame:
    """sized with best_algorithm and best_size, from whatever size_ columns it has, or those of the codecs among."""
    tried = sorted((c[5:] for c in sized.columns if c.startswith("size_") and (among is None or c[5:] in among)), key=CODECS.index)
    least = F.least(*[F.col(f"size_{c}") for c in tried]) if len(tried) > 1 else F.col(f"size_{tried[0]}")
    name = F.coalesce(*[F.when(F.col(f"size_{c}") == least, F.lit(c)) for c in tried])
    return sized.withColumn("best_algorithm", name).withColumn("best_size", least)


def label(chunks: DataFrame, algorithms: list[str] | None = None, keep: list[str] | None = None, errors: bool = False) -> DataFrame:
    """Sizes, seconds, and the winner of each chunk."""
    return best(sizes(chunks, algorithms, keep, errors))


def long_form(sized: DataFrame) -> DataFrame:
    """A row for each chunk and codec: path, chunk_idx, algorithm, size, seconds."""
    tried = [c[5:] for c in sized.columns if c.startswith("size_")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("algorithm"), F.col(f"size_{c}").alias("size"), F.col(f"time_{c}").alias("seconds")) for c in tried]))
    return sized.select("path", "chunk_idx", rows.alias("r")).select("path", "chunk_idx", "r.*")


def squeezed(chunks: DataFrame, algorithms: list[str] | None = None) -> DataFrame:
    """chunks with algorithm and payload of the winner, all codecs tried in one pass and only the best payload kept."""
    tried = sorted(algorithms if algorithms is not None else codecs.names(installed=True), key=CODECS.index)
    codecs.check_names(*tried)
    kept = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = [(c, codecs.get(c).compressor(codecs.get(c).level)) for c in tried]
        for batch in batches:
            name, payload = [], []
            for x in batch.column("content").to_pylist():
                found = min(((c, f(x)) for c, f in press), key=lambda r: len(r[1]))  # the first of equals
                name.append(found[0])
                payload.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name), pa.array(payload, pa.binary())], names=[*kept, "algorithm", "payload"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return spread(chunks).mapInArrow(run, f"{kinds}, algorithm string, payload binary")
