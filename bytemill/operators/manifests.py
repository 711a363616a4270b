"""Manifests: how a source is cut, which codec each chunk gets, and checksums to hold it to."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytemill.schema import CODECS, ManifestError

VERSION = 1
CHUNKS = "array<struct<offset: long, length: long, algorithm: string, checksum: string>>"
MANIFEST = f"source_file string, source_size long, source_sha256 string, chunks {CHUNKS}, version int"


def records(chunks: DataFrame) -> DataFrame:
    """path, chunk_idx, offset, length, algorithm, checksum of chunks that have an algorithm."""
    return chunks.select("path", "chunk_idx", F.col("offset").cast("long"), F.col("length").cast("long").alias("length"), "algorithm", F.sha2("content", 256).alias("checksum"))


def build(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """A manifest for each source, those without chunks included; chunk records in order."""
    parts = records(chunks).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "offset", "length", "algorithm", "checksum"))).alias("c"))
    whole = sources.select("path", F.octet_length("content").cast("long").alias("source_size"), F.sha2("content", 256).alias("source_sha256"))
    made = F.transform("c", lambda x: F.struct(x["offset"], x["length"], x["algorithm"], x["checksum"]))
    chunk_list = F.coalesce(made.cast(CHUNKS), F.array().cast(CHUNKS))
    return whole.join(parts, "path", "left").select(F.col("path").alias("source_file"), "source_size", "source_sha256", chunk_list.alias("chunks"), F.lit(VERSION).alias("version"))


def exploded(manifests: DataFrame) -> DataFrame:
    """A row for each chunk record: path, chunk_idx, offset, length, algorithm, checksum."""
    return manifests.select(F.col("source_file").alias("path"), F.posexplode("chunks").alias("chunk_idx", "c")).select("path", "chunk_idx", "c.*")


def violations(manifests: DataFrame, sources: DataFrame) -> DataFrame:
    """What is wrong with manifests: path, chunk_idx (null for the whole), check, expected, actual. Sources are (path, content).

    A manifest meets its source once, and all checks are one expression over that row: no record carries the content on, and
    nothing but violations leaves the projection.
    """
    rows = manifests.join(sources.select(F.col("path").alias("source_file"), "content"), "source_file", "left")
    size = F.octet_length("content").cast("long")
    each = "struct<chunk_idx: int, check: string, expected: string, actual: string>"

    def check(at: Column, name: str, expected: Column, actual: Column) -> Column:
        return F.struct(at.cast("int").alias("chunk_idx"), F.lit(name).alias("check"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))

    def wrong(*checks: Column) -> Column:
        return F.filter(F.array(*checks), lambda v: ~v["expected"].eqNullSafe(v["actual"]))

    def of_chunk(c: Column, i: Column) -> Column:
        before = F.get("chunks", i - 1)
        piece = F.substring(F.col("content"), (c["offset"] + 1).cast("int"), F.greatest(c["length"], F.lit(0)).cast("int"))
        fine = (c["offset"] >= 0) & (c["length"] >= 0)
        return wrong(
            check(i, "contiguity", F.when(i == 0, F.lit(0).cast("long")).otherwise(before["offset"] + before["length"]), c["offset"]),
            check(i, "negative", F.lit(False), ~fine),
            check(i, "algorithm", F.when(c["algorithm"].isin(CODECS), c["algorithm"]).otherwise("a known codec"), c["algorithm"]),
            check(i, "checksum", c["checksum"], F.when(fine, F.sha2(piece, 256)).otherwise("")),
        )

    none = F.lit(None)
    end = F.coalesce(F.aggregate("chunks", F.lit(0).cast("long"), lambda acc, c: F.greatest(acc, c["offset"] + c["length"])), F.lit(0).cast("long"))
    of_all = wrong(check(none, "version", F.lit(VERSION), F.col("version")), check(none, "source_size", F.col("source_size"), size), check(none, "source_sha256", F.col("source_sha256"), F.sha2("content", 256)), check(none, "coverage", size, end))
    of_each = F.coalesce(F.flatten(F.transform("chunks", of_chunk)).cast(f"array<{each}>"), F.array().cast(f"array<{each}>"))
    return rows.select(F.col("source_file").alias("path"), F.explode(F.concat(of_all.cast(f"array<{each}>"), of_each)).alias("v")).select("path", "v.*")


def to_json(manifests: DataFrame) -> DataFrame:
    """path and the manifest as JSON text, fields in the order of MANIFEST."""
    return manifests.select(F.col("source_file").alias("path"), F.to_json(F.struct("source_file", "source_size", "source_sha256", "chunks", "version")).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Manifests out of (path, json); a malformed one fails the job. A missing version is 1; unknown fields beside the known are ignored."""
    parsed = rows.select(F.from_json("json", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    needed = [F.col(c).isNull() for c in ("source_file", "source_size", "source_sha256", "chunks")]
    lacking = F.exists("chunks", lambda c: c["offset"].isNull() | c["length"].isNull() | c["algorithm"].isNull() | c["checksum"].isNull())
    bad = needed[0] | needed[1] | needed[2] | needed[3] | lacking
    guarded = F.when(bad, F.raise_error(F.lit("manifest lacks a field")).cast("string")).otherwise(F.col("source_file"))
    return parsed.select(guarded.alias("source_file"), "source_size", "source_sha256", "chunks", F.coalesce("version", F.lit(VERSION)).alias("version"))


def write(manifest, path: str) -> None:
    """One manifest (a Row or dict in the shape of MANIFEST) as indented JSON."""
    m = manifest.asDict(recursive=True) if hasattr(manifest, "asDict") else dict(manifest)
    Path(path).write_text(json.dumps({k: m[k] for k in ("source_file", "source_size", "source_sha256", "chunks", "version")}, indent=2))


def load(path: str) -> dict:
    """One manifest from a file; ManifestError for what isn't JSON or lacks or, in a chunk record, adds a field."""
    try:
        found = json.loads(Path(path).read_text())
        m = {k: found[k] for k in ("source_file", "source_size", "source_sha256")} | {"version": found.get("version", VERSION)}
        m["chunks"] = [dict(c) for c in found["chunks"]]
    except (ValueError, KeyError, TypeError) as e:
        raise ManifestError(f"malformed manifest {path}: {e}") from e
    for c in m["chunks"]:
        if set(c) != {"offset", "length", "algorithm", "checksum"}:
            raise ManifestError(f"malformed chunk record in {path}: {sorted(c)}")
    return m


def frame(spark: SparkSession, *manifests: dict) -> DataFrame:
    """Manifests as a DataFrame."""
    return spark.createDataFrame(list(manifests), T.StructType.fromDDL(MANIFEST))


def raise_first(found: DataFrame, error: type[ValueError] = ManifestError) -> None:
    """Raises for the first violation, if there is any."""
    if row := found.orderBy("path", F.col("chunk_idx").asc_nulls_first(), "check").first():
        at = "" if row["chunk_idx"] is None else f", chunk {row['chunk_idx']}"
        raise error(f"{row['path']}{at}: {row['check']} should be {row['expected']}, is {row['actual']}")
