"""Chunks of sources: of fixed size, or cut where text and binary content meet.

Input rows are (path, content); other columns are dropped. A chunk is (path, chunk_idx, offset, length, content), and
the chunks of a path in order concatenate to its content. Sources without bytes have no chunks. All is narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.functions.kernels import window_labels
from bytemill.schema import ARCHIVE_CHUNK, ENTROPY, HEX, LEAST_RUN, OVERSIZE, PRINTABLE, WINDOW, check_chunking


def fixed(df: DataFrame, chunk_size: int = ARCHIVE_CHUNK) -> DataFrame:
    """Slices of chunk_size bytes; the last may be shorter."""
    check_chunking(chunk_size=chunk_size)
    last = F.floor((F.octet_length("content") - 1) / chunk_size).cast("int")
    at = df.where(F.octet_length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    piece = F.substring("content", F.col("chunk_idx") * chunk_size + 1, F.lit(chunk_size))
    return at.select("path", "chunk_idx", (F.col("chunk_idx").cast("long") * chunk_size).alias("offset"), F.octet_length(piece).alias("length"), piece.alias("content"))


def windows(df: DataFrame, window: int = WINDOW, printable: float = PRINTABLE, entropy: float = ENTROPY, hexes: float = HEX, keep_content: bool = False) -> DataFrame:
    """path and is_text, an array with one flag per window; with keep_content also content."""
    check_chunking(window=window, printable=printable, entropy=entropy, hexes=hexes)
    kept = ["path", *(["content"] if keep_content else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [window_labels(x or b"", window, printable, entropy, hexes).tolist() if x else [] for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(labels, pa.list_(pa.bool_()))], names=[*kept, "is_text"])

    return df.select("path", "content").mapInArrow(run, "path string, " + ("content binary, " if keep_content else "") + "is_text array<boolean>")


def raw_boundaries(is_text: Column, length: Column, window: int = WINDOW) -> Column:
    """0, every offset at which the label changes, and the length."""
    change = F.filter(F.sequence(F.lit(1), F.greatest(F.size(is_text) - 1, F.lit(1))), lambda k: (k < F.size(is_text)) & (F.get(is_text, k) != F.get(is_text, k - 1)))
    cuts = F.transform(change, lambda k: (k * window).cast("long"))
    return F.concat(F.array(F.lit(0).cast("long")), cuts, F.array(length.cast("long")))


def merged_boundaries(boundaries: Column, least_run: int = LEAST_RUN) -> Column:
    """Drops, from the left, each inner boundary less than least_run behind the last one kept: the short run joins the next. The last run may be short."""
    inner = F.slice(boundaries, F.lit(2), F.greatest(F.size(boundaries) - 2, F.lit(0)))
    kept = F.aggregate(inner, F.slice(boundaries, 1, 1), lambda acc, b: F.when(b - F.element_at(acc, -1) < least_run, acc).otherwise(F.concat(acc, F.array(b))))
    return F.concat(kept, F.array(F.element_at(boundaries, -1)))


def content_aware(df: DataFrame, window: int = WINDOW, printable: float = PRINTABLE, entropy: float = ENTROPY, hexes: float = HEX, least_run: int = LEAST_RUN) -> DataFrame:
    """Runs of text and of binary windows, short runs merged."""
    check_chunking(least_run=least_run)
    labelled = windows(df.where(F.octet_length("content") > 0), window, printable, entropy, hexes, keep_content=True)
    cut = labelled.select("path", "content", merged_boundaries(raw_boundaries(F.col("is_text"), F.octet_length("content"), window), least_run).alias("b"))
    ends = F.arrays_zip(F.slice("b", F.lit(1), F.size("b") - 1).alias("a"), F.slice("b", F.lit(2), F.size("b") - 1).alias("z"))
    rows = cut.select("path", "content", F.posexplode(ends).alias("chunk_idx", "r"))
    size = (F.col("r")["z"] - F.col("r")["a"]).cast("int")
    return rows.select("path", "chunk_idx", F.col("r")["a"].alias("offset"), size.alias("length"), F.substring("content", (F.col("r")["a"] + 1).cast("int"), size).alias("content"))


def runs_of_blocks(blocks: DataFrame, window: int = WINDOW, printable: float = PRINTABLE, entropy: float = ENTROPY, hexes: float = HEX, least_run: int = LEAST_RUN) -> DataFrame:
    """path, chunk_idx, offset, length of the content-aware chunks of sources of any size, given as blocks: path, offset, content.

    Blocks but the last of a path have a multiple of the window's bytes. Windows are labelled block by block, where the blocks
    are; only label changes go on, and a task that reads a path's changes in order keeps one open run. Same chunks as content_aware.
    """
    check_chunking(window=window, printable=printable, entropy=entropy, hexes=hexes, least_run=least_run)

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for offset, x in zip(batch.column("offset").to_pylist(), batch.column("content").to_pylist(), strict=True):
                labels = window_labels(x, window, printable, entropy, hexes)
                cuts = [offset + int(i) * window for i in (labels[1:] != labels[:-1]).nonzero()[0] + 1]
                out.append((offset + len(x), bool(labels[0]), bool(labels[-1]), cuts))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("offset"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())), strict=True))], names=["path", "offset", "end", "first", "last", "cuts"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, start, number, label, end = None, 0, 0, None, 0  # of the open run and the path's last block
        for batch in batches:
            out = []
            for name, offset, until, first, last, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != path:
                    if path is not None:
                        out.append((path, number, start, end - start))
                    path, start, number, label, end = name, 0, 0, first, 0
                if offset != end:
                    raise ValueError(f"{name}: a block begins at {offset}, not at {end}")
                for cut in [offset, *cuts] if first != label else cuts:
                    if cut - start >= least_run:
                        out.append((path, number, start, cut - start))
                        start, number = cut, number + 1
                label, end = last, until
            yield made(out)
        if path is not None:
            yield made([(path, number, start, end - start)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["path", "chunk_idx", "offset", "length"])

    labelled = blocks.where(F.octet_length("content") > 0).select("path", "offset", "content").mapInArrow(changes, "path string, offset long, end long, first boolean, last boolean, cuts array<long>")
    return labelled.repartition("path").sortWithinPartitions("path", "offset").mapInArrow(runs, "path string, chunk_idx int, offset long, length long")


def chunk(df: DataFrame, chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK, **options) -> DataFrame:
    """The chunker by its name."""
    check_chunking(chunker, chunk_size)
    return fixed(df, chunk_size) if chunker == "fixed_size" else content_aware(df, **options)


def oversized(chunks: DataFrame, most: int = OVERSIZE) -> DataFrame:
    """One row: how many chunks are longer than the selector has seen, and the longest of them (0 if none)."""
    return chunks.where(F.col("length") > most).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("max_length"))
