"""The catalogue of queries: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytemill.functions import codecs
from bytemill.functions.layouts import CHECKED, LAYOUTS, PLAIN
from bytemill.functions.scalars import class_share, human_size
from bytemill.operators import archives, benchmark, chunking, dataset, features, labeling, manifests, selection
from bytemill.schema import ARCHIVE_CHUNK, DATASET_CHUNK
from bytemill.sources.corpus import CORPORA, all_corpora, corpus, described

Query = Callable[[SparkSession, str], DataFrame]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d)


def chunks(spark: SparkSession, d: str, size: int = ARCHIVE_CHUNK) -> DataFrame:
    return chunking.fixed(docs(spark, d), size)


def six(c: str) -> F.Column:
    """A float as the oracle has it: six places by the same operations on doubles, so that ties fall alike."""
    return (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)


def described_chunks(df: DataFrame) -> DataFrame:
    return df.select("path", "chunk_idx", "offset", F.col("length").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))


def source_scan(spark, d):
    return described(docs(spark, d))


def source_scan_union(spark, d):
    return all_corpora(spark, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def chunk_fixed(size: int) -> Query:
    return lambda spark, d: described_chunks(chunks(spark, d, size))


def byte_counts(spark, d):
    return features.byte_counts(chunks(spark, d))


def byte_histogram(spark, d):
    f = features.feature_rows(chunks(spark, d)).select("path", "chunk_idx", F.posexplode("hist").alias("byte", "freq"))
    return f.where("freq > 0").select("path", "chunk_idx", "byte", six("freq"))


def scalar(name: str) -> Query:
    return lambda spark, d: features.feature_rows(chunks(spark, d)).select("path", "chunk_idx", F.col(name).alias("value")).select("path", "chunk_idx", six("value"))


def printable_ratio_native(spark, d):
    return chunks(spark, d).select("path", "chunk_idx", class_share(F.col("content"), "printable").alias("value")).select("path", "chunk_idx", six("value"))


def hex_ratio(spark, d):
    return chunks(spark, d).select("path", "chunk_idx", class_share(F.col("content"), "hex").alias("value")).select("path", "chunk_idx", six("value"))


def byte_mean_variance(spark, d):
    f = features.feature_rows(chunks(spark, d)).select("path", "chunk_idx", F.col("byte_mean").alias("mean"), F.col("byte_variance").alias("variance"))
    return f.select("path", "chunk_idx", six("mean"), six("variance"))


def bigram_topk(spark, d):
    f = features.feature_rows(chunks(spark, d)).select("path", "chunk_idx", F.posexplode("bigram").alias("rank", "freq"))
    return f.select("path", "chunk_idx", "rank", six("freq"))


def feature_scalars(spark, d):
    f = features.feature_rows(chunks(spark, d))
    return f.select("path", "chunk_idx", F.col("length").cast("long").alias("length"), *[six(c) for c in ("entropy", "printable_ratio", "byte_mean", "byte_variance")])


def feature_vector(spark, d):
    """What the elements of the ML vector add up to, by their places."""
    from pyspark.ml.functions import vector_to_array

    f = features.with_vector(features.feature_rows(chunks(spark, d))).withColumn("v", vector_to_array("features"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    hist, pairs = F.slice("v", 6, 256), F.slice("v", 262, 10)
    f = f.select("path", "chunk_idx", F.size("v").cast("long").alias("n"), F.col("v")[0].alias("length"), F.col("v")[1].alias("entropy"), total(F.transform(hist, lambda x, i: x * i)).alias("hist_mean"), total(F.transform(hist, lambda x: x * x)).alias("hist_squares"), total(F.transform(pairs, lambda x, i: x * (i + 1))).alias("pair_sum"))
    return f.select("path", "chunk_idx", "n", "length", six("entropy"), six("hist_mean"), six("hist_squares"), six("pair_sum"))


def feature_wide(spark, d):
    w = features.wide(features.feature_rows(chunks(spark, d)))
    return w.select("path", "chunk_idx", six("hist_32"), six("hist_101"), six("bigram_top0"), six("bigram_top9"))


def window_classify(spark, d):
    return chunking.windows(docs(spark, d)).select("path", F.posexplode("is_text").alias("win_idx", "is_text"))


def _boundaries(spark, d, merged: bool):
    w = chunking.windows(docs(spark, d).where(F.octet_length("content") > 0), keep_content=True)
    b = chunking.raw_boundaries(F.col("is_text"), F.octet_length("content"))
    return w.select("path", F.posexplode(chunking.merged_boundaries(b) if merged else b).alias("idx", "offset"))


def boundaries_raw(spark, d):
    return _boundaries(spark, d, False)


def boundaries_merged(spark, d):
    return _boundaries(spark, d, True)


def chunk_content_aware(spark, d):
    return described_chunks(chunking.content_aware(docs(spark, d)))


def chunker_comparison(spark, d):
    """Both chunkers over the documents and the pages."""
    out = None
    for name in ("documents", "pages"):
        source = corpus(spark, d, name)
        for chunker in ("fixed_size", "content_aware"):
            c = chunking.chunk(source, chunker).agg(F.count(F.lit(1)).alias("chunks"), (F.floor(F.avg("length") * 1e6 + 0.5) / 1e6).alias("avg_length"), F.min("length").cast("long").alias("min_length"), F.max("length").cast("long").alias("max_length"))
            c = c.select(F.lit(name).alias("corpus"), F.lit(chunker).alias("chunker"), "chunks", "avg_length", "min_length", "max_length")
            out = c if out is None else out.union(c)
    return out


def oversized_chunks(spark, d):
    return chunking.oversized(chunking.content_aware(docs(spark, d)))


def algorithm_registry(spark, d):
    return codecs.registry(spark)


def default_search_set(spark, d):
    return codecs.registry(spark).where("in_default_search").select("algorithm_id", "name")


def known_chunks(spark: SparkSession) -> DataFrame:
    """Fixed contents whose sizes are known: ties, runs, noise, text."""
    made = {"empty": b"", "seventeen letters": b"a" * 17, "forty letters": b"ab" * 20, "line": b"the quick brown fox jumps over the lazy dog\n", "zeros": bytes(4096), "pangrams": b"the quick brown fox jumps over the lazy dog " * 90}
    made["noise"] = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(128))
    made["hex"] = made["noise"].hex().encode()
    made["squares"] = b"".join(b"%d," % (i * i) for i in range(9000))
    return spark.createDataFrame([(k, 0, len(v), v) for k, v in made.items()], "path string, chunk_idx int, length int, content binary")


def label_known(spark, d):
    """Every codec's size and the winner for fixed contents."""
    f = labeling.sizes(known_chunks(spark), ["store", "gzip", "bzip2", "lzma", "zstd"])
    return labeling.best(f, ["store", "bzip2", "lzma", "zstd"]).select(F.col("path").alias("name"), *[f"size_{c}" for c in ("store", "gzip", "bzip2", "lzma", "zstd")], "best_algorithm", "best_size")


def given_sizes(spark, d):
    """Sizes made up from each document's length and number, many of them equal, and a codec picked by the number."""
    n, i = F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.col("doc_id")
    made = {"store": n, "gzip": F.expr("n div 2 + 20"), "bzip2": F.expr("n div 3 + 40 * (doc_id % 3)"), "lzma": F.expr("n div 3 + 60"), "zstd": F.expr("n div 2 + 20 - doc_id % 2")}
    f = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", n.alias("n"))
    names = F.array(*[F.lit(c) for c in made])
    return f.select("doc_id", F.col("n").alias("length"), names[(i % 5).cast("int")].alias("algorithm"), *[(F.col("n") if c == "store" else e).alias(f"size_{c}") for c, e in made.items()], *[F.lit(0.0).alias(f"time_{c}") for c in made])


def judged(spark, d):
    return labeling.best(given_sizes(spark, d), ["store", "bzip2", "lzma", "zstd"])


def label_given(spark, d):
    return judged(spark, d).select("doc_id", "best_algorithm", "best_size")


def ratio_given(spark, d):
    return selection.compression_ratio(judged(spark, d)).select("n", "original", six("predicted"), six("always_zstd"), six("ceiling"))


def strategies_given(spark, d):
    return benchmark.against_ceiling(benchmark.strategies(given_sizes(spark, d))).select("name", "total_original", "total_compressed", six("ratio"), six("percent_of_ceiling"))


def codec_counts_given(spark, d):
    return archives.counted(judged(spark, d).drop("algorithm").withColumnRenamed("best_algorithm", "algorithm"))


def label_sizes(spark, d):
    return labeling.long_form(labeling.sizes(chunks(spark, d))).select("path", "chunk_idx", "algorithm", "size")


def label_winners(spark, d):
    return labeling.label(chunks(spark, d)).select("path", "chunk_idx", "best_algorithm", "best_size")


def winner_histogram(spark, d):
    return labeling.label(chunks(spark, d)).groupBy("best_algorithm").agg(F.count(F.lit(1)).alias("chunks"), F.sum("best_size").alias("bytes"))


#: How many bytes each codec's output begins with whatever the content.
MAGIC = {"store": 0, "gzip": 2, "bzip2": 3, "lzma": 6, "zstd": 4}


def codec_roundtrip(codec: str) -> Query:
    def run(spark, d):
        c = chunks(spark, d).withColumn("algorithm", F.lit(codec))
        back = c.withColumn("payload", codecs.compressed("content", "algorithm")).withColumn("back", codecs.decompressed("payload", "algorithm"))
        return back.select("path", "chunk_idx", F.sha2("back", 256).alias("sha256"), F.lower(F.hex(F.substring("payload", 1, MAGIC[codec]))).alias("magic"))

    return run


def manifest_records(spark, d):
    source = docs(spark, d)
    return manifests.exploded(manifests.build(source, chunking.fixed(source).withColumn("algorithm", F.lit("store"))))


def manifest_json(spark, d):
    """Manifests written as JSON and parsed again."""
    source = docs(spark, d)
    m = manifests.build(source, chunking.fixed(source).withColumn("algorithm", F.lit("store")))
    back = manifests.from_json(manifests.to_json(m))
    return back.select(F.col("source_file").alias("path"), "source_size", "source_sha256", F.size("chunks").cast("long").alias("chunks"), "version")


def manifest_violations(spark, d):
    """Seeded faults by document number: wrong size, wrong checksum, a gap, an unknown codec."""
    source = docs(spark, d)
    m = manifests.build(source, chunking.fixed(source).withColumn("algorithm", F.lit("store")))
    n = F.substring_index("source_file", "/", -1).cast("long") % 10
    first = lambda field, value: F.transform("chunks", lambda c, i: F.when(i == 0, c.withField(field, value(c))).otherwise(c))
    faulty = m.withColumn("source_size", F.when(n == 1, F.col("source_size") + 1).otherwise(F.col("source_size")))
    faulty = faulty.withColumn("chunks", F.when(n == 2, first("checksum", lambda c: F.lit("00"))).when(n == 3, first("offset", lambda c: c["offset"] + 1)).when(n == 4, first("algorithm", lambda c: F.lit("rar"))).otherwise(F.col("chunks")))
    return manifests.violations(faulty, source)


def archive_layout(layout: str) -> Query:
    def run(spark, d):
        made = LAYOUTS[layout]
        a = archives.pack(docs(spark, d), layout, algorithm="store")
        e = archives.entries(a, layout)
        h = archives.headers(a, layout).join(a.select("path", F.octet_length("archive").cast("long").alias("archive_size")), "path")
        return e.join(h, "path").select("path", "chunk_idx", "payload_offset", F.lit(made.table_at()).cast("long").alias("table_offset"), (F.col("chunk_count") * made.entry.size + made.table_at()).alias("payload_start"), "archive_size")

    return run


def archive_header_bytes(spark, d):
    a = archives.pack(docs(spark, d), "checked", algorithm="store")
    return a.select("path", F.lower(F.hex(F.substring("archive", 1, CHECKED.header.size))).alias("header"))


def restored(layout: str, **options) -> Query:
    def run(spark, d):
        back = archives.unpacked(archives.pack(docs(spark, d), layout, **options), layout)
        return back.select("path", F.octet_length("content").cast("long").alias("restored_length"), F.sha2("content", 256).alias("restored_sha256"))

    return run


def archive_corruption_matrix(spark, d):
    """Archives of the longest document with one fault each, and what reading them raises."""
    source = docs(spark, d).orderBy(F.desc(F.octet_length("content")), "path").limit(1)
    out = None
    for layout, made in LAYOUTS.items():
        a = archives.pack(source, layout, algorithm="zstd")
        n = F.octet_length("archive")
        put = lambda at, hexed: F.expr(f"concat(substring(archive, 1, {at}), X'{hexed}', substring(archive, {at + len(hexed) // 2 + 1}))")
        cases = {
            "sound": F.col("archive"), "magic": put(0, "58585858"), "empty": F.lit(b""), "short_header": F.substring("archive", 1, 20), "short_table": F.substring("archive", 1, made.table_at() + made.entry.size - 1),
            "short_payload": F.substring(F.col("archive"), F.lit(1), n - 5), "unknown_codec": put(made.table_at(), "c8"), "source_size": put(5, "000000000000ffff"), "source_checksum": put(13, "00" * 32),
            "chunk_length": put(made.table_at() + 1, "00000001"), "trailing_bytes": F.concat("archive", F.lit(b"more")),
        }
        if made.checked:
            cases["chunk_checksum"] = put(made.table_at() + 9, "00" * 32)
        rows = a.select(F.explode(F.array(*[F.struct(F.lit(f"{layout}/{k}").alias("path"), v.alias("archive")) for k, v in cases.items()])).alias("r")).select("r.*")
        got = archives.unpacked(rows, layout).select(F.col("path").alias("case"), F.coalesce("error", F.lit("none")).alias("error"))
        out = got if out is None else out.union(got)
    return out


def compress_summary(spark, d):
    source = docs(spark, d)
    return archives.summary(archives.pack(source, "checked", algorithm="store"), source).select("path", "original_size", "compressed_size", six("ratio"), "chunk_count")


def compress_summary_best(spark, d):
    source = docs(spark, d)
    return archives.summary(archives.pack(source, "checked"), source).agg(F.count(F.lit(1)).alias("files"), F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"))


def archive_codec_histogram(spark, d):
    return archives.algorithm_counts(archives.pack(docs(spark, d), "checked", algorithm="zstd"))


def labels(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet")


def stratified_split_sizes(spark, d):
    return selection.stratified_split(labels(spark, d), "quality", "doc_id").groupBy(F.col("quality").alias("label"), "split").agg(F.count(F.lit(1)).alias("n"))


def stratified_split_rows(spark, d):
    return selection.stratified_split(labels(spark, d), "quality", "doc_id").select("doc_id", F.col("quality").alias("label"), "split")


def balanced_class_weights(spark, d):
    return selection.class_weights(labels(spark, d), "quality").select(F.col("quality").alias("label"), "n", six("weight"))


def confusion_matrix(spark, d):
    return selection.confusion(labels(spark, d), "quality", "toxic")


def classification_report(spark, d):
    return selection.report(labels(spark, d), "quality", "toxic").select("label", six("precision"), six("recall"), six("f1"), "support")


def accuracy(spark, d):
    return selection.accuracy(labels(spark, d), "quality", "toxic").select("n", six("accuracy"))


#: Labelled chunks that the selector of the queries is fitted on, at most (a bound on the fit, not on what it is applied to).
FIT_ROWS = 5000


def _selector(spark, d):
    """A forest trained on the documents' own chunks, of the size that is predicted: of FIT_ROWS drawn by a hash of path and number, the split's training part."""
    every = chunks(spark, d)
    n = every.count()
    some = every.where(F.pmod(F.xxhash64("path", "chunk_idx"), F.lit(1_000_000)) < F.lit(1_000_000 * FIT_ROWS // max(n, FIT_ROWS)))
    rows = dataset.featured(labeling.label(some, keep=["content"]))
    split = selection.stratified_split(rows.withColumn("key", F.concat_ws(":", "source_file", "chunk_idx")), "best_algorithm", "key")
    return selection.train(split.where("split = 'train'").drop("split", "key"))


def selector_predict(spark, d):
    return selection.predict(chunks(spark, d), _selector(spark, d)).select("path", "chunk_idx", "algorithm")


def selector_ratio(spark, d):
    found = selection.predict(chunks(spark, d), _selector(spark, d))
    return selection.compression_ratio(labeling.label(found, keep=["algorithm"]))


def benchmark_strategies(spark, d):
    found = benchmark.run_all(benchmark.load_chunks(docs(spark, d)), _selector(spark, d))
    return benchmark.against_ceiling(found).select("name", "total_original", "total_compressed", six("ratio"), six("percent_of_ceiling"))


def always_store_strategy(spark, d):
    found = benchmark.run_all(benchmark.load_chunks(docs(spark, d))).where("name = 'always_store'")
    return found.select("name", F.col("total_original").cast("long").alias("total_original"), F.col("total_compressed").cast("long").alias("total_compressed"), six("ratio"))


def labelled_dataset(spark, d):
    rows = dataset.rows(docs(spark, d), chunk_size=DATASET_CHUNK)
    return rows.select(F.col("source_file").alias("path"), "chunk_idx", F.col("length").cast("long").alias("length"), F.col("size_store"), six("entropy"), (F.col("best_size") <= F.col("length")).alias("best_le_length"))


def human_sizes(spark, d):
    n = docs(spark, d).select(F.octet_length("content").cast("long").alias("bytes"))
    wide = n.select(F.explode(F.array("bytes", F.col("bytes") * 1024, F.col("bytes") * 1048576, F.col("bytes") * 1073741824)).alias("bytes")).distinct()
    return wide.select("bytes", human_size(F.col("bytes")).alias("text"))


def dataset_resume(spark, d):
    """Files still to do if those with an even number were done."""
    source = docs(spark, d).select("path")
    done = source.where(F.substring_index("path", "/", -1).cast("long") % 2 == 0)
    todo = dataset.pending(source, done)
    return source.agg(F.count(F.lit(1)).alias("files")).join(todo.agg(F.count(F.lit(1)).alias("pending")), F.lit(True))


def label_universe(spark, d):
    f = labels(spark, d)
    return f.select(F.col("quality").alias("label")).union(f.select(F.col("toxic").alias("label"))).distinct()


def longest_chunks(spark, d):
    """The ten longest content-aware chunks of each corpus, a top-k report."""
    out = None
    for name in CORPORA:
        c = chunking.content_aware(corpus(spark, d, name)).select(F.lit(name).alias("corpus"), "path", "chunk_idx", F.col("length").cast("long").alias("length"))
        out = c if out is None else out.union(c)
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("length"), "path", "chunk_idx"))
    return out.withColumn("rank", rank).where("rank <= 10")


QUERIES: dict[str, Query] = {
    "source_scan": source_scan, "source_scan_union": source_scan_union,
    **{f"chunk_fixed_{n}": chunk_fixed(n) for n in (4096, 16384, 777)},
    "byte_counts": byte_counts, "byte_histogram": byte_histogram, "entropy": scalar("entropy"), "printable_ratio": scalar("printable_ratio"), "printable_ratio_native": printable_ratio_native, "hex_ratio": hex_ratio,
    "byte_mean_variance": byte_mean_variance, "bigram_topk": bigram_topk, "feature_scalars": feature_scalars, "feature_vector": feature_vector, "feature_wide": feature_wide,
    "window_classify": window_classify, "boundaries_raw": boundaries_raw, "boundaries_merged": boundaries_merged, "chunk_content_aware": chunk_content_aware,
    "chunker_comparison": chunker_comparison, "oversized_chunks": oversized_chunks, "longest_chunks": longest_chunks,
    "algorithm_registry": algorithm_registry, "default_search_set": default_search_set,
    "label_known": label_known, "label_given": label_given, "ratio_given": ratio_given, "strategies_given": strategies_given, "codec_counts_given": codec_counts_given, "label_sizes": label_sizes, "label_winners": label_winners, "winner_histogram": winner_histogram,
    **{f"codec_roundtrip_{c}": codec_roundtrip(c) for c in ("store", "gzip", "bzip2", "lzma", "zstd")},
    "manifest_records": manifest_records, "manifest_json": manifest_json, "manifest_violations": manifest_violations,
    "archive_layout_checked": archive_layout("checked"), "archive_layout_plain": archive_layout("plain"), "archive_header_bytes": archive_header_bytes,
    "encode_decode": restored("checked", algorithm="zstd"), "encode_decode_content_aware": restored("checked", chunker="content_aware"), "pack_unpack": restored("plain"), "archive_corruption_matrix": archive_corruption_matrix,
    "compress_summary": compress_summary, "compress_summary_best": compress_summary_best, "archive_codec_histogram": archive_codec_histogram,
    "stratified_split_sizes": stratified_split_sizes, "stratified_split_rows": stratified_split_rows, "balanced_class_weights": balanced_class_weights,
    "confusion_matrix": confusion_matrix, "classification_report": classification_report, "accuracy": accuracy, "label_universe": label_universe,
    "selector_predict": selector_predict, "selector_ratio": selector_ratio, "benchmark_strategies": benchmark_strategies, "always_store_strategy": always_store_strategy,
    "labelled_dataset": labelled_dataset, "human_size": human_sizes, "dataset_resume": dataset_resume,
}
assert PLAIN.entry.size == 17 and CHECKED.entry.size == 49
