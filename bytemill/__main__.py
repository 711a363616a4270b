"""python -m bytemill COMMAND ...: files in, archives, manifests, datasets, models and reports out."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from bytemill import files
from bytemill.operators import benchmark, dataset, manifests, selection
from bytemill.schema import ARCHIVE_CHUNK, CHUNKERS, CODECS, DATASET_CHUNK
from bytemill.sources import corpus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bytemill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, chunking: int | None = None, model: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        if chunking:
            p.add_argument("--chunker", choices=CHUNKERS, default="fixed_size")
            p.add_argument("--chunk-size", type=int, default=chunking)
        if model:
            p.add_argument("--model-path")
            p.add_argument("--algorithm", choices=CODECS)
        return p

    c = command("compress", "input", "output", chunking=ARCHIVE_CHUNK, model=True)
    c.add_argument("--batch-size", type=int, default=256, help="rows of an Arrow batch, for either chunker")
    c.add_argument("--manifest-path")
    c.add_argument("--no-keep-manifest", action="store_true")
    command("decompress", "archive", "output")
    c = command("manifest", "input", "manifest_out", chunking=ARCHIVE_CHUNK, model=True)
    c.add_argument("--batch-size", type=int, default=256, help="rows of an Arrow batch, for either chunker")
    command("encode", "manifest", "output")
    command("decode", "archive", "output")
    c = command("pack", "input", "output", chunking=ARCHIVE_CHUNK, model=True)
    c.add_argument("--mode", choices=("brute_force", "model"), default="brute_force")
    command("unpack", "archive", "output")
    c = command("dataset", chunking=DATASET_CHUNK)
    c.add_argument("--corpus", default="data/raw")
    c.add_argument("--out", required=True)
    c.add_argument("--shard-dir", required=True)
    c.add_argument("--force", action="store_true")
    c = command("train")
    c.add_argument("--dataset", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--val-frac", type=float, default=0.15)
    c.add_argument("--test-frac", type=float, default=0.15)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--class-weight", choices=("balanced", "none"), default="balanced")
    c = command("benchmark", "folder")
    c.add_argument("--model-path")
    c.add_argument("--chunk-size", type=int, default=ARCHIVE_CHUNK)
    return top


def train(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Split, fit, evaluate, and write the model with its metrics beside it."""
    rows = dataset.load(spark, a.dataset)
    rows = selection.stratified_split(rows.selectExpr("*", "concat_ws(':', source_file, chunk_idx) as key"), "best_algorithm", "key", a.val_frac, a.test_frac, a.seed).cache()
    small = [r[0] for r in selection.small_classes(rows, "best_algorithm").collect()]
    if small:
        print(f"warning: fewer than 10 rows of {', '.join(map(str, small))}", file=sys.stderr)
    model = selection.train(rows.where("split = 'train'").drop("split", "key"), a.seed, a.class_weight == "balanced")
    found = model.transform(selection.with_vector(rows)).select("split", "best_algorithm", "algorithm", "length", "best_size", *[c for c in rows.columns if c.startswith("size_")]).cache()
    out: dict = {"split_sizes": {r["split"]: r["count"] for r in found.groupBy("split").count().collect()}}
    for name in ("val", "test"):
        part = found.where(f"split = '{name}'")
        out[name] = {"accuracy": selection.accuracy(part, "best_algorithm", "algorithm").first()["accuracy"], "report": [r.asDict() for r in selection.report(part, "best_algorithm", "algorithm").collect()], "confusion_matrix": [r.asDict() for r in selection.confusion(part, "best_algorithm", "algorithm").collect()]}
    out["compression_ratio"] = selection.compression_ratio(found.where("split = 'test'")).first().asDict()
    out |= {"registry_algorithms": CODECS, "class_weight": a.class_weight}
    selection.save(model, a.out)
    with open(f"{a.out.rstrip('/')}.metrics.json", "w") as f:
        json.dump(out, f, indent=2)
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("bytemill").getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", getattr(a, "batch_size", 2000))
    model = selection.load(a.model_path) if getattr(a, "model_path", None) else None
    try:
        if a.command == "compress":
            print(json.dumps(files.compress(spark, a.input, a.output, a.chunker, a.chunk_size, model, a.algorithm, a.manifest_path, not a.no_keep_manifest), indent=2))
        elif a.command in ("decompress", "decode"):
            files.decode(a.archive, a.output)
        elif a.command == "manifest":
            manifests.write(files.build_manifest(spark, a.input, a.chunker, a.chunk_size, model, a.algorithm), a.manifest_out)
        elif a.command == "encode":
            files.encode(spark, a.manifest, a.output)
        elif a.command == "pack":
            files.pack(spark, a.input, a.output, a.algorithm, a.mode, a.chunker, a.chunk_size, model)
        elif a.command == "unpack":
            files.unpack_file(a.archive, a.output)
        elif a.command == "dataset":
            listed = corpus.files(spark, a.corpus, content=False).cache()
            listed.count()  # as the folder is now: a file that goes meanwhile has failed
            sources = corpus.files(spark, a.corpus, tolerant=True)
            made = dataset.build(sources, a.shard_dir, a.chunker, a.chunk_size, a.force)
            dataset.save(made, a.out)
            failed = dataset.failures(listed, a.shard_dir, a.chunker, a.chunk_size)
            n = failed.count()
            print(f"{made.count()} rows of {made.select('source_file').distinct().count()} files; {n} files failed")
            for r in failed.orderBy("source_file").limit(20).collect():
                print(f"bytemill: {r['source_file']}: {r['error']}", file=sys.stderr)
        elif a.command == "train":
            print(json.dumps(train(spark, a)["compression_ratio"], indent=2))
        else:
            chunks = benchmark.load_chunks(corpus.files(spark, a.folder), a.chunk_size)
            benchmark.against_ceiling(benchmark.run_all(chunks, model)).orderBy("ratio").show(truncate=False)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"bytemill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
