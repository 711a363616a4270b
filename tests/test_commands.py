"""The whole way of the command line: a corpus, its dataset, a model, and files compressed with it."""

import json
import os
import random

import pytest

from bytemill import __main__ as cli
from bytemill import files
from bytemill.operators import archives, chunking, selection

R = random.Random(3)
TEXT, NOISE = b"the quick brown fox jumps over the lazy dog " * 300, R.randbytes(9_000)


@pytest.fixture(scope="module")
def model_path(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    for i in range(6):
        (base / f"t{i}").write_bytes(TEXT[i:] + str(i).encode())
        (base / f"n{i}").write_bytes(R.randbytes(9_000))
        (base / f"c{i}").write_bytes(b"".join(b"%d,%d,abc\n" % (k, k * i) for k in range(900)))
    work = tmp_path_factory.mktemp("work")
    assert cli.main(["dataset", "--corpus", str(base), "--out", str(work / "d.parquet"), "--shard-dir", str(work / "shards"), "--chunk-size", "1024"]) == 0
    assert cli.main(["train", "--dataset", str(work / "d.parquet"), "--out", str(work / "m")]) == 0
    metrics = json.loads((work / "m.metrics.json").read_text())
    assert set(metrics) == {"split_sizes", "val", "test", "compression_ratio", "registry_algorithms", "class_weight"} and set(metrics["split_sizes"]) == {"train", "val", "test"}
    assert metrics["compression_ratio"]["predicted"] <= metrics["compression_ratio"]["ceiling"]
    assert cli.main(["benchmark", str(base), "--model-path", str(work / "m")]) == 0
    return str(work / "m")


@pytest.mark.parametrize("chunker", ["fixed_size", "content_aware"])
def test_compress_with_the_model_and_back(spark, model_path, tmp_path, chunker, capsys):
    source, a, out = tmp_path / "f", str(tmp_path / "a"), str(tmp_path / "out")
    source.write_bytes(TEXT + NOISE + TEXT)
    assert cli.main(["compress", str(source), a, "--model-path", model_path, "--chunker", chunker, "--batch-size", "7"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["compressed_size"] == os.path.getsize(a) and sum(said["algorithm_counts"].values()) == said["chunk_count"] and said["algorithm_counts"].get("store")
    assert os.path.exists(f"{a}.manifest.json")
    assert cli.main(["decompress", a, out]) == 0 and open(out, "rb").read() == TEXT + NOISE + TEXT
    assert cli.main(["pack", str(source), a, "--mode", "model", "--model-path", model_path, "--chunker", chunker]) == 0
    assert cli.main(["unpack", a, out]) == 0 and open(out, "rb").read() == TEXT + NOISE + TEXT


def test_model_mode_in_frames_and_refusals(spark, model_path, tmp_path):
    model = selection.load(model_path)
    sources = spark.createDataFrame([("x", TEXT + NOISE), ("y", b"")], "path string, content binary")
    packed = archives.pack(sources, "checked", mode="model", predict=lambda c: selection.predict(c, model))
    assert {r["path"]: bytes(r["content"]) for r in archives.unpacked(packed).collect()} == {"x": TEXT + NOISE, "y": b""}
    with pytest.raises(ValueError):
        archives.chosen(chunking.fixed(sources), mode="other")
    with pytest.raises(ValueError):
        archives.chosen(chunking.fixed(sources), mode="model")
    with pytest.raises(KeyError):
        archives.chosen(chunking.fixed(sources), algorithm="rar")
    source = tmp_path / "f"
    source.write_bytes(TEXT)
    with pytest.raises(ValueError):
        files.build_manifest(spark, str(source))
    if "brotli" not in __import__("bytemill.functions.codecs", fromlist=["names"]).names(installed=True):
        assert cli.main(["compress", str(source), str(tmp_path / "a"), "--algorithm", "brotli"]) == 1
    assert cli.main(["decompress", str(tmp_path / "none"), str(tmp_path / "o")]) == 1
