import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from bytemill import __main__ as cli
from bytemill import files
from bytemill.functions import codecs
from bytemill.functions.layouts import CHECKED, LAYOUTS, PLAIN, unpack
from bytemill.operators import archives, labeling, manifests
from bytemill.schema import ArchiveError, DecodeError, EncodeError, ManifestError, MissingCodecError
from bytemill.sources.archive import register

R = random.Random(5)
TEXT, NOISE = b"the quick brown fox jumps over the lazy dog " * 400, R.randbytes(20_000)
BINARY = bytes((i * 2654435761) % 256 for i in range(20_000))
PAYLOADS = {"text": TEXT, "noise": NOISE, "binary": BINARY, "empty": b"", "mixed": TEXT + NOISE + TEXT}


@pytest.fixture
def sources(spark):
    return spark.createDataFrame(list(PAYLOADS.items()), "path string, content binary")


@pytest.mark.parametrize("name", codecs.names(everything=True, installed=True))
def test_codecs_round_trip(name):
    for data in PAYLOADS.values():
        assert codecs.decompress(codecs.compress(data, name), name) == data


def test_registry():
    assert codecs.names() == ["store", "bzip2", "lzma", "zstd", "brotli"] and [codecs.id_of(c) for c in codecs.CODECS] == list(range(6))
    for bad in (lambda: codecs.get("rar"), lambda: codecs.id_of("rar"), lambda: codecs.name_of(6)):
        with pytest.raises(KeyError):
            bad()
    if codecs.brotli is None:
        with pytest.raises(MissingCodecError):
            codecs.compress(b"x", "brotli")
    with pytest.raises(ValueError):
        codecs.compress(b"x", "zstd", level=99)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("options", [{}, {"algorithm": "store"}, {"algorithm": "gzip", "chunk_size": 777}, {"chunker": "content_aware"}], ids=str)
def test_pack_and_unpack(spark, sources, layout, options):
    packed = archives.pack(sources, layout, **options)
    got = {r["path"]: bytes(r["content"]) for r in archives.unpacked(packed, layout).collect()}
    assert got == PAYLOADS
    for r in packed.collect():  # the native writer and the reader of single archives agree
        assert unpack(bytes(r["archive"]), LAYOUTS[layout]) == PAYLOADS[r["path"]]
        if not options:
            assert len(r["archive"]) <= len(PAYLOADS[r["path"]]) + 49 + 49 * 20


def test_ties_go_to_the_smaller_id(spark):
    row = labeling.label(spark.createDataFrame([("a", 0, b"")], "path string, chunk_idx int, content binary")).first()
    assert row["best_algorithm"] == "store" and row["best_size"] == 0
    chunk = spark.createDataFrame([("a", 0, NOISE[:100])], "path string, chunk_idx int, content binary")
    assert labeling.squeezed(chunk).first()["algorithm"] == "store"
    found = labeling.label(chunk, ["zstd", "lzma"]).first()
    assert found["best_size"] == min(found["size_zstd"], found["size_lzma"])


@pytest.mark.parametrize("layout", [PLAIN, CHECKED], ids=lambda x: x.name)
def test_every_flipped_payload_byte_is_noticed(layout, spark, sources):
    row = archives.pack(sources.where("path = 'text'"), layout.name, algorithm="store").first()
    archive = bytearray(row["archive"])
    for at in [0, 5, 14, 49, 50, 60, layout.payload_at(5) + 3, len(archive) - 1]:
        broken = bytearray(archive)
        broken[at] ^= 0x41
        with pytest.raises(layout.error):
            unpack(bytes(broken), layout)
    unpack(bytes(archive) + b"more", layout)
    for cut in (0, 10, 60, len(archive) - 1):
        with pytest.raises(layout.error):
            unpack(bytes(archive[:cut]), layout)
    assert issubclass(DecodeError, ArchiveError) and issubclass(ArchiveError, ValueError)


def test_written_archives_and_the_data_source(spark, sources, tmp_path):
    out = {r["path"]: r for r in archives.write(sources, str(tmp_path / "a"), "checked").collect()}
    assert set(out) == set(PAYLOADS) and not [f for f in os.listdir(tmp_path / "a") if f.endswith(".tmp")]
    for path, r in out.items():
        assert os.path.getsize(r["file"]) == r["size"] and unpack(open(r["file"], "rb").read(), CHECKED) == PAYLOADS[path]
    register(spark)
    df = spark.read.format("bytemill_archive").load(str(tmp_path / "a"))
    rows = df.where(F.col("path") == out["mixed"]["file"]).orderBy("chunk_idx").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == PAYLOADS["mixed"]
    tables = spark.read.format("bytemill_archive").option("payload", "false").load(str(tmp_path / "a"))
    assert "content" not in tables.columns and tables.where("algorithm = 'store'").count() == sum(1 for r in df.collect() if r["algorithm"] == "store")
    assert df.where("chunk_idx < 1").count() == 4
    blocks = spark.read.format("bytemill_blocks").option("block", 777).load(out["mixed"]["file"])
    assert b"".join(bytes(r["content"]) for r in blocks.orderBy("offset").collect()) == open(out["mixed"]["file"], "rb").read()


def test_manifest_faults(spark, tmp_path):
    source = tmp_path / "f"
    source.write_bytes(NOISE)
    m = files.build_manifest(spark, str(source), chunk_size=4096, algorithm="zstd")
    files.validate(m)
    assert [c["length"] for c in m["chunks"]] == [4096] * 4 + [3616] and m["chunks"][1]["checksum"] == hashlib.sha256(NOISE[4096:8192]).hexdigest()
    same_length = tmp_path / "g"
    same_length.write_bytes(b"!" + NOISE[1:])
    faults = [m | {"version": 2}, m | {"source_size": 5}, m | {"source_sha256": "0" * 64}, m | {"source_file": str(same_length)}, m | {"chunks": m["chunks"][1:]}, m | {"chunks": m["chunks"][:-1]}, m | {"chunks": [m["chunks"][0] | {"algorithm": "rar"}, *m["chunks"][1:]]}, m | {"chunks": [m["chunks"][0] | {"length": -1}, *m["chunks"][1:]]}, m | {"chunks": [*m["chunks"][:1], *m["chunks"]]}]
    for bad in faults:
        with pytest.raises(ManifestError):
            files.validate(bad)
    path = tmp_path / "m.json"
    for text in ("{", "[]", "{}", json.dumps(m | {"chunks": [m["chunks"][0] | {"more": 1}]}), json.dumps(m | {"chunks": [{"offset": 0}]})):
        path.write_text(text)
        with pytest.raises(ManifestError):
            manifests.load(str(path))
    path.write_text(json.dumps({k: v for k, v in m.items() if k != "version"} | {"extra": 1}))
    assert manifests.load(str(path))["version"] == 1
    frame = manifests.frame(spark, m | {"source_file": "p"})
    found = manifests.violations(frame, spark.createDataFrame([("p", b"!" + NOISE[1:])], "path string, content binary")).collect()
    assert sorted(r["check"] for r in found) == ["checksum", "source_sha256"]
    with pytest.raises(ManifestError):
        manifests.raise_first(manifests.violations(frame, spark.createDataFrame([("p", b"")], "path string, content binary")))


def test_encode_refuses_a_wrong_chunk_checksum(spark, tmp_path):
    source = tmp_path / "f"
    source.write_bytes(NOISE)
    m = files.build_manifest(spark, str(source), algorithm="store")
    m["chunks"][2]["checksum"] = "0" * 64
    manifests.write(m, str(tmp_path / "m.json"))
    with pytest.raises(EncodeError):
        files.encode(spark, str(tmp_path / "m.json"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path)) == ["f", "m.json"]


@pytest.mark.parametrize("name", PAYLOADS)
def test_commands(spark, tmp_path, name, capsys):
    source = tmp_path / "f"
    source.write_bytes(PAYLOADS[name])
    a, m, out = str(tmp_path / "a"), str(tmp_path / "m.json"), str(tmp_path / "out")
    assert cli.main(["compress", str(source), a, "--algorithm", "bzip2", "--chunker", "content_aware", "--no-keep-manifest"]) == 0
    assert json.loads(capsys.readouterr().out)["original_size"] == len(PAYLOADS[name]) and not os.path.exists(f"{a}.manifest.json")
    assert cli.main(["decompress", a, out]) == 0 and open(out, "rb").read() == PAYLOADS[name]
    assert cli.main(["manifest", str(source), m, "--algorithm", "lzma"]) == 0 and cli.main(["encode", m, a]) == 0
    assert cli.main(["decode", a, out]) == 0 and open(out, "rb").read() == PAYLOADS[name]
    assert cli.main(["pack", str(source), a]) == 0 and cli.main(["unpack", a, out]) == 0 and open(out, "rb").read() == PAYLOADS[name]
    os.unlink(out)
    assert cli.main(["decode", a, out]) == 1 and not os.path.exists(out)
    with pytest.raises(SystemExit) as e:
        cli.main(["encode", m])
    assert e.value.code == 2


def test_long_homogeneous_text_warns(spark, tmp_path):
    source = tmp_path / "f"
    source.write_bytes(TEXT * 3)
    with pytest.warns(files.OversizedChunkWarning):
        assert len(files.build_manifest(spark, str(source), "content_aware", algorithm="store")["chunks"]) == 1


def test_planning_splits_a_large_archive_by_entries(spark, tmp_path, monkeypatch):
    from bytemill import files
    from bytemill.sources import archive

    (tmp_path / "f").write_bytes(NOISE * 20)
    files.compress(spark, str(tmp_path / "f"), str(tmp_path / "a"), algorithm="store", keep_manifest=False)
    whole = [r for p in archive.ArchiveReader({"path": str(tmp_path / "a")}).partitions() for r in archive.ArchiveReader({"path": str(tmp_path / "a")}).read(p)]
    monkeypatch.setattr(archive, "TASK_BYTES", 10_000)
    reader = archive.ArchiveReader({"path": str(tmp_path / "a")})
    parts = reader.partitions()
    assert len(parts) > 3 and [r for p in parts for r in reader.read(p)] == whole
    assert b"".join(r[-1] for r in whole) == NOISE * 20
