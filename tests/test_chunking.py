import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytemill.functions.kernels import window_labels
from bytemill.operators import chunking
from bytemill.schema import ENTROPY, HEX, LEAST_RUN, PRINTABLE, WINDOW

PANGRAM = b"the quick brown fox jumps over the lazy dog "


def sources(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "path string, content binary")


def lengths(df):
    return [r["length"] for r in df.orderBy("path", "chunk_idx").collect()]


def plain(data, window=WINDOW, least=LEAST_RUN):
    """Content-aware boundaries by a loop."""
    labels = window_labels(data, window, PRINTABLE, ENTROPY, HEX).tolist()
    cuts = [i * window for i in range(1, len(labels)) if labels[i] != labels[i - 1]]
    out = [0]
    for c in cuts:
        if c - out[-1] >= least:
            out.append(c)
    return [*out, len(data)]


def test_fixed_sizes_and_reassembly(spark):
    df = chunking.fixed(sources(spark, b"x" * 250, b"", bytes(range(256)) * 10), 100)
    rows = df.orderBy("path", "chunk_idx").collect()
    assert [r["length"] for r in rows if r["path"] == "0"] == [100, 100, 50] and not [r for r in rows if r["path"] == "1"]
    assert b"".join(bytes(r["content"]) for r in rows if r["path"] == "2") == bytes(range(256)) * 10
    assert [r["offset"] for r in rows if r["path"] == "0"] == [0, 100, 200]


def test_merge_drops_the_boundary_that_ends_a_short_run(spark):
    b = spark.range(1).select(F.expr("array(0L, 2048L, 2560L, 6000L)").alias("b"), F.expr("array(0L, 512L, 1024L, 1536L, 5000L)").alias("c"), F.expr("array(0L, 9L)").alias("d"))
    row = b.select(*[chunking.merged_boundaries(F.col(c), 1024).alias(c) for c in "bcd"]).first()
    assert row["b"] == [0, 2048, 6000] and row["c"] == [0, 1024, 5000] and row["d"] == [0, 9]


def test_letter_that_is_a_hex_digit(spark):
    data = b"a" * 4000 + bytes(range(256)) * 20
    rows = chunking.content_aware(sources(spark, data), least_run=512).orderBy("chunk_idx").collect()
    assert [r["offset"] for r in rows] + [rows[-1]["offset"] + rows[-1]["length"]] == [0, 3584, 4096, 9120]


def test_mixed_content(spark):
    r = random.Random(1)
    noise = r.randbytes(3000)
    alternating = (PANGRAM * 80 + noise) * 3
    hexed = PANGRAM * 60 + noise.hex().encode() + PANGRAM * 60
    prose = b"add a bad cafe face fade " * 80
    values = [alternating, hexed, prose, b"q", b"x" * 512]
    df = chunking.content_aware(sources(spark, *values))
    for i, v in enumerate(values):
        mine = [r for r in df.orderBy("chunk_idx").collect() if r["path"] == str(i)]
        assert b"".join(bytes(r["content"]) for r in mine) == v
        assert [r["offset"] for r in mine] + [len(v)] == plain(v)
    assert len([r for r in df.collect() if r["path"] == "0"]) > 3 and len([r for r in df.collect() if r["path"] == "2"]) == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([PANGRAM, b"0123456789abcdef", b"\x80\xff\x01"]), st.integers(1, 60)), max_size=8).map(lambda p: b"".join(a * n for a, n in p)), min_size=1, max_size=8))
def test_content_aware_equals_the_loop(spark, values):
    rows = chunking.content_aware(sources(spark, *values)).orderBy("path", "chunk_idx").collect()
    for i, v in enumerate(values):
        mine = [r for r in rows if r["path"] == str(i)]
        assert [r["offset"] for r in mine] + ([len(v)] if v else []) == (plain(v) if v else [])
        assert all(r["length"] >= LEAST_RUN for r in mine[:-1])


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs_over_blocks_equal_the_loop(spark, size):
    r = random.Random(size)
    values = [b"".join(r.choice([PANGRAM, b"0123456789abcdef", b"\x80\xff\x01"]) * r.randrange(1, 200) for _ in range(12)) for _ in range(4)] + [b"", b"q", b"x" * 512, b"x" * 513]
    step = size * WINDOW
    blocks = [(str(i), a, v[a : a + step]) for i, v in enumerate(values) for a in range(0, len(v), step)]
    r.shuffle(blocks)
    rows = chunking.runs_of_blocks(spark.createDataFrame(blocks, "path string, offset long, content binary")).orderBy("path", "chunk_idx").collect()
    for i, v in enumerate(values):
        mine = [x for x in rows if x["path"] == str(i)]
        assert [x["offset"] for x in mine] + ([mine[-1]["offset"] + mine[-1]["length"]] if mine else []) == (plain(v) if v else [])
        assert [x["chunk_idx"] for x in mine] == list(range(len(mine)))


def test_runs_of_a_file_over_blocks(spark, tmp_path, monkeypatch):
    from bytemill import files

    monkeypatch.setattr(files, "BLOCK", 2 * WINDOW)
    data = (PANGRAM * 80 + random.Random(2).randbytes(3000)) * 5
    (tmp_path / "f").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    rows = files.file_chunks(spark, str(tmp_path / "f"), "content_aware").orderBy("chunk_idx").collect()
    assert b"".join(bytes(x["content"]) for x in rows) == data and [x["offset"] for x in rows] + [len(data)] == plain(data)
    assert files.file_chunks(spark, str(tmp_path / "empty"), "content_aware").count() == 0


def test_parameters_are_checked_at_once(spark):
    df = sources(spark, b"x")
    for call in (lambda: chunking.fixed(df, 0), lambda: chunking.chunk(df, "other"), lambda: chunking.content_aware(df, window=0), lambda: chunking.content_aware(df, entropy=9), lambda: chunking.content_aware(df, printable=1.1), lambda: chunking.content_aware(df, hexes=-1), lambda: chunking.content_aware(df, least_run=0), lambda: chunking.chunk(df, "content_aware", -1)):
        with pytest.raises(ValueError):
            call()


def test_oversized(spark):
    row = chunking.oversized(chunking.content_aware(sources(spark, PANGRAM * 3000, b"x"))).first()
    assert (row["n"], row["max_length"]) == (1, len(PANGRAM) * 3000)
