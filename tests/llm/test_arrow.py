import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bytemill.llm import arrow, minhash, ppm


def thue_morse(k):
    """Two different strings of 2**k letters that every polynomial hash modulo 2**64 confuses."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("step", [64, arrow.STEP])
def test_words_and_hashes_by_bytes(monkeypatch, step):
    monkeypatch.setattr(arrow, "STEP", step)
    r = random.Random(4)
    texts = ["".join(r.choices("ab \n\té", k=r.randrange(200))) for _ in range(60)] + ["", None, "x" * 64, "x" * 65, "y" * 300]
    data, offsets = arrow.utf8(pa.array(texts))
    start, end, row = arrow.words(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
    found = [(i, data[a:b].tobytes()) for i, a, b in zip(row.tolist(), start, end, strict=True)]
    assert found == want
    h = arrow.hash_spans(data, start, end)
    of = {}
    for (_, w), x in zip(found, h.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_strings_that_defeat_polynomial_hashes_differ():
    for k in (5, 6, 10, 12):
        a, b = thue_morse(k)
        data, offsets = arrow.utf8(pa.array([a, b, a + " x", "p" + b]))
        h = arrow.hash_spans(data, *arrow.words(data, offsets)[:2])
        assert h[0] != h[1] and h[0] == h[2]
    a, b = thue_morse(10)
    made, cut = minhash.shingles(pa.array([f"one two three {a} five", f"one two three {b} five"]), 4)
    assert not set(made[: cut[1]].tolist()) & set(made[cut[1] :].tolist())


def test_such_words_in_the_operators(spark):
    a, b = thue_morse(10)
    rows = [(1, f"one two {a} three"), (2, f"one two {b} three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(df, width=4).sort("doc_id").collect()] == [1, 2]
    got = {r.doc_id: r.n_known for r in ppm.score(df, ppm.train(df.where("doc_id = 1"))).collect()}
    assert got == {1: 5, 2: 4}


def test_a_text_of_one_long_word_takes_few_bytes_a_byte():
    import tracemalloc

    data, offsets = arrow.utf8(pa.array(["ab " * 4_000_000]))
    tracemalloc.start()
    start, end, _ = arrow.words(data, offsets)
    arrow.hash_spans(data, start, end)
    assert tracemalloc.get_traced_memory()[1] < 30 * len(data)
    tracemalloc.stop()
    assert len(np.unique(end - start)) == 1
