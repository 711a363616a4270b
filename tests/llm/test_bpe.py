import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from bytemill.llm import bpe, queries

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(open(FILE).read().splitlines())
    return bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bitmap_finds_the_least():
    bits, held, r = bpe.RankBitmap(50_000), set(), random.Random(1)
    for _ in range(5000):
        if held and r.random() < 0.4:
            held.remove(x := r.choice(sorted(held)))
            bits.remove(x)
        else:
            held.add(x := r.randrange(50_000))
            bits.add(x)
        assert bits.first() == min(held, default=-1)


def test_same_ids_as_the_library(both):
    encoder, library = both
    r = random.Random(2)
    alphabet = ["a", "th", "e", " ", "  ", "\n", "'s", "'ll", "é", "ß", "日本", "😀", "1", "23", "!", "\t", "\x1c", "\x85", "\xa0", " ", "​", "A", "ing", "<|endoftext|>"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 700, "the " * 900, "\n\n x  y \n", "x ", " x", " 's 's"]
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert memoryview(ids).cast("i").tolist() == library.encode_ordinary(text), text


@pytest.mark.parametrize("pattern", [r"\w+|\s+|[^\w\s]+", r"\p{L}+|[^\p{L}]", r"(?s:.{1,7})", P.PATTERN + " "])
def test_other_patterns_run_as_they_are(both, pattern):
    ranks = both[0].ranks
    encoder, library = bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    texts = ["the cat sat", None, "", *("".join(r.choices(["a", "the", " ", "  ", "\n", "é", "12", "!", "'s"], k=r.randrange(40))) for _ in range(300))]
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert memoryview(ids).cast("i").tolist() == library.encode_ordinary(text or ""), text


def test_query_against_the_library(spark, tmp_path, both):
    _, library = both
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(["the", "Hund", "naïve", "x1", "日本", "\n", "don't", "", "😀"], k=r.randrange(50)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (None, "abc"), (5, "again"), (5, "again"), (1002, "ab" * 200_000), (1003, "x " * 200_000)]
    spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, decoded string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = queries.op3_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_decode_replaces_a_column_of_its_name(spark):
    df = spark.createDataFrame([([256], "x"), (None, "y")], "ids array<int>, decoded string")
    out = bpe.decode(df, FILE)
    assert out.columns == ["ids", "decoded"] and out.count() == 2


def test_a_long_pre_token_stays_near_linear(both):
    encoder, library = both
    text = "".join(random.Random(3).choices("abcdefgh", k=300_000))
    assert memoryview(encoder.encode_many([text])[0]).cast("i").tolist() == library.encode_ordinary(text)


def test_frame_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "Hello wörld", "y"), (3, "Hello wörld", "y"), (None, "abc", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, FILE, P.PATTERN), FILE).withColumn("text", F.col("decoded").cast("string"))
    got = sorted(((r.doc_id or 0, len(r.ids), r.text) for r in out.collect()))
    assert [(i, t) for i, _, t in got] == [(0, "abc"), (1, ""), (2, ""), (3, "Hello wörld"), (3, "Hello wörld")]
    once = bpe.encode(df, FILE, P.PATTERN, decoded_col="back")
    assert sorted((r.doc_id or 0, bytes(r.back).decode()) for r in once.collect()) == [(i, t) for i, _, t in got]
    assert bpe.encode(df.limit(0), FILE, P.PATTERN).count() == 0


def test_shared_queue_gives_the_same_as_one_by_one(both):
    encoder, _ = both
    r = random.Random(4)
    parts = ["".join(r.choices(["a", "aa", "th", "e", "s", "ing", "ö", "日", "0"], k=r.randrange(1, 40))).encode() for _ in range(2000)]
    assert [memoryview(x).cast("i").tolist() for x in encoder.merge_together(parts)] == encoder.merge(parts)


def test_recent_keeps_what_is_used():
    c = bpe.Recent(4)
    for word in "abcdefgh":
        for k in c.missing({"a", word}):
            c[k] = k
        assert c["a"] == "a" and c[word] == word and len(c) + len(c.old) <= 8
