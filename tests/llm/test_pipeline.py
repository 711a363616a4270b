import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from bytemill.llm import bpe, mixing, queries
from tests.llm.test_minhash import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    words = {"en": ["the", "cat", "sat", "on", "that", "mat", "with", "hat"], "de": ["der", "hund", "und", "zwei", "auf", "schule", "nicht"]}
    rows = []
    for i in range(500):
        lang = r.choice(["en", "en", "de"])
        rows.append((i, " ".join(r.choices(words[lang], k=r.randrange(20, 60))), lang, r.choice(["src0", "src0", "src1"]), 0))
    for i in range(500, 600):  # copies, near and exact
        d, t, *rest = rows[r.randrange(400)]
        w = t.split(" ")
        if i % 2:
            w[-1] = "end"
        rows.append((i, " ".join(w), *rest))
    rows += [(600, None, "en", "src0", None), (601, "", "de", None, 0), (602, "123 456", None, "src0", 7), rows[5], rows[5]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages_follow_each_other_and_keep_the_columns(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    first = corpus_pipeline.language(spark, docs, path)
    assert first.columns == corpus_pipeline.COLUMNS
    left = first.collect()
    assert {r.doc_id for r in left} == {x[0] for x in rows if x[0] < 600} and len(left) == 602
    second = corpus_pipeline.near_duplicates(spark, first, path).collect()
    want = {d for d, _, c, k in brute([(x[0], x[1]) for x in rows[:600]], 5, 80) if k}
    assert sorted(r.doc_id for r in second) == sorted(want)
    third = corpus_pipeline.mix(spark, spark.createDataFrame(second, first.schema), path)
    assert third.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in third.collect()} < want


def test_run_gives_the_ids_of_the_texts_that_stay(spark, folder):
    path, rows = folder
    out = corpus_pipeline.run(spark, path).collect()
    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken")).read().splitlines())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {x[0]: x[1] for x in rows}
    assert out and all(r.ids == library.encode_ordinary(text[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_language_holds_a_label_whose_texts_have_no_letters(spark):
    rows = [*[(i, "12 !?", "aa", "src0", 5) for i in range(20)], *[(100 + i, "ket zuv", "cc", "src0", 7) for i in range(20)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)
    left = corpus_pipeline.language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.lang) for r in left) == [(100 + i, "cc") for i in range(20)]


def test_empty_table(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
