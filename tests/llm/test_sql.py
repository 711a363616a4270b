"""The queries against their SQL on tables with odd rows (ids unique, as the SQL assumes)."""

import duckdb
import pytest

from bytemill.llm import queries
from tests.llm import test_chat, test_hnsw, test_minhash
from tests.llm.oracle import same


def held(path, name):
    return duckdb.sql(f"SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')").to_arrow_table()


def test_near_duplicates(spark, tmp_path):
    rows = [*test_minhash.corpus(200, 8), (900, None), (901, ""), (902, "One"), (903, "one"), (904, "a b c"), (905, "A  b\tc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op4_minhash(spark, str(tmp_path)), queries.oracle_sql()["op4_minhash"], documents=held(tmp_path, "documents"))


def test_near_vectors(spark, tmp_path):
    x = test_hnsw.data(120, 4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 24), (302, []), (303, [float("nan")] * 24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(queries.op8_hnsw(spark, str(tmp_path)), queries.oracle_sql()["op8_hnsw"], embeddings=held(tmp_path, "embeddings"))


@pytest.mark.parametrize("seed", [4, 5])
def test_conversations(spark, tmp_path, seed):
    rows = [*test_chat.data(60, seed), (700, 0, "a]<b[[c\\", "x"), (700, 1, "[]<", "<</SYS>><s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.op7_chat(spark, str(tmp_path)), queries.oracle_sql()["op7_chat"], conversations=held(tmp_path, "conversations"))
