import math
import random

import duckdb

from bytemill.llm import queries, topk
from tests.llm.oracle import same


def brute(rows, k, scale=256):
    fine = [(d, [math.floor(scale * x) for x in v]) for d, v in rows if d is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), d) for d, w in fine if d != q and len(w) == len(v))
            out += [(q, i + 1, d, max(-(2**63), min(2**63 - 1, -x))) for i, (x, d) in enumerate(s[:k])]
    return sorted(out)


def data(seed, n, wide=1.0):
    r = random.Random(seed)
    hot = [r.choice([-1.0, 0.5, 0.25]) for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [r.choice([-1, 1]) * r.random() * wide for _ in range(8)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0, None] * 4), (n + 3, [float("nan")] * 8), (n + 4, [float("inf")] * 8), (None, hot), (150, hot), (50, hot), (n + 5, [1.0, 2.0]), (10_000 * 50, [1.0, 2.0]), (10_001 * 50, [1.0])]
    return rows


def test_same_as_brute_force_with_ties_and_odd_rows(spark):
    for seed, wide in ((1, 1.0), (2, 1e6), (3, 1e5)):
        rows = data(seed, 400, wide)
        df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(5)
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5), (seed, wide)


def test_fewer_than_k_empty_and_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 2), ("GROUP", 5), ("HELD", 400)):
        monkeypatch.setattr(topk, name, value)
    rows = data(4, 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 7, 1000):
        assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), k).collect())) == brute(rows, k)
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(d, v) for d, v in data(5, 200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = duckdb.sql(f"SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')").to_arrow_table()
    same(queries.op5_topk(spark, str(tmp_path)), queries.oracle_sql()["op5_topk"], embeddings=t)
