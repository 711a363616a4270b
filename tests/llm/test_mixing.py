import random
import re

import numpy as np
from pyspark.sql import functions as F

from bytemill.llm import mixing, queries
from tests.llm.oracle import same


def docs(spark, tmp_path, n=400):
    r = random.Random(1)
    rows = [(i, r.choice([None, "", "a | b", "x" * r.randrange(9000), "mail a@b.c", "words " * 20]), r.choice(["en", "en", "en", "de", None]), r.choice(["src0"] * 5 + ["src1", "src2", None])) for i in range(n)]
    rows += [rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_query_equals_its_sql(spark, tmp_path):
    docs(spark, tmp_path)
    import duckdb

    t = duckdb.sql(f"SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')").to_arrow_table()
    same(queries.op9_mixing(spark, str(tmp_path)), queries.oracle_sql()["op9_mixing"], documents=t)


def test_marginals_meet_their_targets(spark):
    r = random.Random(2)
    rows = [(i, r.choice("aaab"), r.choice("xyz"), r.randrange(1, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, d string, e string, tokens long")
    goal = {"d": {"a": 0.5, "b": 0.5}, "e": {"x": 0.2, "y": 0.3, "z": 0.5}}
    cells = mixing.rake(df, ["d", "e"], "tokens", 0.3, goal).toPandas()
    for i, name in enumerate(["d", "e"]):
        share = cells.groupby(f"d{i}").w.sum() / cells.w.sum()
        assert all(abs(share[k] - v) < 1e-6 for k, v in goal[name].items())
    assert abs((cells.p * cells.t).sum() / cells.t.sum() - 0.3) < 1e-9 and (cells.p <= 1).all()
    assert cells.residual.max() < 1e-6 and cells.shortfall.max() < 1e-6
    bounded = mixing.rake(df, ["d", "e"], "tokens", 0.6, goal).toPandas()  # the rarer value has not the tokens for it
    assert bounded.residual.max() < 1e-6 and bounded.shortfall.max() > 0.01
    kept = mixing.mix(df, ["d", "e"], "tokens", 0.3, goal).where("mix_kept").groupBy("d").agg(F.sum("tokens").alias("t")).toPandas().set_index("d").t
    assert abs(kept["a"] / kept.sum() - 0.5) < 0.06


def test_given_targets_name_nulls_and_empty_values_apart(spark):
    rows = [(i, x, 10) for i, x in enumerate(["", None, "a"] * 100)]
    df = spark.createDataFrame(rows, "doc_id long, d string, tokens long")
    of = lambda goal: {r.d0: round(r.w / r["all"], 6) for r in mixing.rake(df, ["d"], "tokens", 0.2, {"d": goal}).collect()}
    assert of({None: 0.5, "": 0.25, "a": 0.25}) == {None: 0.5, "": 0.25, "a": 0.25}
    assert of({"": 0.5, "a": 0.5, "absent": 7.0}) == {None: 0.0, "": 0.5, "a": 0.5}
    assert of({None: 1.0}) == {None: 1.0, "": 0.0, "a": 0.0}


def test_many_cells_go_the_long_way_and_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    rows = [(i, "s%d" % (i % 7), "l%d" % (i % 3), i % 11 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, d string, e string, tokens long")
    one = sorted(map(tuple, mixing.mix(df, ["d", "e"], "tokens", 0.5).select("doc_id", F.round("mix_p", 9), "mix_kept").collect()))
    monkeypatch.setattr(mixing, "FEW", 2)
    assert one == sorted(map(tuple, mixing.mix(df, ["d", "e"], "tokens", 0.5).select("doc_id", F.round("mix_p", 9), "mix_kept").collect()))


def test_empty_table_and_plan_without_python(spark):
    df = spark.createDataFrame([], "doc_id long, d string, tokens long, w double, p string")
    out = mixing.mix(df, ["d"], "tokens", 0.5)
    assert out.count() == 0 and out.columns[:5] == df.columns
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
