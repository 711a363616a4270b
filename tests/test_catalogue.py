"""Every query of the catalogue against its SQL in DuckDB, on a small table with odd texts."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from bytemill.plans import catalogue, oracle

SQL = oracle.oracle()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r, path = random.Random(4), tmp_path_factory.mktemp("sf")
    noise = lambda n: "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1000)])) for _ in range(n))
    prose = "the quick brown fox jumps over the lazy dog. "
    texts = [None, "", "a", prose * 30, prose * 900, noise(3000), prose * 40 + noise(1500) + prose * 50, "0123456789abcdef" * 200, "é" * 2049, "x" * 4096, "x" * 4097] + [noise(r.randrange(900)) for _ in range(20)]
    tables = {
        "documents": ("doc_id long, text string", [(i, t) for i, t in enumerate(texts)]),
        "pages": ("page_id long, html string", [(i, f"<p>{t}</p>") for i, t in enumerate(texts[:6])]),
        "conversations": ("conv_id long, turn long, text string", [(i // 2, i % 2, t) for i, t in enumerate(texts[:8])]),
        "benchmark": ("item_id long, text string", [(i, t) for i, t in enumerate(texts[2:8])]),
        "labels": ("doc_id long, quality int, toxic int", [(i, int(r.random() < 0.8), int(r.random() < 0.3)) for i in range(90)]),
    }
    con = duckdb.connect()
    for name, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return str(path), con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    path, con = small
    frame = catalogue.QUERIES[name](spark, path)
    columns = sorted(frame.columns)
    got = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    made = con.sql(SQL[name])
    at = [made.columns.index(c) for c in columns]
    assert len(made.columns) == len(columns)
    assert got == sorted((tuple(row[i] for i in at) for row in made.fetchall()), key=repr)


def test_entry_and_names():
    assert set(SQL) <= set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
