"""The registered queries against their SQL on DuckDB."""

import duckdb
import pytest

from test_operators import host_documents

from tarnwick.llm import oracles, quality_rules, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(cell, r)) for r in want.fetchall())
    assert sorted(tuple(map(cell, r)) for r in queries.QUERIES[name](spark, sf).select(*columns).collect()) == want


def test_host_verdicts_equal_their_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", host_documents())
    want = sorted(db.execute(oracles.QUALITY_RULES).fetchall(), key=str)
    docs = spark.createDataFrame(host_documents(), "doc_id long, source string, text string").repartition(3)
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == want
