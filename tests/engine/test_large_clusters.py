"""Queries on clusters with more members than the given small tables have, against DuckDB."""

import duckdb
import pytest

from mosaiq import queries as q
from mosaiq.operators import evidence
from tests.engine.test_oracles import rows


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Tables of two clusters with 200 members each; and a connection that has them."""
    folder, con = str(tmp_path_factory.mktemp("large")), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    tables = {
        "documents": "SELECT i AS doc_id, 'Text ' || i AS text, 'en' AS lang, 'src' || i % 5 AS source, 9 AS n_chars FROM range(600) r(i)",
        "pages": "SELECT i AS page_id, 'https://x.example.com/' || i AS url, '<p>x</p>' AS html FROM range(7) r(i)",
        "embeddings": "SELECT i AS vec_id, CAST([1, i] AS FLOAT[]) AS embedding, CAST(i // 3 % 2 AS INT) AS label FROM range(600) r(i)",
    }
    for name, sql in tables.items():
        con.execute(f"CREATE TABLE {name} AS {sql}")
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["angle_merge", "angle_merge_counters"])
def test_notes_beyond_a_hundred(spark, large, name):
    folder, con = large
    wanted, found = con.sql(q.ORACLES[name]), q.QUERIES[name](spark, folder)
    assert rows(found.columns, map(tuple, found.collect())) == rows(wanted.columns, wanted.fetchall())


def test_terms_are_cut_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(evidence, "CUT", 50)
    texts = [(i % 50, f"casa rey casa rey {i % 3} mil") for i in range(100)] + [(60, ""), (61, None)]
    found = evidence.term_counts(spark.createDataFrame(texts, "id long, text string"), ["id"], whole=True)
    assert found.rdd.getNumPartitions() >= 30
    wanted = {(i, w): 2 * n for i in range(50) for w, n in {"casa": 2, "rey": 2, "mil": 1, "casa rey": 2, "rey casa": 1, "rey mil": 1}.items()}
    assert {(r.id, r.term): r.tf for r in found.collect()} == wanted
