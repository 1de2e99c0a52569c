"""Queries against their SQL on rows that once told them apart."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tracewell.operators import relational


def differing(spark, sf_dir, name):
    """Rows that only the SQL has, and those that only the query has."""
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want, got = want.fetchall(), [tuple(r) for r in __spark_entry__.queries()[name](spark, str(sf_dir)).select(*columns).collect()]
    assert want
    return sorted(set(want) - set(got), key=repr), sorted(set(got) - set(want), key=repr), len(got) - len(want)


DOCUMENTS = [
    'token = "068c002651439458202064d35406d6b34bf01abe"',  # digits of a key that pass the checksum
    "card 4111 1111 1111 1111 and A/c no. 123456789012",  # an account is no card
    "x " * 492 + "4111 1111 1111 1111",  # where a long line would be cut
    "c12 4111111111111111",
    'hend.ks Ingon.do and token = "9885103314b39ed955fd8ac9efa74c6fd87b66ee", mail a.b@c.example',
]


@pytest.mark.parametrize("name", ["redacted_cards", "stamped_detections", "document_entities"])
def test_documents(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(DOCUMENTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert differing(spark, tmp_path, name) == ([], [], 0)


def test_pages(spark, tmp_path):
    pages = ["<h1>a&amp;&amp;&amp</h1><p>b &quot;c&quot; &copyd; &amp;amp;</p>", "<p>&ampx;</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert differing(spark, tmp_path, "page_lines") == ([], [], 0)


@pytest.mark.parametrize("name", ["co_occurrence_pairs", "edge_merge_support", "case_overviews"])
def test_tasks_grow_in_number_with_the_table(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(relational, "TASK_ROWS", 40)
    lines = [(k // 3, k % 7, k % 5, k % 4 + 1) for k in range(300)] + [(k, 1, 1, 1) for k in range(100)]  # the last: an edge that all orders have
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 9 AS o_custkey, timestamp_ntz'2020-01-01' + make_dt_interval(CAST(id % 11 AS int)) AS o_orderdate FROM range(100)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS c_custkey FROM range(12)").write.parquet(f"{tmp_path}/customer.parquet")
    assert differing(spark, tmp_path, name) == ([], [], 0)
    plan = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "hashpartitioning(" in plan and ", 10), REPARTITION_BY_NUM" in plan  # 400 rows by 40, beyond the session's 4
