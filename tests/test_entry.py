"""The driver's entry points, with and without the optional subpackage; queries against their SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from __spark_entry__ import CORE, CORE_SQL

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_rest_without_llm(tmp_path):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(CORE)), str(len(CORE_SQL)), "False"], said.stderr


def test_every_query_of_the_core_has_sql():
    assert set(CORE_SQL) == set(CORE) and set(__spark_entry__.queries()) >= set(CORE)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["email_spans", "ip_spans", "phone_spans", "card_spans", "account_spans", "normalize_text", "exact_rule_spans", "rules_parse", "plan_parse", "plan_merge", "proposal_filters", "benchmark_literals", "value_offsets", "table_column_spans", "original_offsets", "overlap_anti_join", "recognised_boxes", "misread_boxes", "rules_diagnostics", "unsupported_categories", "plan_usable", "plan_pages", "book_literal_spans", "tenant_book_spans", "own_matcher_spans", "redact_with_annotations", "annotations_deleted", "plan_with_annotations", "chunked_texts", "published_copies", "replaced_copies", "hot_page_overlap", "read_and_drawn_boxes", "token_boxes", "category_offsets", "page_rail", "conversation_documents", "gap_report"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    cursor = con.execute(CORE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted((tuple(dict(zip(columns, r)).items()) for r in cursor.fetchall()), key=lambda x: repr(sorted(x)))
    got = CORE[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple((c, r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows, key=lambda x: repr(sorted(x))) == want
