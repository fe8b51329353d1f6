"""Queries against their SQL over tables with what the driver's small ones do not hold."""

import duckdb
import pytest

from __spark_entry__ import CORE, CORE_SQL


def against_sql(spark, folder, name, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts, 1)))
    con.execute(f"COPY documents TO '{folder}/documents.parquet'")
    cursor = con.execute(CORE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    got = sorted((tuple(r) for r in CORE[name](spark, str(folder)).select(*columns).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["redacted_lengths", "redaction_documents", "redaction_residue", "published_copies"])
def test_pages_full_of_addresses(spark, tmp_path, name):
    """Pages with more hits than a rule that someone wrote may have: all of them go."""
    many = " and ".join(f"10.0.{i}.1" for i in range(45))
    mails = ", ".join(f"a{i}@b.example" for i in range(50))
    against_sql(spark, tmp_path, name, [many, "from 10.0.0.1 by a@b.example", "nothing", f"{mails} at 10.2.3.4", None])


@pytest.mark.parametrize("name", ["masked_findings", "rule_counts", "spans_by_category"])
def test_cards_beside_other_numbers(spark, tmp_path, name):
    """A number beside a card's, as the last part of an address or of a phone number, is no part of it."""
    card, other = "4111111111111111", "4880761348116108"
    texts = [f"at 38.253.197.126 {other} now", f"{card} 27.65.93.188", f"call +1 (836) 555-9331 {card} 53.121.55.90", "on 38.211.12.42 4366089147969128 there", "4111111111111112 42", "The license", None]
    against_sql(spark, tmp_path, name, texts)
