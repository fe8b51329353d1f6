"""Rule books as tables, a user's matchers, and both against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import literals as L
from veilspark.operators import spans as S
from veilspark.operators.matchers import Matcher, Matchers, OutOfText, register
from veilspark.operators.offsets import normalize
from veilspark.plans import redaction
from veilspark.sources import rules as R

RULES = "rules_id string, line_number int, literal string, is_case_sensitive boolean"
PAGES = "rules_id string, doc_id long, page int, text string"


def brute(text, literal, sensitive):
    needle, n = normalize(literal or "")[0], normalize(text or "")[0]
    low = (lambda s: s) if sensitive else (lambda s: s.translate(S._folded))
    out, at = [], 0
    while needle and (at := low(n).find(low(needle), at)) >= 0:
        out.append((at, at + len(needle)))
        at += len(needle)
    return out


def test_books_of_tenants_against_plain_python(spark):
    random.seed(2)
    word = lambda: random.choice(("alpha", "Beta", "gamma", "KELVIN", "Kelvin", "straße", "STRASSE", "İx", "ſea", "x", "é", "a-b", "10.0.0.1", "  ", "\n"))
    texts = [" ".join(word() for _ in range(random.randint(0, 60))) for _ in range(60)] + ["", None, "a" * 200_000]
    docs = [(random.choice(("t1", "t2", None, "t3")), i, 1 + i % 2, t) for i, t in enumerate(texts)] + [("t1", 0, 1, texts[0])] * 2 + [("t2", None, 1, "alpha beta")]
    docs[-4] = ("t1", 62, 1, "a" * 200_000)
    books = []
    for tenant in ("t1", "t2", "unused"):
        books += [(tenant, k + 1, " ".join(word() for _ in range(random.randint(1, 9))), random.random() < 0.3) for k in range(120)]
        books += [(tenant, 900, "x", False), (tenant, 901, "aa", False), (tenant, 902, "a" * 300, True), (tenant, 903, "  ", False), (tenant, 904, None, None), (tenant, 905, "é", None), (tenant, 906, "Ha-\nlle", False)]
    books += [books[0], (None, 1, "alpha", False)]
    got = L.literal_spans(spark.createDataFrame(docs, PAGES), spark.createDataFrame(books, RULES)).select("rules_id", "doc_id", "page", "rule_line", "start", "stop").collect()
    distinct = set(books)  # two equal rows are one rule
    want = [(t, d, p, line, a, b) for t, d, p, text in docs for bt, line, lit, sensitive in distinct if bt == t is not None for a, b in brute(text, lit, sensitive)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(want) > 500


def test_a_hundred_thousand_literals(spark):
    """As many literals as no broadcast or automaton of one driver is made for; every 500th stands on a page."""
    literals = spark.range(100_000).selectExpr("cast(id as int) line_number", "concat('Customer#', lpad(id, 9, '0'), case when id % 3 = 0 then ' of the northern branch office' else '' end) literal", "false is_case_sensitive")
    docs = spark.range(200).selectExpr("id doc_id", "concat('Paid by customer#', lpad(id * 500, 9, '0'), case when id % 2 = 0 then ' OF the northern branch office.' else ', in cash.' end) text")
    got = {(r["doc_id"], r["rule_line"], r["start"], r["stop"]) for r in L.literal_spans(docs, literals).collect()}
    tail = len(" of the northern branch office")
    assert got == {(i, 500 * i, 8, 26 + tail if 500 * i % 3 == 0 else 26) for i in range(200) if 500 * i % 3 or i % 2 == 0}


def test_odd_tables(spark):
    none = spark.createDataFrame([], PAGES)
    some = spark.createDataFrame([("t", 1, 1, "alpha")], PAGES)
    assert L.literal_spans(none, spark.createDataFrame([("t", 1, "alpha", False)], RULES)).count() == 0
    assert L.literal_spans(some, spark.createDataFrame([], RULES)).count() == 0
    clashing = some.withColumn("gram", F.lit(1)).withColumn("n", F.lit("n")).withColumn("needle", F.lit("x")).withColumn("key", F.lit(2))
    assert [r["start"] for r in L.literal_spans(clashing, spark.createDataFrame([("t", 1, "PHA", False)], RULES)).collect()] == [2]


def test_books_from_text(spark):
    books = spark.createDataFrame([("t1", '"Heron"\nemails\nnonsense\n'), ("t2", '!"heron"\nip addresses\nphone\n'), ("t3", "# nothing\nnonsense"), ("t4", "names")], "rules_id string, body string")
    docs = spark.createDataFrame([("t1", 1, 1, "Heron a@b.example 10.0.0.1"), ("t2", 2, 1, "Heron heron a@b.example 10.0.0.1"), ("t3", 3, 1, "Heron a@b.example"), (None, 4, 1, "Heron")], PAGES)
    got = sorted((r["rules_id"], r["doc_id"], r["rule_line"], r["matched_text"]) for r in L.book_spans(docs, books).collect())
    assert got == [("t1", 1, 1, "Heron"), ("t1", 1, 2, "a@b.example"), ("t2", 2, 1, "heron"), ("t2", 2, 2, "10.0.0.1")]
    assert [r[0] for r in L.unusable_books(books).collect()] == ["t3"]
    numbered = L.book_spans(docs.selectExpr("cast(substring(rules_id, 2) as long) rules_id", "doc_id", "page", "text"), books.selectExpr("cast(substring(rules_id, 2) as long) rules_id", "body"))
    assert {r["rules_id"] for r in numbered.collect()} == {1, 2}


def order_finder():
    def orders(texts):
        return [[m.span() for m in re.finditer(r"#(\d+)", t)] for t in texts]

    return orders


orders = order_finder()


def test_a_users_matcher(spark):
    """It is named in a rule book and takes part in overlap rules, refusal, masking and reports."""
    own = Matchers().add(Matcher("order numbers", orders, gate="#", accept=lambda v: F.length(v) > 3, refine=lambda m: (m["start"] + 1, m["stop"]), overlaps="distinct"))
    book = R.RuleBook.parse(spark, "Order  Numbers\nemails\nunknown", own.names)
    assert book.categories == ("order numbers", "emailAddresses") and len(book.problems) == 1
    docs = spark.createDataFrame([(1, "see #123, #4 and a@b.example"), (2, None), (3, " ".join(f"#{i}" for i in range(1000, 1041))), (4, "é𝒳 #987")], "doc_id long, text string")
    found = S.spans(docs, book, matchers=own).filter("category = 'order numbers'")
    assert sorted((r["doc_id"], r["start"], r["stop"], r["matched_text"]) for r in found.filter("doc_id <> 3").collect()) == [(1, 5, 8, "123"), (4, 4, 7, "987")]
    out = redaction.redact(docs, book, matchers=own)
    texts = {r["doc_id"]: r["text"] for r in out.pages.collect()}
    assert texts[1] == "see #███, #4 and " + "█" * 11 and texts[3].startswith("#1000") and texts[4] == "é𝒳 #███"
    assert [(r["doc_id"], "41 times" in r["problem"]) for r in out.problems.collect()] == [(3, True)]
    with pytest.raises(ValueError, match="taken"):
        own.add(Matcher("emails", orders))
    with pytest.raises(OutOfText):
        Matcher("bad", lambda texts: [[(0, 99)] for _ in texts]).ranges(["short"])


def test_a_users_matcher_in_sql(spark):
    register(spark, Matchers().add(Matcher("orders", orders)))
    spark.createDataFrame([(1, "x #12 #3", "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, kept string").createOrReplaceTempView("pages_of_orders")
    rows = spark.sql("SELECT * FROM find_spans(TABLE(pages_of_orders), 'orders') ORDER BY start")
    assert rows.columns == ["doc_id", "kept", "start", "stop", "matched_text"] and [tuple(r) for r in rows.collect()] == [(1, "k", 2, 5, "#12"), (1, "k", 6, 8, "#3")]
    for sql in ("SELECT * FROM find_spans(TABLE(SELECT 1 AS a), 'orders')", "SELECT * FROM find_spans(TABLE(pages_of_orders), 'nobody')"):
        with pytest.raises(Exception, match="text|name"):
            spark.sql(sql)
