"""Rules, matchers, tables, plans, redaction, proposals, recognition."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark import book_queries, queries
from veilspark.functions import proposals as P
from veilspark.functions import text as functions_text
from veilspark.functions.text import normalized, normalized_breaks
from veilspark.operators import offsets, proposals, recognition, tables
from veilspark.operators import spans as S
from veilspark.plans import plan, redaction, reports
from veilspark.sources import copies
from veilspark.sources import rules as R
from veilspark.sources import tables as sources

PAGE = """Statement for Orlaith Vance of Tern
Works. SSN 219-09-4417.
17 Quarry Lane Unit 9
Denver CO 80203
orlaith@tern-works.example
Phone (303) 555-0176
Savings account
88120045631
Card kept 5500-XXXX-XXXX-1187
Other card 5555 5555 5555 4444"""
RULES = '# mine\n"Orlaith"\n"Tern Works"\n"5500-XXXX-XXXX-1187"\nsocial security numbers\ncredit card numbers\naccount numbers\nemail addresses\nphone numbers\nstreet addresses\n'


def pages(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")


def one(spark, category, *texts):
    book = R.RuleBook((R.Rule("category", None, False, category, 1),))
    rows = S.spans(pages(spark, *texts), book).orderBy("doc_id", "start").collect()
    return [[r["matched_text"] for r in rows if r["doc_id"] == i + 1] for i in range(len(texts))]


def test_whole_page(spark):
    book = R.RuleBook.parse(spark, RULES)
    assert not book.problems
    found = offsets.in_original(pages(spark, PAGE), S.spans(pages(spark, PAGE), book)).collect()
    assert len(found) == 11
    texts = {r["original_text"] for r in found}
    assert {"Tern\nWorks", "17 Quarry Lane Unit 9\nDenver CO 80203", "88120045631"} <= texts
    assert all(PAGE[r["original_start"] : r["original_stop"]] == r["original_text"] for r in found)


def test_normalisation_matches_its_offsets(spark):
    random.seed(7)
    texts = ["".join(random.choice("ab- \n\t\r1. ") for _ in range(40)) for _ in range(500)] + ["", "﻿x", "Wood-\nland Park", "123-45-\n6789", "abc -\ndef"]
    rows = pages(spark, *texts).select("text", normalized(F.col("text")).alias("n"), normalized_breaks(F.col("text")).alias("b")).collect()
    for r in rows:
        n, starts, ends = offsets.normalize(r["text"])
        assert r["n"] == n and len(r["b"]) == len(n)
        assert r["b"].replace("\n", " ").replace(" ", " ") == n
        assert all(0 <= a < b <= len(r["text"]) for a, b in zip(starts, ends))
    assert offsets.normalize("Wood-\nland Park")[0] == "Woodland Park"
    assert offsets.normalize("123-45-\n6789")[0] == "123-45-6789"
    assert offsets.normalize("abc -\ndef")[0] == "abc -def"


def test_rule_lines(spark):
    book = R.RuleBook.parse(spark, '﻿"A"\r\n!"b"\r"A"\nE-Mail  addresses\nemails\nnonsense\n!emails\na "b"\n"open\n"  "\n#c\n')
    assert [(r.kind, r.literal, r.is_case_sensitive, r.category) for r in book.rules] == [("exact", "A", False, None), ("exact", "b", True, None), ("category", None, False, "emailAddresses")]
    assert [p[:2] for p in book.problems] == [("duplicateRule", 3), ("duplicateRule", 5), ("unknownCategory", 6), ("caseSensitiveMarkerRequiresQuotes", 7), ("strayQuote", 8), ("unterminatedQuote", 9), ("emptyExactMatch", 10)]
    with pytest.raises(R.EmptyRuleSet):
        R.RuleBook.parse(spark, "# nothing").required()
    with pytest.raises(R.UnreadableRules):
        R.decoded(b"{\\rtf1 x}")
    assert R.decoded("é".encode("latin-1")) == "é"


def test_addresses(spark):
    texts = [
        "Office: 2450 Cedar Ridge Parkway, Boulder, CO 80301.", "Send it to PO Box 771, Tulsa OK 74103 by noon", "Tulsa, OK", "sw-core-02 | Round Rock TX-4410 | guest",
        "Ivo Marsh, 905 Linden Ave Apt 12C, Salem OR 97301", "905 Linden Ave Apt 12C Salem OR 97301-0042 Dues 11,040.00", "Lindenstrasse 8, 20095 Hamburg, Germany", "Sold in Oregon last month.",
    ]
    assert one(spark, "streetAddresses", *texts) == [
        ["2450 Cedar Ridge Parkway, Boulder, CO 80301"], ["PO Box 771, Tulsa OK 74103"], [], [], ["905 Linden Ave Apt 12C, Salem OR 97301"],
        ["905 Linden Ave Apt 12C Salem OR 97301-0042"], ["Lindenstrasse 8, 20095 Hamburg, Germany"], [],
    ]


def test_matchers(spark):
    assert one(spark, "socialSecurityNumbers", "123-45-6789", "123-45 6789", "1123-45-6789") == [["123-45-6789"], [], []]
    assert one(spark, "creditCardNumbers", "4111 1111 1111 1111 cvv: 123 exp 04/28", "4026-XXXX-XXXX-7715", "4111 1111 1111 1112") == [["4111 1111 1111 1111", "123", "04/28"], [], []]
    assert one(spark, "accountNumbers", "Savings account\n771204459", "Account\n\nmore words\n771204459", "IBAN DE89 3704 0044 0532 0130 00") [:2] == [["771204459"], []]
    assert one(spark, "phoneNumbers", "Phone: (415) 555-0123", "415.555.0123 x12", "+46 70 123 4567") == [["(415) 555-0123"], ["415.555.0123 x12"], ["+46 70 123 4567"]]
    assert one(spark, "ipAddresses", "10.0.0.1:80 999.1.1.1 ::1 fe80::1", "1.2.3.4.5") == [["10.0.0.1", "::1", "fe80::1"], []]
    assert one(spark, "driversLicenseNumbers", "the license applies here too", "license D1234567") == [[], ["D1234567"]]
    assert one(spark, "datesOfBirth", "DOB: 1990-01-02", "2020-01-01", "| Name | DOB |\n|---|---|\n| A | 1990-01-02 |\n") == [["1990-01-02"], [], ["1990-01-02"]]
    exact = R.RuleBook((R.Rule("exact", "aa", False, None, 1), R.Rule("exact", "art", False, None, 2)))
    assert [r["matched_text"] for r in S.spans(pages(spark, "aaaa Smart carts"), exact).collect()] == ["aa", "aa", "art", "art"]


def test_cards_beside_other_numbers(spark):
    """A card number is found whatever number stands beside it; groups that are too short for one are joined, also 6 and 13 digits."""
    card = "4111111111111111"
    beside = [f"from 38.253.197.126 {card}", f"{card} 27.65.93.188", f"+1 (836) 555-9331 {card} 53.121.55.90", f"12 4111-1111-1111-1111 42 {card} 7", f"4242 {card[:-1]}2 42", f"12 {card[:-1]}2", f"4111 1111 1111 1111 {card}"]
    assert one(spark, "creditCardNumbers", *beside) == [[card], [card], [card], ["4111-1111-1111-1111", card], [], [], ["4111 1111 1111 1111", card]]
    assert one(spark, "creditCardNumbers", "3782 822463 10005.", "622588 1234567890120", "123456 4222222222222", "411111111111 11111111", "4222222222222 1234") == [["3782 822463 10005"], ["622588 1234567890120"], ["4222222222222"], [], ["4222222222222"]]


def test_matches_are_worked_out_once(spark):
    """No filter below the projection that finds spans works out all of them again."""
    texts = pages(spark, "account 1234567 of 10.0.0.1", "| Account | x |\n|---|---|\n| 1234567 | y |\n", "")
    found = S.spans(texts, book_of("accountNumbers"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], r["matched_text"]) for r in found.collect()) == [(1, "1234567"), (2, "1234567")]


def test_breaks_of_even_texts(spark):
    """Texts whose white space is single blanks and line feeds go a shorter way, with the same result."""
    rng = random.Random(7)
    kinds = ["a", "é", "-", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "\u2028", "\u2029", "\u3000", "\ufeff", "1"]
    rows = [("".join(rng.choice(kinds[:k]) for _ in range(rng.randint(0, 9))),) for k in (7, 7, len(kinds)) for _ in range(1500)]
    t = F.col("t")
    both = spark.createDataFrame(rows, "t string").select("t", normalized(t).alias("n"), normalized_breaks(t).alias("b"), functions_text._all_breaks(t).alias("whole"), F.rlike(t, F.lit(functions_text.UNEVEN)).alias("uneven")).collect()
    assert all(r["b"] == r["whole"] for r in both)
    assert len({r["t"] for r in both if not r["uneven"] and "\n" in r["t"]}) > 50


def test_texts_made_of_keys_are_dealt_out(spark, tmp_path):
    """A file of one row group is not one task for texts that are made of its keys."""
    spark.range(1, 51).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for found in (queries.labelled_pages(spark, str(tmp_path)), book_queries.category_offsets(spark, str(tmp_path))):
        assert found.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert {r["doc_id"] for r in queries.labelled_pages(spark, str(tmp_path)).collect()} == set(range(1, 51))


def test_many_exact_rules_agree_with_few(spark):
    words = [f"w{i}" for i in range(100)] + ["The", "a.b\\E"]
    rules = tuple(R.Rule("exact", w, w == "The", None, i + 1) for i, w in enumerate(words))
    docs = pages(spark, "W1 w11 the The a.B\\E w99w99", "", "none")
    few = [r for k in range(0, len(rules), 40) for r in S.spans(docs, R.RuleBook(rules[k : k + 40])).select("doc_id", "rule_line", "start", "stop", "matched_text").collect()]
    many = S.spans(docs, R.RuleBook(rules)).select("doc_id", "rule_line", "start", "stop", "matched_text").collect()
    assert sorted(few) == sorted(many) and len(many) > 5


def test_tables():
    text = "x\n| A | **B** |\n|---|:--|\n| 1 |  |\n| `2` | 3 | 4 |\n\n| no | rule |\n"
    assert [(h, c, text[a:b]) for h, c, a, b in tables.cells(text)] == [("A", "1", "1"), ("A", "2", "2"), ("B", "3", "3")]


def test_runaway_and_unused(spark):
    book = R.RuleBook((R.Rule("exact", "x", False, None, 1), R.Rule("exact", "zzz", False, None, 2)))
    found = S.spans(pages(spark, "x " * 41, "x x"), book)
    kept, away = S.refused(found)
    assert kept.count() == 2 and [(r["doc_id"], r["n"]) for r in away.collect()] == [(1, 41)]
    assert [r["rule_description"] for r in S.unused_rules(book, found).collect()] == ["“zzz”"]


def test_plan_round_trip_and_merge(spark):
    rows = [("a", 0, True, "Ann Lee", "names", 2), ("a", 1, False, "12 34", "", 1), ("a", 2, True, "zz", "x - y", None)]
    items = spark.createDataFrame(rows, "source_name string, pos int, is_selected boolean, value string, label string, page int")
    again = plan.parse(plan.written(items)).select("is_selected", "value", "label", "page").collect()
    assert sorted(again, key=str) == sorted([r[2:] for r in rows], key=str)
    edited = spark.createDataFrame([("a", 0, True, "Ann Lee", "", 2), ("a", 5, False, "Ann Lee", "", 2), ("a", 6, True, "mine", "", None)], items.schema)
    merged = {r["value"]: r["is_selected"] for r in plan.merged(items, edited).collect()}
    assert merged == {"Ann Lee": False, "12 34": False, "zz": True, "mine": True}
    used, refused = plan.usable_values(items)
    assert [r["value"] for r in used.collect()] == ["Ann Lee"] and [r["value"] for r in refused.collect()] == ["zz"]
    g = plan.guidance(spark.createDataFrame([("g", "# T\n- one\n\n> two\n" + "x" * 3000 + "\nlast"), ("e", "")], "rules_id string, body string")).orderBy("rules_id").collect()
    assert (g[1]["guidance"], g[1]["omitted_character_count"]) == ("T\none\ntwo", 3006) and g[0]["guidance"] == ""


def test_redaction(spark):
    book = R.RuleBook.parse(spark, RULES)
    out = redaction.redact(pages(spark, PAGE, "nothing here", "  "), book)
    got = {r["doc_id"]: r for r in out.pages.collect()}
    assert got[1]["status"] == "redacted" and got[2]["status"] == "no_matches" and got[3]["status"] == "not_examined"
    assert len(got[1]["text"]) == len(offsets.normalize(PAGE)[0]) and "123-45" not in got[1]["text"] and "Nikhil" not in got[1]["text"]
    docs = {r["doc_id"]: r["disposition"] for r in out.documents.collect()}
    assert docs == {1: "written", 2: "nothing_matched", 3: "nothing_matched"}
    away = redaction.redact(pages(spark, "x " * 50 + "a@b.example"), R.RuleBook((R.Rule("exact", "x ", False, None, 1), R.Rule("category", None, False, "emailAddresses", 2))), hold=True)
    assert [r["disposition"] for r in away.documents.collect()] == ["written_unverified"] and away.problems.count() == 1
    assert reports.gaps(out.pages, R.RuleBook.parse(spark, "names\nemails\nbad rule")).count() == 3
    assert [r["verdict"] for r in reports.verdicts(out.documents).orderBy("doc_id").collect()][1] == "nothing matched"
    reported = spark.createDataFrame([("ann  LEE", ["Ann Lee Jones"]), ("zzz", ["Ann"]), ("", ["x"])], "r string, i array<string>")
    assert [r[0] for r in reported.select(redaction.worth_acting_on(F.col("r"), F.col("i"))).collect()] == [True, False, False]


def test_names_and_publication(spark, tmp_path):
    assert sources.output_name("a.pdf") == "a redacted.pdf" and sources.output_name("a.pdf", {"a redacted.pdf"}) == "a redacted 2.pdf"
    df = spark.range(3)
    assert sources.published(df, f"{tmp_path}/s1", f"{tmp_path}/out", verified=False) is None
    assert sources.published(df, f"{tmp_path}/s2", f"{tmp_path}/out", verified=True) == f"{tmp_path}/out"
    with pytest.raises(FileExistsError):
        sources.published(df, f"{tmp_path}/s3", f"{tmp_path}/out", verified=True)


def test_proposals(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 7) for i in range(30))
    for most in (10, 37, 60, 200):
        assert "\n".join(proposals.chunks(text, most)) == text
    assert "".join(proposals.halves(text)) == text and proposals.halves("a") is None
    rows = spark.createDataFrame([(1, 1, "Name: Ann Lee", "name", ""), (1, 1, "$5.00", "name", ""), (1, 1, "not there", "address", ""), (1, 1, "ann lee", "full name", "")], "doc_id long, page int, text string, kind string, reason string")
    kept = proposals.filtered(rows)
    assert sorted(r["text"] for r in kept.collect()) == ["Ann Lee"] + ["not there"]
    spans, missing = proposals.located(kept, pages(spark, "Dear Ann\nLee and ANN LEE"))
    assert sorted((r["start"], r["stop"]) for r in spans.collect()) == [(5, 12), (17, 24)] and [r["text"] for r in missing.collect()] == ["not there"]
    rule = spark.createDataFrame([(1, 1, 0, 9, "Dear Ann")], "doc_id long, page int, start int, stop int, matched_text string")
    assert [r["start"] for r in proposals.not_covered(spans, rule).collect()] == [17]
    hit = spark.createDataFrame([("SSN: 123", "123"), ("1 2 123", "123"), ("Dear Ann Smith", "ann")], "p string, r string")
    assert [r[0] for r in hit.select(P.is_rule_hit_with_caption(F.col("p"), F.col("r"))).collect()] == [True, False, True]
    asked = proposals.proposed(pages(spark, "a b"), lambda t: [("a", "name", ""), ("a ", "name", "")])
    assert asked.count() == 1


def test_recognition(spark):
    box = (0.0, 0.0, 10.0, 1.0)
    line = recognition.Line
    assert recognition.boxes("12-3456789", [line("no 12-3456/89 here", box)]) == [box]
    assert recognition.boxes("12-34567O9", [line("no 12-3456789 here", box)]) == [box]
    assert recognition.boxes("02210x", [line("02110x", box)]) == []
    assert recognition.boxes("Ann Lee Jones", [line("Dear Ann Lee", box), line("Jones said", (0.0, 2.0, 10.0, 1.0))]) == [box, (0.0, 2.0, 10.0, 1.0)]
    tokens = ((0, 4, (0.0, 0.0, 4.0, 1.0)), (5, 8, (5.0, 0.0, 3.0, 1.0)))
    assert recognition.boxes("Ann", [line("Dear Ann", box, tokens)]) == [(5.0, 0.0, 3.0, 1.0)]
    assert recognition.agrees((0, 0, 2, 1), (1, 0, 3, 1)) and not recognition.agrees((0, 0, 2, 1), (1, 0, 4, 1))
    values = spark.createDataFrame([(1, 1, "Ann")], "doc_id long, page int, value string")
    read = spark.createDataFrame([(1, 1, [("Dear Ann", 0.9, box, [(0, 4, box)]), ("Ann", 0.1, box, [])])], f"doc_id long, page int, lines {recognition.LINES}")
    assert [len(r["boxes"]) for r in recognition.located(values, read).collect()] == [1]


def test_stream(spark, tmp_path):
    from veilspark.streaming import pages as stream

    spark.createDataFrame([(1, 1, "a@b.example"), (2, 1, "none")], stream.PAGES).write.parquet(f"{tmp_path}/in")
    book = R.RuleBook((R.Rule("category", None, False, "emailAddresses", 1),))
    query = stream.redact_stream(stream.page_stream(spark, f"{tmp_path}/in"), book, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    assert {r["doc_id"]: r["status"] for r in copies.visible(spark, f"{tmp_path}/out/copies").collect()} == {1: "redacted", 2: "no_matches"}
    spark.createDataFrame([(1, 2, "c@d.example"), (2, 1, "now e@f.example"), (3, 1, "g@h.example left")], stream.PAGES).write.mode("append").parquet(f"{tmp_path}/in")
    left = lambda p: p.filter("doc_id = 3").selectExpr("doc_id", "page", "'g@h.example' value")
    query = stream.redact_stream(stream.page_stream(spark, f"{tmp_path}/in"), book, f"{tmp_path}/out", f"{tmp_path}/check", inspector=left, max_passes=1)
    query.awaitTermination(120)
    assert {(r["doc_id"], r["page"]): r["status"] for r in copies.visible(spark, f"{tmp_path}/out/copies").collect()} == {(1, 1): "redacted", (1, 2): "redacted", (2, 1): "redacted"}
    assert [r["doc_id"] for r in copies.visible(spark, f"{tmp_path}/out/parked").collect()] == [3]


def test_benchmark_literals_of_a_large_table(spark, tmp_path):
    rows = [(i, f"item number {i} of many.") for i in range(4100)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, rows[i][1], "en", "s", 1) for i in (0, 1999, 2000, 4099)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["rule_line"]: r["n_spans"] for r in book_queries.benchmark_literals(spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1999: 1, 2000: 1, 4099: 1}


def book_of(*lines):
    return R.RuleBook(tuple(R.Rule("category", None, False, x, i + 1) if x in R.CATEGORIES else R.Rule("exact", x, False, None, i + 1) for i, x in enumerate(lines)))


def placed(spark, category, *texts):
    found = S.spans(pages(spark, *texts), book_of(category)).orderBy("doc_id", "start").collect()
    return [[texts[r["doc_id"] - 1][r["start"] : r["stop"]] for r in found if r["doc_id"] == i + 1] for i in range(len(texts))]


def test_values_are_placed_behind_their_labels(spark):
    """A value that also stands in its label is found where it is the value."""
    texts = ("x DB_PASSWORD=DB_PASSWORD y", "password hunter22 was `hunter22` then", "token: token_token_12345 end", "a://user:user@host", "see https://u:p@ss@host/x@y")
    rows = S.spans(pages(spark, *texts), book_of("secrets")).collect()
    assert all(texts[r["doc_id"] - 1][r["start"] : r["stop"]] == r["matched_text"] for r in rows)
    assert (1, texts[0].rindex("DB_"), texts[0].rindex("DB_") + 11) in {(r["doc_id"], r["start"], r["stop"]) for r in rows}
    assert (2, texts[1].index("`") + 1, texts[1].rindex("`")) in {(r["doc_id"], r["start"], r["stop"]) for r in rows}
    assert redaction.located_elsewhere(S.spans(pages(spark, *texts), book_of("secrets")), pages(spark, *texts)).count() == 0
    assert (5, 12, 18) in {(r["doc_id"], r["start"], r["stop"]) for r in rows}  # the password runs to the last at-sign of its part
    masked = {r["doc_id"]: r["text"] for r in redaction.redact(pages(spark, *texts), book_of("secrets")).pages.collect()}
    assert masked[1] == "x DB_PASSWORD=" + "█" * 11 + " y" and "`hunter22`" not in masked[2]


def test_every_labelled_pattern_places_its_value(spark):
    labelled = {
        "phoneNumbers": "tel 555-0147 x5", "accountNumbers": "account 1234567, swift code ABCDEFGH", "creditCardNumbers": "cvv 123, exp 04/28 and valid thru 05/29", "datesOfBirth": "born on 3 May 1980, dob 1980-05-03",
        "employerIdentificationNumbers": "EIN 123456789; VAT DE 123 456 789", "passportNumbers": "passport no. X1234567", "driversLicenseNumbers": "license number D1234567", "healthInformation": "MRN 12345-A, dx: J45 (ICD-10: J45.2)",
        "employeeIdentifiers": "Employee ID: E-12345", "secrets": "api key = abcdefgh12345678",
    }
    for category, text in labelled.items():
        found = placed(spark, category, text)[0]
        assert found and all(x in text for x in found), category
        rows = S.spans(pages(spark, text), book_of(category)).collect()
        assert all(text[r["start"] : r["stop"]] == r["matched_text"] for r in rows), category


def test_case_is_folded_alike_by_few_and_many(spark):
    words = ["straße", "İx", "ſea", "Kelvin", "ΟΔΟΣ", "éa"]
    docs = pages(spark, "STRAßE straSSe ix İX sea ſEA SEA Kelvin kelvin οδος οδοσ ΟΔΟΣΑ ÉA", "")
    few = R.RuleBook(tuple(R.Rule("exact", w, False, None, i + 1) for i, w in enumerate(words)))
    many = R.RuleBook(few.rules + tuple(R.Rule("exact", f"nothing{i}", False, None, 100 + i) for i in range(80)))
    got = [sorted(map(tuple, S.spans(docs, b).select("rule_line", "start", "stop", "matched_text").collect())) for b in (few, many)]
    assert got[0] == got[1] and len(got[0]) > 10


def test_many_hits_on_a_page(spark):
    found = S.spans(pages(spark, "1.2.3.4 " * 3000), book_of("ipAddresses")).agg(F.min("start"), F.max("stop"), F.count("*"), F.sum("start")).first()
    assert tuple(found) == (0, 3000 * 8 - 1, 3000, 8 * 3000 * 2999 // 2)


def test_block_characters_of_the_original_are_no_excuse(spark):
    docs = pages(spark, "key `██ab12`, ok", "password `██`!")
    out = redaction.redact(docs, book_of("██ab12"))
    assert {r["doc_id"]: r["text"] for r in out.pages.collect()}[1] == "key `" + "█" * 6 + "`, ok"
    assert {r["disposition"] for r in out.documents.collect()} == {"written", "nothing_matched"}


def test_plan_then_go(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "Ann Lee met Bo. ann lee left."), ("a", 2, "Nothing of Ann"), ("b", 1, "Ann Lee is here too")], "doc_id string, page int, text string")
    items = spark.createDataFrame([("a", 0, True, "Ann Lee", "", 1), ("a", 1, False, "Bo.", "", 1), ("a", 2, True, "x", "", 1)], "source_name string, pos int, is_selected boolean, value string, label string, page int")
    out = redaction.redact_plan(docs, items)
    texts = {(r["doc_id"], r["page"]): r["text"] for r in out.pages.collect()}
    assert texts == {("a", 1): "███████ met Bo. ███████ left.", ("a", 2): "Nothing of Ann", ("b", 1): "Ann Lee is here too"}
    assert out.problems.count() == 1 and plan.counts(items).first()["n_ticked"] == 2
    with pytest.raises(plan.EmptyPlan):
        redaction.redact_plan(docs, items.filter("not is_selected"))
    final = redaction.committed(redaction.redact(docs, book_of("Bo.")), f"{tmp_path}/staged", f"{tmp_path}/final/one")
    assert spark.read.parquet(final).count() == 3 and sources.withdrawn(spark, final) and not sources.withdrawn(spark, final)
    with pytest.raises(redaction.NothingMatched):
        redaction.committed(redaction.redact(docs, book_of("zzz")), f"{tmp_path}/staged", f"{tmp_path}/none")
    bad = redaction.redact(docs, book_of("e"), max_passes=1, inspector=lambda p: p.selectExpr("doc_id", "page", "'e' value"))
    assert redaction.committed(bad, f"{tmp_path}/staged2", f"{tmp_path}/none2") is None
    assert redaction.committed(bad, f"{tmp_path}/staged3", f"{tmp_path}/held", hold=True) is not None


def test_inspector_annotations_and_wrong_ranges(spark):
    note = [("Bo Li", "see Ann Lee"), (None, "fine")]
    docs = spark.createDataFrame([(1, 1, "Ann Lee and Lee and Max", note), (2, 1, "none", [])], "doc_id long, page int, text string, annotations array<struct<value string, contents string>>")
    seen = lambda p: p.selectExpr("doc_id", "page", "explode(array('Lee', 'Max')) value").filter("doc_id = 1")
    meant = book_of("Ann Lee")
    out = redaction.redact(docs, meant, inspector=seen)
    text = {r["doc_id"]: r["text"] for r in out.pages.collect()}[1]
    assert text == "███████ and ███ and Max"  # what is not near to anything meant stays
    assert [r["value"] for r in out.annotations.collect()] == ["see Ann Lee"]
    assert "inspector" in {r["origin"] for r in out.findings.collect()} and {r["passes"] for r in out.pages.collect()} == {0, 2}
    extra = spark.createDataFrame([(1, 1, 0, 3, "Ann"), (1, 1, 4, 7, "Bob")], "doc_id long, page int, start int, stop int, matched_text string")
    held = redaction.redact(docs, extra=extra)
    assert {r["doc_id"]: r["text"] for r in held.pages.collect()}[1].startswith("███ Lee") and held.problems.count() == 1
    state = redaction.flags(held.documents).first()
    assert state["any_failed"] and not state["all_settled"]
    with pytest.raises(ValueError):
        redaction.redact(docs)


def test_proposals_end_to_end(spark):
    docs = pages(spark, "Ask Orlaith Vance, account 12345678.\nShe knows.", "x" * 3000, "")

    def propose(text):
        if "xxx" in text:
            raise proposals.TooLong
        return [("Name: Orlaith Vance", "name", ""), ("12345678", "account number", ""), ("Nobody Known", "name", "")] if text else []

    rules = S.spans(docs, book_of("accountNumbers"))
    extra, unlocated, unread = proposals.spans_of_proposals(docs, propose, rules)
    assert [(r["start"], r["stop"], r["matched_text"]) for r in extra.collect()] == [(4, 17, "Orlaith Vance")]
    assert [r["text"] for r in unlocated.collect()] == ["Nobody Known"]
    assert [(r["doc_id"], r["n_unread"]) for r in unread.collect()] == [(2, 3000)]
    out = redaction.redact(docs, book_of("accountNumbers"), extra=extra)
    assert {r["doc_id"]: r["text"] for r in out.pages.collect()}[1] == "Ask █████████████, account ████████. She knows."
    titles = {r["title"] for r in reports.gaps(out.pages, book_of("accountNumbers"), too_long=unread, read_back_failed=unread).collect()}
    assert {"Not shown to the model", "Not read back", "Pages not examined"} <= titles


def test_readers_of_rules_and_pages(spark, tmp_path):
    assert plan.read_guidance(spark, f"{tmp_path}/absent.txt").first()["guidance"] == ""
    (tmp_path / "g.txt").write_text("# Notes\n- keep dates\n")
    assert plan.read_guidance(spark, f"{tmp_path}/g.txt").first()["guidance"] == "Notes\nkeep dates"
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_text("text")
    assert [r["path"].endswith("a.PDF") for r in sources.binary_files(spark, str(tmp_path)).collect()] == [True]
    assert {r["status"] for r in sources.readable(pages(spark, "x", " ", None)).collect()} == {"ok", "no_text"}
    old, new = pages(spark, "a", "b"), spark.createDataFrame([(2, "c")], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in sources.replaced(old, new).collect()} == {(1, "a"), (2, "c")}


def test_table_columns_of_several_categories(spark):
    text = "| Account | DOB | Staff no. | Note |\n|---|---|---|---|\n| 123-456-789 | 1990-01-02 | E-1234 | Account 5551234 |\n"
    found = S.spans(pages(spark, text), book_of("accountNumbers", "datesOfBirth", "employeeIdentifiers")).collect()
    assert sorted((r["rule_line"], r["matched_text"]) for r in found) == [(1, "123-456-789"), (1, "5551234"), (2, "1990-01-02"), (3, "E-1234")]


def test_spans_of_a_stream(spark, tmp_path):
    from veilspark.streaming.pages import page_stream, span_stream

    docs = spark.createDataFrame([(1, 1, "at 10.0.0.1 and a@b.example"), (2, 1, None), (3, 2, "10.0.0.2"), (4, 1, "| Account |\n|---|\n| 123-456-789 |")], "doc_id long, page int, text string")
    docs.write.parquet(f"{tmp_path}/in")
    book = book_of("ipAddresses", "emailAddresses", "accountNumbers")
    query = span_stream(page_stream(spark, f"{tmp_path}/in"), book).writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    columns = ["doc_id", "page", "start", "stop", "matched_text"]
    assert sorted(map(tuple, spark.table("streamed").select(columns).collect())) == sorted(map(tuple, S.spans(docs, book).select(columns).collect()))
