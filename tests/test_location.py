"""Location by joins against the scan of one page in plain Python, and boxes in the space of turned pages."""

import random

from pyspark.sql import functions as F

from veilspark.operators import location, recognition

WORDS = ["harbour", "Vela", "7741", "Moss", "k4", "Bergland", "0912-55", "ORD", "quay", "teller", "İz", "straße", "note", "a"]


def _page(rng, k):
    lines = []
    for _ in range(rng.randint(0, 6)):
        text = rng.choice((" ", " ", "  ")).join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))
        tokens, at = [], 0
        for word in text.split():
            at = text.index(word, at)
            if rng.random() < 0.9:
                tokens.append((at, at + len(word), (10.0 * at, 0.0, 10.0 * len(word), 8.0)))
            at += len(word)
        lines.append((text, rng.choice((0.9, 0.9, 0.9, 0.4, 0.2)), (0.0, 0.0, 1000.0, 9.0), tokens))
    return lines


def _misread(rng, text):
    swap = {"o": "0", "l": "1", "e": "c", "7": "T", "1": "l", "a": "o", "g": "9", "0": "O", "5": "6"}
    return "".join(swap.get(c, c) if rng.random() < 0.25 else c for c in text)


def test_located_against_one_page_in_python(spark):
    rng = random.Random(11)
    pages, values = [], []
    for doc in range(400):
        lines = _page(rng, doc)
        pages.append((doc, 1, lines))
        stream = " ".join(t for t, c, *_ in lines if c >= 0.4).split()
        for _ in range(4):
            a = rng.randint(0, max(0, len(stream) - 1))
            value = " ".join(stream[a : a + rng.randint(1, 5)])
            values.append((doc, 1, rng.choice((value, value.upper(), _misread(rng, value), " " + value + " ", value[1:]))))
        values.extend(((doc, 1, None), (doc, 1, "  "), (doc, 1, "nothing like it"), (None, 1, "a"), (doc, 2, "note")))
    read = spark.createDataFrame(pages, f"doc_id long, page int, lines {recognition.LINES}").withColumn("value", F.lit("clash"))
    asked = spark.createDataFrame(values, "doc_id long, page int, value string").withColumn("line", F.lit(1))
    got, rungs = {}, {}
    found = [tuple(sorted(location.located(asked, location.line_rows(read), few=few).collect(), key=repr)) for few in (location.FEW, 0, 6)]
    assert found[0] == found[1] == found[2]
    for r in found[0]:
        got.setdefault((r["doc_id"], r["value"]), []).append(tuple(r["box"]))
        rungs[r["rung"]] = rungs.get(r["rung"], 0) + 1
    by_doc, want = {d: [recognition.Line(t, b, tuple(k)) for t, c, b, k in ls if t and c >= 0.4] for d, _, ls in pages}, {}
    for doc, page, value in values:
        found = recognition.boxes(value, by_doc[doc]) if value and doc is not None and page == 1 else []
        if found:
            want[doc, value] = sorted(found)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert min(rungs[k] for k in ("exact", "line", "across", "approximate")) >= 5, rungs


def test_location_of_nothing_and_of_long_lines(spark):
    schema = f"doc_id long, page int, lines {recognition.LINES}"
    box = (0.0, 0.0, 9.0, 1.0)
    empty, text = spark.createDataFrame([], schema), "x1 " * 20_000 + "Kadlec-8810"
    long = spark.createDataFrame([(1, 1, [(text, 0.9, box, None)]), (2, 1, [("Marsh", 0.9, box, []), (None, 0.9, box, []), ("", 0.9, box, []), ("Pell", 0.9, box, [])]), (3, 1, [("Marsh", 0.9, box, []), (" ", 0.9, box, []), ("Pell", 0.9, box, [])])], schema)
    asked = spark.createDataFrame([(1, 1, "Kad1ec-881O"), (1, 1, "Kadlec-8811"), (2, 1, "Marsh Pell"), (3, 1, "Marsh Pell")], "doc_id long, page int, value string")
    assert location.located(asked, location.line_rows(empty)).count() == 0
    for few in (location.FEW, 0):
        got = {(r["doc_id"], r["value"], r["rung"], r["line"], r["start"], r["stop"]) for r in location.located(asked, location.line_rows(long), few=few).collect()}
        assert got == {(1, "Kad1ec-881O", "approximate", 0, len(text) - 12, len(text)), (2, "Marsh Pell", "across", 0, 0, 5), (2, "Marsh Pell", "across", 3, 0, 4)}


def test_more_lines_than_a_block(spark):
    """A page of three blocks of lines: words are numbered over blocks, and a value may end in the next one."""
    n = 3 * location.BLOCK
    every = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("line"), F.concat(F.lit("row"), F.col("id"), F.lit(" end"), F.col("id")).alias("text"), F.lit(0.9).alias("confidence"), F.expr("named_struct('x', 0D, 'y', double(id), 'w', 5D, 'h', 1D)").alias("box"), F.expr("cast(null as array<struct<start:int,stop:int,box:struct<x:double,y:double,w:double,h:double>>>)").alias("tokens"))
    asked = every.filter("line > 0 and line % 64 = 0").select("doc_id", "page", F.concat(F.lit("end"), F.col("line") - 1, F.lit(" row"), F.col("line")).alias("value"))
    got = sorted((r["line"], r["rung"], r["box"]["y"]) for r in location.located(asked, every).collect())
    assert got == sorted((i + d, "across", float(i + d)) for i in range(64, n, 64) for d in (-1, 0))


def test_boxes_of_turned_pages(spark):
    """A box on the page, seen on the page's turned image, is read back as it was."""
    rows, want = [], {}
    page = (10.0, 20.0, 200.0, 400.0)
    for k, turned in enumerate((None, 0, 90, 180, 270, -90, 450, 45)):
        u, v, w, h = 0.1, 0.2, 0.3, 0.05
        seen = (u, v, w, h)
        for _ in range(((turned or 0) % 360) // 90):
            seen = (seen[1], 1 - seen[0] - seen[2], seen[3], seen[2])
        rows.append((k, 1, 0, seen, [(0, 3, seen)], page, turned))
        want[k] = None if turned == 45 else (10 + 200 * u, 20 + 400 * v, 200 * w, 400 * h)
    box = location.BOX
    df = spark.createDataFrame(rows, f"doc_id long, page int, line long, box {box}, tokens array<struct<start:int,stop:int,box:{box}>>, page_box {box}, turned int")
    for r in location.scaled(df.drop("page_box", "turned"), df).collect():
        for got in (r["box"], r["tokens"][0]["box"]):
            assert (got is None) == (want[r["doc_id"]] is None) and (got is None or all(abs(a - b) < 1e-9 for a, b in zip(got, want[r["doc_id"]], strict=True)))
