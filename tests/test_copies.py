"""Copies: what is visible after verified, failed, held, repeated and competing runs."""

import os

import pytest
from pyspark.sql import functions as F

from veilspark.plans import redaction
from veilspark.sources import copies
from veilspark.sources import rules as R

MAIL = R.RuleBook((R.Rule("category", None, False, "emailAddresses", 1),))


def rows(df):
    return sorted((r["doc_id"], r["page"], r["text"]) for r in df.collect())


def docs(spark, texts):
    return spark.createDataFrame([(i, 1, t) for i, t in texts.items()], "doc_id long, page int, text string")


def test_only_verified_copies_are_visible(spark, tmp_path):
    root = f"file:{tmp_path}/copies"
    assert copies.visible(spark, root) is None
    first = docs(spark, {i: f"text {i}" for i in range(300)})
    run = copies.staged(first, root, buckets=8)
    assert copies.visible(spark, root) is None and rows(copies.stored_rows(spark, run)) == rows(first)
    assert copies.published(spark, run, verified=True) == 1 and rows(copies.visible(spark, root)) == rows(first)
    failed = copies.staged(docs(spark, {5: "not verified"}), root)
    assert copies.published(spark, failed, verified=False) is None and rows(copies.visible(spark, root)) == rows(first)
    assert not os.path.exists(f"{tmp_path}/copies/data/{failed.run}")
    held = copies.staged(docs(spark, {5: "held"}), root)
    assert copies.published(spark, held, verified=False, hold=True) == 2 and copies.version(root, 2)["held"]
    assert rows(copies.visible(spark, root, 1)) == rows(first) and (5, 1, "held") in rows(copies.visible(spark, root))
    through = spark.read.format(copies.FORMAT).load(root)
    assert rows(through) == rows(copies.visible(spark, root)) and through.select("doc_id").count() == 300


def test_replacement_touches_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "copies")
    copies.published(spark, copies.staged(docs(spark, {i: f"a{i}" for i in range(100)}), root, buckets=16), True)
    before = {x["bucket"]: x["file"] for x in copies.newest(root)[1]["files"]}
    run = copies.staged(docs(spark, {7: "b7", 1000: "new"}), root)
    assert 1 <= len(run.touched) <= 2 and copies.published(spark, run, True) == 2
    after = {x["bucket"]: x["file"] for x in copies.newest(root)[1]["files"]}
    assert {b for b in before if before[b] != after[b]} <= set(run.touched)
    got = {i: t for i, _, t in rows(copies.visible(spark, root))}
    assert len(got) == 101 and got[7] == "b7" and got[1000] == "new" and got[8] == "a8"
    again = copies.staged(docs(spark, {7: "b7", 1000: "new"}), root)
    copies.published(spark, again, True)
    assert rows(copies.visible(spark, root)) == rows(copies.visible(spark, root, 2))


def test_a_file_that_is_not_what_was_written(spark, tmp_path):
    root = str(tmp_path / "copies")
    copies.published(spark, copies.staged(docs(spark, {1: "one"}), root), True)
    run = copies.staged(docs(spark, {1: "two"}), root)
    import pyarrow as pa
    import pyarrow.parquet as pq

    where = f"{root}/{run.files[0]['file']}"
    table = pq.read_table(where)
    pq.write_table(table.set_column(table.schema.get_field_index("text"), "text", pa.array(["tw0"])), where)
    assert copies.published(spark, run, True) is None and rows(copies.visible(spark, root)) == [(1, 1, "one")]


def test_competing_runs(spark, tmp_path):
    root = str(tmp_path / "copies")
    copies.published(spark, copies.staged(docs(spark, {i: "a" for i in range(50)}), root, buckets=16), True)
    one, same = (copies.staged(docs(spark, {3: t}), root) for t in ("b", "c"))
    other = next(i for i in range(50) if i != 3 and not copies.staged(docs(spark, {i: "d"}), root).touched & one.touched)
    apart = copies.staged(docs(spark, {other: "d"}), root)
    assert copies.published(spark, one, True) == 2
    with pytest.raises(copies.Conflict):
        copies.published(spark, same, True)
    assert copies.published(spark, apart, True) == 3
    got = {i: t for i, _, t in rows(copies.visible(spark, root))}
    assert got[3] == "b" and got[other] == "d" and len(got) == 50
    assert copies.cleaned(root) > 0 and len(rows(copies.visible(spark, root))) == 50 and copies.cleaned(root) == 0


def test_failed_tasks_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "copies")
    bad = docs(spark, {i: f"t{i}" for i in range(40)}).withColumn("text", F.when(F.col("doc_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        copies.staged(bad, root)
    assert copies.visible(spark, root) is None


def test_source_and_empty_and_wide(spark, tmp_path):
    with pytest.raises(copies.SameAsSource):
        copies.staged(docs(spark, {1: "x"}), str(tmp_path / "a" / "copies"), source=str(tmp_path / "a"))
    root = str(tmp_path / "none")
    assert copies.published(spark, copies.staged(docs(spark, {}), root), True) == 1 and copies.visible(spark, root).count() == 0
    wide = docs(spark, {1: None}).withColumn("annotations", F.array(F.struct(F.lit("a").alias("value")))).withColumn("bucket", F.lit(3))
    root = str(tmp_path / "wide")
    assert copies.published(spark, copies.staged(wide, root), True) == 1 and copies.visible(spark, root).first()["annotations"][0]["value"] == "a"


def test_redaction_to_copies(spark, tmp_path):
    root = str(tmp_path / "copies")
    pages = docs(spark, {1: "a@b.example here", 2: "nothing"})
    assert redaction.copied(redaction.redact(pages, MAIL), root) == 1
    assert rows(copies.visible(spark, root)) == [(1, 1, "█" * 11 + " here"), (2, 1, "nothing")]
    bad = redaction.redact(docs(spark, {1: "a@b.example left"}), MAIL, max_passes=1, inspector=lambda p: p.selectExpr("doc_id", "page", "'a@b.example' value"))
    assert redaction.copied(bad, root) is None and len(rows(copies.visible(spark, root))) == 2
    with pytest.raises(redaction.NothingMatched):
        redaction.copied(redaction.redact(docs(spark, {9: "none"}), MAIL), root)
