"""State of documents whose pages arrive apart, against the batch query."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators import spans as S
from veilspark.plans import plan
from veilspark.sources import rules as R
from veilspark.streaming import pages as stream
from veilspark.streaming import state

BOOK = R.RuleBook((R.Rule("category", None, False, "ipAddresses", 1), R.Rule("exact", "x", False, None, 2)))
FIRST = [(1, 2, "10.0.0.2 and 10.0.0.1"), (2, 1, "none"), (3, 1, "10.9.9.9"), (4, 1, "x " * 41 + "10.0.0.4")]
SECOND = [(1, 1, "10.0.0.1 then 10.0.0.3 then 10.0.0.3"), (2, 2, "10.0.0.7"), (3, 2, "10.9.9.9 x"), (5, 1, None)]


@pytest.fixture
def stored_state(spark):
    before = spark.conf.get(state.PROVIDER[0], None)
    spark.conf.set(*state.PROVIDER)
    yield
    spark.conf.unset(state.PROVIDER[0]) if before is None else spark.conf.set(state.PROVIDER[0], before)


def test_documents_over_batches(spark, tmp_path, stored_state):
    for k, rows in enumerate((FIRST, SECOND)):
        spark.createDataFrame(rows, stream.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = state.document_stream(stream.page_stream(spark, f"{tmp_path}/in"), BOOK).withColumn("batch", F.lit(k)).writeStream.outputMode("update").foreachBatch(
            lambda df, n, k=k: df.write.mode("append").parquet(f"{tmp_path}/out")
        ).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    docs = spark.createDataFrame(FIRST + SECOND, stream.PAGES)
    kept, away = S.refused(S.spans(docs, BOOK))
    want = {(r["source_name"], r["value"]): (r["page"], r["label"]) for r in plan.proposed(kept).collect()}
    last = {}
    for r in sorted(got, key=lambda r: r["batch"]):
        if r["kind"] == "value":
            last[str(r["doc_id"]), r["value"]] = (r["page"], r["label"])
    assert last == want
    totals = {}
    for r in sorted(got, key=lambda r: r["batch"]):
        if r["kind"] == "total":
            totals[r["doc_id"]] = (r["n_items"], r["n_values"], r["n_refused"])
    items = {r["doc_id"]: (r["n"], r["v"]) for r in kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("matched_text").alias("v")).collect()}
    assert totals == {d: (*items.get(d, (0, 0)), sum(a["doc_id"] == d for a in away.collect())) for d in {1, 2, 3, 4}}
    batch = state.page_findings(docs, BOOK)
    assert batch.filter("refused").count() == away.count() and batch.filter("not refused").count() == kept.count()


def test_a_silent_document_is_closed(spark, tmp_path, stored_state):
    spark.createDataFrame(FIRST[:1], stream.PAGES).write.parquet(f"{tmp_path}/in")
    query = state.document_stream(stream.page_stream(spark, f"{tmp_path}/in"), BOOK, idle_ms=1).writeStream.outputMode("update").foreachBatch(
        lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")
    ).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            try:
                if spark.read.parquet(f"{tmp_path}/out").filter("kind = 'closed'").count():
                    break
            except Exception:  # noqa: BLE001  nothing is written yet
                continue
    finally:
        query.stop()
    closed = spark.read.parquet(f"{tmp_path}/out").filter("kind = 'closed'").collect()
    assert [(r["doc_id"], r["n_items"], r["n_values"]) for r in closed] == [(1, 2, 2)]
