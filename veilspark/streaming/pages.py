"""Matchers hold no state, so the same plan runs over a stream; each micro-batch is staged, verified and appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.spans import spans
from veilspark.plans.redaction import redact
from veilspark.sources import copies
from veilspark.sources.rules import RuleBook
from veilspark.sources.tables import Store, published, withdrawn

PAGES = "doc_id long, page int, text string"


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of pages as they arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def span_stream(pages: DataFrame, book: RuleBook) -> DataFrame:
    """Spans of arriving pages: one projection, table columns included."""
    return spans(pages, book)


def redact_stream(pages: DataFrame, book: RuleBook, out: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Redact each micro-batch with read-back. Pages of documents that verify are published as copies, the others are parked for review.

    Copies are replaced page by page, so a batch that runs again replaces its own output, and a page that arrives again
    that of the earlier one, wherever it was put. options: those of redact().
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        result = redact(df, book, **options)
        state = result.documents.select("doc_id", (F.col("n_problems") > 0).alias("parked"))
        pages = Store(spark).kept(result.pages.join(state, "doc_id"), "batch")
        for name, rows in (("copies", pages.filter("not parked")), ("parked", pages.filter("parked"))):
            run = copies.staged(rows.drop("parked"), f"{out}/{name}", ("doc_id", "page"))
            copies.published(spark, run, verified=name == "copies", hold=name == "parked")
        final = f"{out}/documents/batch={number}"
        withdrawn(spark, final)
        published(result.documents, f"{out}/_staging/documents-{number}-{uuid.uuid4().hex}", final, verified=True)

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
