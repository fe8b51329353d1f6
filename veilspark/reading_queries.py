"""Queries over pages as a recogniser reads them, made from the documents, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import location

#: Characters that one token of these pages covers.
STEP = 8


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def _seen(box: Column, turned: Column) -> Column:
    """A box of a page, in fractions of it, on the image of the page that is turned clockwise."""
    x, y, w, h = (box[n] for n in "xywh")
    return F.when(turned == 90, _box(y, 1 - x - w, h, w)).when(turned == 180, _box(1 - x - w, 1 - y - h, w, h)).when(turned == 270, _box(1 - y - h, x, h, w)).otherwise(box)


def read_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values to look for, and recognised lines with boxes as fractions of an image: each document's own lines, then four in one of six forms of misreading."""
    form, number = F.col("doc_id") % 6, F.lpad(F.col("doc_id").cast("string"), 9, "0")
    name = F.concat(F.lit("Customer#"), number)

    def by_form(*texts: Column) -> Column:
        chosen = F.when(form == 0, texts[0])
        for i, text in enumerate(texts[1:], 1):
            chosen = chosen.when(form == i, text)
        return chosen

    value = by_form(
        F.upper(name), name, F.concat(F.lit("Customer#"), F.lpad((F.col("doc_id") + 1).cast("string"), 9, "0")), F.concat(F.lit("Customer No "), number, F.lit(" Ltd")),
        F.concat(F.lit(" customer   no "), number), name,
    )
    first = by_form(
        F.concat(F.lit("Paid by "), name, F.lit(" today")), F.concat(F.lit("Paid by Cust0mcr#"), number), F.concat(F.lit("Paid by "), name), F.lit("Paid by Custom3r No"),
        F.concat(F.lit("Re Customer No "), number, F.lit(" etc")), F.concat(F.lit("Paid by Customer#"), F.replace(number, F.lit("0"), F.lit("O"))),
    )
    second = F.when(form == 3, F.concat(number, F.lit(" Ltd in full"))).otherwise("Thank you")
    own = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.lit(1).alias("page"), value.alias("value"), (90 * (F.col("doc_id") % 4)).cast("int").alias("turned"), F.size(own).alias("n_own"),
        F.concat(own, F.array(F.lit("Statement of account"), first, second, value)).alias("texts"),
    )
    each = pages.select("doc_id", "page", "turned", "n_own", F.posexplode("texts").alias("n", "text")).withColumn("line", F.col("n").cast("long"))
    made = F.col("line") >= F.col("n_own")
    top = F.when(made, 1 - (F.col("line") - F.col("n_own") + 1) / 8).otherwise(0.0)

    def token(j: Column) -> Column:
        return F.struct((j * STEP).cast("int").alias("start"), (j * STEP + STEP).cast("int").alias("stop"), _seen(_box(F.lit(0.125) + j / 64, top, F.lit(1 / 64), F.lit(1 / 16)), F.col("turned")).alias("box"))

    tokens = F.when(made, F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / STEP).cast("int")), token))
    whole = _seen(_box(F.lit(0.125), top, F.lit(0.75), F.lit(1 / 16)), F.col("turned"))
    sure = F.when(F.col("line") == F.col("n_own") + 3, 0.2).otherwise(0.9).cast("float")
    paper = _box(F.lit(0), F.lit(0), F.lit(512), F.lit(1024))
    lines = each.select("doc_id", "page", "line", "text", sure.alias("confidence"), whole.alias("box"), tokens.alias("tokens"), paper.alias("page_box"), "turned")
    return pages.select("doc_id", "page", "value"), lines


def misread_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's customer stands on its page, read from an image turned by a quarter or more: exactly, in a line with other blanks, over
    two lines with a misread word, or with misread characters; a number with another digit is another customer, and a line that is unsure counts for nothing."""
    values, lines = read_documents(spark, sf_dir)
    found = location.located(values, location.scaled(lines))
    return found.select("doc_id", "rung", F.col("line").cast("int").alias("line"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "box.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"misread_boxes": misread_boxes}

ORACLES: dict[str, str] = {
    "misread_boxes": """
      WITH o AS (SELECT doc_id AS k, doc_id % 6 AS g, lpad(doc_id::VARCHAR, 9, '0') AS d, coalesce(len(string_split(text, chr(10))), 0)::INT AS own FROM documents),
        h AS (SELECT k, own, 'exact' AS rung, 1 AS i, 8 AS start, 26 AS stop FROM o WHERE g = 0
          UNION ALL SELECT k, own, 'approximate', 1, 7, 26 FROM o WHERE g = 1 OR g = 5 AND length(d) - length(replace(d, '0', '')) BETWEEN 1 AND 6
          UNION ALL SELECT k, own, 'exact', 1, 8, 26 FROM o WHERE g = 5 AND NOT contains(d, '0')
          UNION ALL SELECT k, own, 'across', 1, 8, 19 FROM o WHERE g = 3 UNION ALL SELECT k, own, 'across', 2, 0, 13 FROM o WHERE g = 3
          UNION ALL SELECT k, own, 'line', 1, NULL, NULL FROM o WHERE g = 4)
      SELECT k AS doc_id, rung, own + i AS line, start, stop, coalesce(64 + 8 * (start // 8), 64)::DOUBLE AS x, (1024 - 128 * (i + 1))::DOUBLE AS y, coalesce(8 * ((stop - 1) // 8 - start // 8 + 1), 384)::DOUBLE AS w, 64::DOUBLE AS h FROM h""",
}
