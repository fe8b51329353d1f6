"""Plans: what would be removed, as a table that a person edits and the next scan respects.

A plan item is (source_name, pos, is_selected, value, label, page). Its text form is Markdown with one ticked or
unticked line for each item under a heading for its page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Limits and the text form.
LEAST_VALUE = 3
GUIDANCE_BUDGET = 3000
BY_HAND = "Added by hand"
ITEM = r"^[-*] \[([ xX])\] (.*)$"


class EmptyPlan(ValueError):
    """A plan without a ticked value must not run."""


def parse(texts: DataFrame) -> DataFrame:
    """Plan items from (source_name, body); lines that are no items are ignored."""
    body = F.regexp_replace(F.regexp_replace("body", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    lines = texts.select("source_name", F.posexplode(F.split(body, "\n")).alias("pos", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    # A page heading sets the page (0: cleared) for the lines below it.
    number = F.expr("try_cast(regexp_extract(line, '^## Page +([0-9]{1,9})$', 1) as int)")
    heading = F.when(F.startswith("line", F.lit("## ")), F.coalesce(number, F.lit(0)))
    carried = F.last(heading, ignorenulls=True).over(Window.partitionBy("source_name").orderBy("pos"))
    items = lines.withColumn("page", F.nullif(carried, F.lit(0))).filter(F.rlike("line", F.lit(ITEM)))
    rest = F.trim(F.regexp_extract("line", ITEM, 2))
    ticked = F.regexp_extract("line", ITEM, 1) != " "
    coded = F.startswith("rest", F.lit("`")) & (F.length(F.regexp_replace("rest", "[^`]", "")) >= 2)
    value = F.when(coded, F.regexp_extract("rest", r"^`(.*)`", 1)).otherwise(F.trim(F.regexp_extract("rest", r"^(.*?)(?: — | - | – |$)", 1)))
    tail = F.when(coded, F.regexp_extract("rest", r"^`.*`(.*)$", 1)).otherwise(F.expr("substring(rest, length(regexp_extract(rest, '^(.*?)(?: — | - | – |$)', 1)) + 1)"))
    label = F.trim(F.regexp_replace(tail, r"^ *[—–-] *", ""))
    parsed = items.select("source_name", "pos", ticked.alias("is_selected"), rest.alias("rest"), "page").select("source_name", "pos", "is_selected", value.alias("value"), label.alias("label"), "page")
    return parsed.filter(F.col("value") != "")


def written(items: DataFrame) -> DataFrame:
    """(source_name, body): the Markdown of each document's items, pages in order, items without a page last."""
    line = F.concat(F.when(F.col("is_selected"), "- [x] `").otherwise("- [ ] `"), F.regexp_replace("value", r"\s+", " "), F.lit("`"), F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" — "), "label")).otherwise(""))
    by_page = items.groupBy("source_name", "page").agg(
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"), F.count(F.lit(1)).alias("n"), F.count_if("is_selected").alias("ticked")
    )
    heading = F.coalesce(F.concat(F.lit("## Page "), F.col("page").cast("string")), F.lit(f"## {BY_HAND}"))
    section = F.concat(heading, F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    order = F.coalesce("page", F.lit((1 << 31) - 1))
    whole = by_page.groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("s")))).alias("sections"), F.sum("n").alias("n"), F.sum("ticked").alias("ticked"))
    head = F.concat(F.lit("# Redaction plan: "), "source_name", F.lit("\n\n"), F.col("ticked").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" items are ticked and will be removed.\n\n"))
    return whole.select("source_name", F.concat(head, F.array_join(F.transform("sections", lambda s: s["s"]), "\n")).alias("body"))


def proposed(found: DataFrame, source_name: str = "doc_id") -> DataFrame:
    """A fresh plan from spans: each value of a document once, where it is first seen, ticked."""
    first = Window.partitionBy("doc_id", "matched_text").orderBy("page", "rule_line", "start")
    once = found.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "start", "rule_line")) - 1
    return once.select(F.col(source_name).cast("string").alias("source_name"), pos.alias("pos"), F.lit(True).alias("is_selected"), F.col("matched_text").alias("value"), F.col("rule_description").alias("label"), F.col("page").cast("int").alias("page"))


def merged(fresh: DataFrame, edited: DataFrame) -> DataFrame:
    """The fresh plan with a reviewer's decisions: by value the last edited line wins; lines only they have stay."""
    key = ["source_name", "value"]
    last = edited.groupBy(*key).agg(F.max_by("is_selected", "pos").alias("decided"))
    kept = fresh.join(last, key, "left").withColumn("is_selected", F.coalesce("decided", "is_selected")).drop("decided")
    size = fresh.groupBy("source_name").agg((F.max("pos") + 1).alias("base"))
    extra = edited.join(fresh.select(*key).distinct(), key, "left_anti").join(size, "source_name", "left").withColumn("pos", F.col("pos") + F.coalesce("base", F.lit(0))).drop("base")
    columns = ["source_name", "pos", "is_selected", "value", "label", "page"]
    return kept.select(columns).unionByName(extra.select(columns))


def counts(items: DataFrame) -> DataFrame:
    """(source_name, n_items, n_ticked), as a plan that was edited outside is read again."""
    return items.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("is_selected").alias("n_ticked"))


def read_guidance(spark: SparkSession, path: str) -> DataFrame:
    """guidance() of a text file of rules for all documents; an absent file is an empty guidance."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    body = spark.read.text(path, wholetext=True).select(F.lit(path).alias("rules_id"), F.col("value").alias("body")) if there else spark.createDataFrame([(path, "")], "rules_id string, body string")
    return guidance(body)


def usable_values(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(used, refused): ticked distinct values; those under three characters or without letter or number are refused."""
    blank = F.regexp_replace("value", r"(?U)\s+", "") == ""
    ticked = items.filter(F.col("is_selected") & ~blank)
    first = ticked.groupBy("source_name", "value").agg(F.min("pos").alias("pos"))
    fine = (F.length(F.trim("value")) >= LEAST_VALUE) & F.rlike("value", F.lit(r"[\p{L}\p{N}]"))
    return first.filter(fine), first.filter(~fine)


def guidance(texts: DataFrame) -> DataFrame:
    """(rules_id, guidance, omitted_character_count) from (rules_id, body): notes without markup, within a budget.

    Whole lines are kept from the start while they fit; the first that does not fit ends it.
    """
    lines = texts.select("rules_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("body", F.lit("")), r"\r\n?", "\n"), "\n")).alias("pos", "raw"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^#+\s*", ""), r"^[-*+]\s+", ""), r"^>\s?", ""))
    lines = lines.withColumn("line", bare).filter("line <> ''")
    run = Window.partitionBy("rules_id").orderBy("pos")
    lines = lines.withColumn("total", F.sum(F.length("line") + 1).over(run))
    fits = F.col("total") <= GUIDANCE_BUDGET
    summed = lines.groupBy("rules_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("guidance"),
        F.coalesce(F.sum(F.when(~fits, F.length("line") + 1)), F.lit(0)).alias("omitted_character_count"),
    )
    empty = texts.select("rules_id").distinct().join(summed, "rules_id", "left")
    return empty.select("rules_id", F.coalesce("guidance", F.lit("")).alias("guidance"), F.coalesce("omitted_character_count", F.lit(0)).cast("long").alias("omitted_character_count"))
