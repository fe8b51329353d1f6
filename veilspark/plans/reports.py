"""Reports over spans, plans and redactions, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import masked_line, masked_value, shown_line
from veilspark.operators.spans import unsupported, unused_rules
from veilspark.sources.rules import RuleBook


def preview(found: DataFrame, mask: bool = False) -> DataFrame:
    """Each span as a line of a page's report."""
    value = shown_line(F.col("matched_text"))
    return found.select("doc_id", "page", "start", "rule_description", (masked_line(value) if mask else value).alias("shown"))


def per_page(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_spans"), F.array_sort(F.collect_set("rule_description")).alias("rules"))


def summary(found: DataFrame, book: RuleBook) -> DataFrame:
    """Totals of a preview, with the rules that matched nothing."""
    unused = unused_rules(book, found).agg(F.array_sort(F.collect_list("rule_description")).alias("unused_rules"))
    totals = found.agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("rule_line").alias("n_rules"))
    return totals.crossJoin(unused)  # one row each


def findings(found: DataFrame, reveal: bool = False) -> DataFrame:
    """Findings with values masked; a literal rule names itself only when revealed."""
    value = F.col("matched_text") if reveal else masked_value(F.col("matched_text"))
    rule = F.col("rule_description") if reveal else F.when(F.startswith("rule_description", F.lit("“")), "exact rule").otherwise(F.col("rule_description"))
    return found.select("doc_id", "page", value.alias("value"), rule.alias("rule"))


def gaps(pages: DataFrame, book: RuleBook, problems: DataFrame | None = None, model_available: bool | None = None, omitted_characters: int = 0, too_long: DataFrame | None = None, read_back_failed: DataFrame | None = None) -> DataFrame:
    """(title, detail): everything that was not checked or was set aside. Nothing is skipped silently."""
    spark = pages.sparkSession
    out = pages.filter("status in ('not_examined', 'no_text')").groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("p"))
    out = out.select(F.lit("Pages not examined").alias("title"), F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(", pages "), F.array_join(F.transform("p", lambda x: x.cast("string")), ", ")).alias("detail"))
    fixed = [("Category without a detector", c) for c in unsupported(book)] + [("Rule set aside", f"line {line}: {text}") for _, line, text in book.problems]
    fixed += [("Model unavailable", "only rules were used")] if model_available is False else []
    fixed += [("Guidance omitted", f"{omitted_characters} characters over the budget")] if omitted_characters else []
    if fixed:
        out = out.unionByName(spark.createDataFrame(fixed, "title string, detail string"))
    if problems is not None:
        out = out.unionByName(problems.select(F.lit("Problem").alias("title"), F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(", page "), F.col("page").cast("string"), F.lit(": "), "problem").alias("detail")))
    where = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(", page "), F.col("page").cast("string"))
    for title, rows in (("Not shown to the model", too_long), ("Not read back", read_back_failed)):  # (doc_id, page)
        if rows is not None:
            out = out.unionByName(rows.select("doc_id", "page").distinct().select(F.lit(title).alias("title"), where.alias("detail")))
    return out


def page_rail(pages: DataFrame) -> DataFrame:
    """Each page's status, and the page worth seeing first: an unexamined one, else a redacted one, else the first."""
    order = F.when(F.col("status") == "not_examined", 0).when(F.col("status") == "redacted", 1).otherwise(2)
    first = pages.groupBy("doc_id").agg(F.min_by("page", F.struct(order, F.col("page"))).alias("first_page"))
    return pages.select("doc_id", "page", "status", "items").join(first, "doc_id")


def verdicts(documents: DataFrame) -> DataFrame:
    """One sentence a document."""
    count = F.concat(F.col("items").cast("string"), F.when(F.col("items") == 1, " item removed").otherwise(" items removed"))
    odd = F.when(F.size("unexamined_pages") > 0, F.concat(F.size("unexamined_pages").cast("string"), F.lit(" pages not examined")))
    checked = F.when(F.col("disposition") == "written_unverified", "not verified")
    text = F.when(F.col("disposition") == "nothing_matched", "nothing matched").when(F.col("disposition") == "failed", "not written: it did not verify").otherwise(F.concat_ws("; ", count, checked, odd))
    return documents.select("doc_id", "disposition", "is_settled", text.alias("verdict"))


def recent(runs: DataFrame, n: int = 4) -> DataFrame:
    """The newest runs first."""
    return runs.orderBy(F.col("finished_at").desc()).limit(n)


def rules_summary(book: RuleBook) -> str:
    exact, categories = len(book.exact), len(book.categories)
    return f"{exact} exact, {categories} categories, {len(book.problems)} lines set aside"
