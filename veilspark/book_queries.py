"""Queries over tables of rule books, plans and proposals made from the driver's tables, a user's matcher and annotations, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import proposals as P
from veilspark.operators import intervals, literals, proposals
from veilspark.operators import spans as S
from veilspark.operators.matchers import Matcher, Matchers
from veilspark.oracles import BOTH, DOCS, IP, THE, _norm, _occurrences, _places
from veilspark.plans import plan, redaction, reports
from veilspark.sources import copies
from veilspark.sources import rules as R
from veilspark.sources.tables import Store, conversations, dealt, documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- rule books as tables ---
def nation_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule book a nation, of eight lines that hang on its key."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    lines = (
        _text("# ", name), _text('"', name, '"'), _text('!"', F.lower(name), '"'), F.when(k % 3 == 0, "emails").when(k % 3 == 1, "E-Mail  Addresses").otherwise("ip addresses"),
        F.when(k % 2 == 0, _text('"', name, '"')).otherwise(_text('  "Region ', F.col("n_regionkey"), '" ')),
        F.when(k % 4 == 0, name).when(k % 4 == 1, F.lit("!phone")).when(k % 4 == 2, _text(name, ' "y" z')).otherwise(_text('"open ', name)),
        F.when(k % 5 == 0, F.lit('""')).otherwise(F.lit("")), F.when(k % 3 == 2, F.lit("people  names")).otherwise(F.lit("phone numbers")),
    )
    return _table(spark, sf_dir, "nation").select(k.alias("rules_id"), F.concat_ws("\r\n", *lines).alias("body"))


def rules_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rules(nation_books(spark, sf_dir)).select("rules_id", "line_number", "kind", "literal", "is_case_sensitive", "category")


def rules_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diagnostics(nation_books(spark, sf_dir)).select("rules_id", "line_number", "kind")


def unsupported_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of books that ask for what has no detector."""
    return R.unsupported_rules(nation_books(spark, sf_dir)).select("rules_id", "line_number", F.col("canonical").alias("category"))


def benchmark_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many exact rules as the benchmark has items, from its table."""
    return book_literal_spans(spark, sf_dir).groupBy("rule_line").agg(F.count(F.lit(1)).alias("n_spans"))


def book_literal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each item of the benchmark stands in the documents."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_number"), F.col("text").alias("literal"), F.lit(False).alias("is_case_sensitive"))
    return literals.literal_spans(documents(spark, sf_dir), items).select("doc_id", "rule_line", "start", "stop", "matched_text")


def tenant_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule book a source: a twentieth of the benchmark as literals, every third with the case they have, then a category for every second."""
    items = _table(spark, sf_dir, "benchmark").withColumn("rules_id", _text("src", F.col("item_id") % 20))
    line = _text(F.when(F.col("item_id") % 3 == 0, "!").otherwise(""), '"', F.regexp_replace("text", r"\s+", " "), '"')
    lines = items.groupBy("rules_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return lines.select("rules_id", F.concat("body", F.when(F.expr("int(substring(rules_id, 4))") % 2 == 0, "\nip addresses").otherwise("")).alias("body"))


def tenant_book_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by the book of its source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text", F.col("source").alias("rules_id"))
    return literals.book_spans(docs, tenant_books(spark, sf_dir)).select("doc_id", "rules_id", "rule_line", "start", "stop", "matched_text")


# --- plans and proposals ---
def _supplier_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    body = _text("# Plan\n\n## Page ", k % 9 + 2, "\n\n- [x] `", name, "` — names\n- [ ] `", k, "`\n* [X] acct ", k, " - note\nnot an item\n\n## Added by hand\n- [x] `zz`\n## Page 1\n- [x] `", name, "`\n")
    return _table(spark, sf_dir, "supplier").select(name.alias("source_name"), body.alias("body"))


def plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.parse(_supplier_plans(spark, sf_dir)).select("source_name", "pos", "is_selected", "value", "label", "page")


def plan_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, refused = plan.usable_values(plan.parse(_supplier_plans(spark, sf_dir)))
    return used.select("source_name", "value", F.lit(True).alias("used")).union(refused.select("source_name", "value", F.lit(False).alias("used")))


def plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans over several pages as Markdown: an order's lines are its pages, the last item has none."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    first = items.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    rows = items.join(first, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("source_name"), F.col("l_linenumber").alias("pos"), (F.col("part") % 2 == 0).alias("is_selected"), _text("part ", F.col("part")).alias("value"),
        F.when(F.col("part") % 3 == 0, "parts").otherwise("").alias("label"), F.when(F.col("l_linenumber") < F.col("last"), F.col("l_linenumber")).cast("int").alias("page"),
    )
    return plan.written(rows)


def proposal_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of eight kinds of proposals, one of them a customer."""
    k = F.col("c_custkey")
    upper, lower = F.char(k % 26 + 65), F.char(k % 26 + 97)
    forms = (
        (_text("$1,", F.lpad((k % 1000).cast("string"), 3, "0"), ".00"), "amount"), (_text("123", F.lpad((k % 100000000).cast("string"), 8, "0")), "account number"), (_text("Name: Ann ", upper, "ee"), "name"), (_text("Form ", k % 9000 + 1000), "form"),
        (_text("lower case words", lower), "full name"), (_text(k % 90 + 10, "a"), "code"), (_text("Box ", k % 9 + 1), "box"), (_text("Schedule K Ann ", upper, "ee"), "name"),
    )
    text, kind = (F.element_at(F.array(*(x[i] if i == 0 else F.lit(x[1]) for x in forms)), (k % 8 + 1).cast("int")) for i in range(2))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), kind.alias("kind"))
    t, k = F.col("text"), F.col("kind")
    return rows.select(
        "c_custkey", "text", P.is_not_identifying(t).alias("not_identifying"), P.value_without_label(t).alias("bare"), P.is_too_slight(t).alias("slight"), P.is_allowed_kind(k).alias("allowed"),
        P.is_excluded_kind(k).alias("excluded"), P.is_implausible_name(t, k).alias("odd_name"), P.looks_like_a_value(t).alias("value_like"),
    )


def chunked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for a model: joined they give each text back, and only a line that is longer alone is over the size."""
    parts = proposals.chunked(documents(spark, sf_dir))
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "chunk"))), lambda x: x["chunk"]), "\n").alias("whole"), F.count_if(F.length("chunk") > proposals.CHUNK).alias("n_over"))
    return joined.select("doc_id", F.md5("whole").alias("digest"), "n_over")


# --- a user's matcher ---
def _shouts(texts: list[str]) -> list[list[tuple[int, int]]]:
    return [[m.span() for m in re.finditer("[A-Z]{5,}", t)] for t in texts]


def own_matcher_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matcher for words in capitals, of twelve letters at most and without their first one; pages where it runs away refuse it."""
    own = Matchers().add(Matcher("shouted words", _shouts, accept=lambda v: F.length(v) <= 12, refine=lambda m: (m["start"] + 1, m["stop"]), overlaps="distinct"))
    book = R.RuleBook((R.Rule("category", None, False, "shouted words", 1),))
    kept, _ = S.refused(S.spans(documents(spark, sf_dir), book, matchers=own))
    return kept.select("doc_id", "rule_description", "start", "stop", "matched_text")


# --- categories with offsets, and reports ---
def category_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of six categories where they stand, one kind an order; odd orders hold what is near to a value but is none."""
    k = F.col("o_orderkey")
    kinds = (
        _text("Pay to GB29NWBK", F.lpad(k.cast("string"), 8, "0"), " now, swift code DEUTDE", F.lpad((k % 100).cast("string"), 2, "0"), "."), _text("host fe80::", F.lower(F.hex(k % 65536)), " up since 12:34:56"),
        _text("Dx: asthma, ICD-10: J", k % 90 + 10, "; ok"), _text("cvv: ", F.lpad((k % 1000).cast("string"), 3, "0"), " exp 04/27, cvx: 123"), _text("Send to PO Box ", k % 9999 + 1, ", not to PO Box A."), _text("VAT: GB", F.lpad(k.cast("string"), 9, "0"), ", private 123456789."),
    )
    near = _text("Pay to DE8 3704, swift code deutdeff, 12:34:56, dxx: none, cvx: 123, exp 14/27, P Box 12, private 123456789, ", k % 7)
    text = F.when(k % 2 == 1, near).otherwise(F.element_at(F.array(*kinds), (k / 2 % 6 + 1).cast("int")))
    pages = dealt(_table(spark, sf_dir, "orders").select(k)).select(k.alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))
    book = R.RuleBook(tuple(R.Rule("category", None, False, c, i + 1) for i, c in enumerate(("accountNumbers", "ipAddresses", "healthInformation", "creditCardNumbers", "streetAddresses", "employerIdentificationNumbers"))))
    return S.spans(pages, book).select("doc_id", "rule_line", "start", "stop", "matched_text")


def _that(spark: SparkSession, sf_dir: str) -> redaction.Redaction:
    return redaction.redact(conversations(spark, sf_dir).drop("role"), R.RuleBook((R.Rule("exact", "that", False, None, 1),)))


def page_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of many pages: each turn's status, and the page worth seeing first."""
    return reports.page_rail(_that(spark, sf_dir).pages).select("doc_id", "page", "status", "items", "first_page")


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents of many pages, with their verdicts."""
    out = _that(spark, sf_dir)
    rows = out.documents.select("doc_id", "items", "pages_redacted", "worst_pass", F.size("unexamined_pages").cast("long").alias("n_unexamined"), "is_settled")
    return rows.join(reports.verdicts(out.documents).select("doc_id", "verdict"), "doc_id")


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was not checked or was set aside in a run over the documents."""
    book = R.RuleBook((R.Rule("exact", "the", False, None, 1), R.Rule("category", None, False, "personNames", 2)), (("unknownCategory", 3, "nonsense"),))
    out = redaction.redact(documents(spark, sf_dir), book, hold=True)
    return reports.gaps(out.pages, book, out.problems)


# --- annotations ---
def annotated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose annotations are made from their keys and addresses: form fields, notes, and a null."""
    k, url = F.col("page_id"), F.col("url")
    note = F.struct(F.when(k % 3 == 0, _text("write to p", k, "@mail.example")).alias("value"), _text("copied from ", url).alias("contents"))
    field = F.struct(_text("10.0.0.", k % 250).alias("value"), F.lit(None).cast("string").alias("contents"))
    both = F.when(k % 5 == 0, F.array(note, field)).when(k % 5 == 1, F.array(field, note, note)).when(k % 5 == 2, F.array(note))
    text = F.when(k % 4 == 0, _text("see ", url, " or p", k, "@mail.example.")).otherwise(_text("see ", url))
    return _table(spark, sf_dir, "pages").select(k.alias("doc_id"), F.lit(1).alias("page"), text.alias("text"), both.alias("annotations"))


def _mail_book() -> R.RuleBook:
    return R.RuleBook((R.Rule("category", None, False, "emailAddresses", 1),))


def redact_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and dispositions count what stands in annotations only, too."""
    out = redaction.redact(annotated_pages(spark, sf_dir), _mail_book())
    return out.documents.select("doc_id", "items", "disposition", "is_settled")


def annotations_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redaction.redact(annotated_pages(spark, sf_dir), _mail_book())
    return out.annotations.select("doc_id", "annotation", "value")


def plan_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan values reach annotations: each page's plan holds its field's address; what is written keeps the other annotations."""
    pages = annotated_pages(spark, sf_dir)
    items = pages.select(F.col("doc_id").cast("string").alias("source_name"), F.lit(0).alias("pos"), (F.col("doc_id") % 2 == 0).alias("is_selected"), _text("10.0.0.", F.col("doc_id") % 250).alias("value"), F.lit("").alias("label"), F.lit(1).alias("page"))
    out = redaction.redact_plan(pages, items)
    return out.pages.select("doc_id", "items", "status", F.coalesce(F.size("annotations"), F.lit(0)).cast("long").alias("n_left"))


# --- copies ---
def _address_book(*more: str) -> R.RuleBook:
    return R.RuleBook(tuple(R.Rule("category", None, False, c, i + 1) for i, c in enumerate(("ipAddresses", *more))))


def _state(spark: SparkSession, root: str, step: str) -> DataFrame:
    """What a reader of the copies sees."""
    masked = F.length("text") - F.length(F.replace("text", F.lit(redaction.BLOCK), F.lit("")))
    return copies.visible(spark, root).agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(masked).cast("long").alias("n_masked"))


def published_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with addresses masked are published; a run over the same documents that does not verify changes nothing of what is visible."""
    store = Store(spark)
    root, docs = f"{store.folder}/copies", documents(spark, sf_dir)
    first = redaction.redact(docs, _address_book(), runaway=None)
    redaction.copied(first, root, source=f"{sf_dir}/documents.parquet")
    seen = store.kept(_state(spark, root, "verified"), "after-verified")
    first.discard()
    legible = S.spans(docs, _address_book()).select("doc_id", "page", F.col("matched_text").alias("value"))  # an inspector that still reads what was masked
    failed = redaction.redact(docs, _address_book("emailAddresses"), max_passes=1, inspector=lambda p: legible, runaway=None)
    redaction.copied(failed, root)
    return seen.unionByName(_state(spark, root, "failed"))


def replaced_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over a tenth of the documents, with one more category, replaces their copies only."""
    store = Store(spark)
    root, docs = f"{store.folder}/copies", documents(spark, sf_dir)
    redaction.copied(redaction.redact(docs, _address_book(), runaway=None), root)
    redaction.copied(redaction.redact(docs.filter("doc_id % 10 = 0"), _address_book("emailAddresses"), runaway=None), root, hold=True)
    masked = F.length("text") - F.length(F.replace("text", F.lit(redaction.BLOCK), F.lit("")))
    return copies.visible(spark, root).select("doc_id", F.length("text").cast("long").alias("n_chars"), masked.cast("long").alias("n_masked"))


# --- ranges and boxes ---
def hot_page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all orders as ranges of one page: those of even number that no range of an odd one touches."""
    at = F.col("l_orderkey") * 40 + F.col("l_partkey") % 200
    lines = _table(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc_id"), F.lit(1).alias("page"), "l_orderkey", "l_linenumber", "l_suppkey", at.alias("start"))
    rules = lines.filter("l_linenumber % 2 = 1").withColumn("stop", F.col("start") + 5 + F.col("l_suppkey") % 20)
    asked = lines.filter("l_linenumber % 2 = 0").withColumn("stop", F.col("start") + 3)
    return proposals.not_covered(asked, rules).select("l_orderkey", "l_linenumber", "start")


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in zip((x, y, w, h), "xywh", strict=True)))


def read_and_drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes read on a page (lines of odd number of an order) with those drawn there, small ones and very large ones: who meets whom, who agrees, who is held."""
    c = F.col
    lines = _table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), c("l_linenumber").alias("line"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_quantity").cast("long").alias("q"))
    read = lines.filter("line % 2 = 1").select("doc_id", "page", F.struct("line", _box(c("p") % 90 - 10, c("s") % 40, c("q") % 30 + 5, F.lit(8)).alias("box")).alias("a"))
    large = F.when(c("q") % 7 == 0, 4000).otherwise(c("q") % 45 + 4)
    drawn = lines.filter("line % 2 = 0").select("doc_id", "page", F.struct("line", _box(c("p") % 80 - 20, c("s") % 50 - 5, large, c("q") % 15 + 1).alias("box")).alias("b"))
    a, b = c("a.box"), c("b.box")
    met = intervals.met_boxes(read, drawn)
    return met.select("doc_id", c("a.line").alias("read_line"), c("b.line").alias("drawn_line"), intervals.agrees(a, b).alias("agrees"), intervals.contains(b, a).alias("held"))


def token_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each value on a recognised line: an order's lines are its tokens, six places each, and a value covers a run of them."""
    c = F.col
    lines = _table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line"), c("l_linenumber").alias("k"), c("l_partkey").alias("p"))
    tokens = lines.select("doc_id", "page", "line", (c("k") * 6).alias("start"), (c("k") * 6 + 5).alias("stop"), _box(c("k") * 10, c("p") % 5, F.lit(9), F.lit(4)).alias("box"))
    hits = _table(spark, sf_dir, "orders").select(c("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line"), F.lit(1).alias("hit"), (c("o_custkey") % 20).alias("start"), (c("o_custkey") % 20 + 13).alias("stop"))
    return intervals.boxes_covering(hits, tokens).select("doc_id", c("box.x").alias("x"), c("box.y").alias("y"), c("box.w").alias("w"), c("box.h").alias("h"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rules_parse, rules_diagnostics, unsupported_categories, benchmark_literals, book_literal_spans, tenant_book_spans, plan_parse, plan_usable, plan_pages, proposal_filters, chunked_texts, own_matcher_spans, redact_with_annotations,
        annotations_deleted, plan_with_annotations, published_copies, replaced_copies, hot_page_overlap, read_and_drawn_boxes,
        token_boxes, category_offsets, page_rail, conversation_documents, gap_report,
    )
}

_LITERALS = f"""b AS (SELECT item_id, {_norm('text')} AS lit FROM benchmark),
  w AS (SELECT doc_id, item_id, n, lit, parts, unnest(range(1, len(parts))) AS i FROM (SELECT *, string_split(lower(n), lower(lit)) AS parts FROM n JOIN b ON contains(lower(n), lower(lit)))),
  lits AS (SELECT doc_id, item_id, (list_sum([length(x) FOR x IN parts[1:i]]) + (i - 1) * length(lit))::INT AS start, lit, substr(n, (list_sum([length(x) FOR x IN parts[1:i]]) + (i - 1) * length(lit))::INT + 1, length(lit)) AS matched_text FROM w)"""
_NOTES = """p AS (SELECT page_id, 'p' || page_id || '@mail.example' AS mail, CASE page_id % 5 WHEN 0 THEN ['n', 'f'] WHEN 1 THEN ['f', 'n', 'n'] WHEN 2 THEN ['n'] ELSE [] END AS notes FROM pages)"""
_RAIL = f"""WITH n AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, {_norm("coalesce(text, '')")} AS n FROM conversations), k AS (SELECT doc_id, page, n, {_occurrences('that', 'lower(n)')}::BIGINT AS k FROM n),
  c AS (SELECT doc_id, page, k, CASE WHEN k <= 40 THEN k ELSE 0 END AS items, CASE WHEN k BETWEEN 1 AND 40 THEN 'redacted' WHEN n = '' THEN 'not_examined' ELSE 'no_matches' END AS status FROM k)"""
ORACLES: dict[str, str] = {
    "rules_parse": """
      SELECT n_nationkey AS rules_id, 2 AS line_number, 'exact' AS kind, n_name AS literal, false AS is_case_sensitive, NULL AS category FROM nation UNION ALL SELECT n_nationkey, 3, 'exact', lower(n_name), true, NULL FROM nation
      UNION ALL SELECT n_nationkey, 4, 'category', NULL, false, CASE WHEN n_nationkey % 3 = 2 THEN 'ipAddresses' ELSE 'emailAddresses' END FROM nation
      UNION ALL SELECT n_nationkey, 5, 'exact', 'Region ' || n_regionkey, false, NULL FROM nation WHERE n_nationkey % 2 = 1
      UNION ALL SELECT n_nationkey, 8, 'category', NULL, false, CASE WHEN n_nationkey % 3 = 2 THEN 'personNames' ELSE 'phoneNumbers' END FROM nation""",
    "rules_diagnostics": """
      SELECT n_nationkey AS rules_id, 5 AS line_number, 'duplicateRule' AS kind FROM nation WHERE n_nationkey % 2 = 0
      UNION ALL SELECT n_nationkey, 6, CASE n_nationkey % 4 WHEN 0 THEN 'unknownCategory' WHEN 1 THEN 'caseSensitiveMarkerRequiresQuotes' WHEN 2 THEN 'strayQuote' ELSE 'unterminatedQuote' END FROM nation
      UNION ALL SELECT n_nationkey, 7, 'emptyExactMatch' FROM nation WHERE n_nationkey % 5 = 0""",
    "unsupported_categories": "SELECT n_nationkey AS rules_id, 8 AS line_number, 'person names' AS category FROM nation WHERE n_nationkey % 3 = 2",
    "benchmark_literals": f"WITH {DOCS}, {_LITERALS} SELECT item_id::INT AS rule_line, count(*) AS n_spans FROM lits GROUP BY item_id",
    "book_literal_spans": f"WITH {DOCS}, {_LITERALS} SELECT doc_id, item_id::INT AS rule_line, start, (start + length(lit))::INT AS stop, matched_text FROM lits",
    "tenant_book_spans": f"""{IP}, {_LITERALS},
      r AS (SELECT item_id, 'src' || (item_id % 20) AS rules_id, row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id)::INT AS rule_line, item_id % 3 = 0 AS sensitive FROM benchmark),
      c AS (SELECT rules_id, (max(rule_line) + 1)::INT AS rule_line FROM r WHERE item_id % 2 = 0 GROUP BY rules_id)
      SELECT l.doc_id, rules_id, rule_line, start, (start + length(lit))::INT AS stop, matched_text FROM lits l JOIN documents d ON d.doc_id = l.doc_id JOIN r ON r.item_id = l.item_id AND r.rules_id = d.source WHERE NOT sensitive OR matched_text = lit
      UNION ALL SELECT i.doc_id, rules_id, rule_line, start, (start + length(matched_text))::INT, matched_text FROM ip i JOIN documents d ON d.doc_id = i.doc_id JOIN c ON c.rules_id = d.source""",
    "plan_parse": """
      SELECT s_name AS source_name, 4 AS pos, true AS is_selected, s_name AS value, 'names' AS label, (s_suppkey % 9 + 2)::INT AS page FROM supplier UNION ALL SELECT s_name, 5, false, s_suppkey::VARCHAR, '', (s_suppkey % 9 + 2)::INT FROM supplier
      UNION ALL SELECT s_name, 6, true, 'acct ' || s_suppkey, 'note', (s_suppkey % 9 + 2)::INT FROM supplier UNION ALL SELECT s_name, 10, true, 'zz', '', NULL FROM supplier UNION ALL SELECT s_name, 12, true, s_name, '', 1 FROM supplier""",
    "plan_usable": "SELECT s_name AS source_name, s_name AS value, true AS used FROM supplier UNION ALL SELECT s_name, 'acct ' || s_suppkey, true FROM supplier UNION ALL SELECT s_name, 'zz', false FROM supplier",
    "plan_pages": """
      WITH i AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_partkey) AS part FROM lineitem GROUP BY ALL), x AS (SELECT *, k < max(k) OVER (PARTITION BY o) AS placed FROM i),
      l AS (SELECT *, CASE WHEN part % 2 = 0 THEN '- [x] `part ' ELSE '- [ ] `part ' END || part || '`' || CASE WHEN part % 3 = 0 THEN ' — parts' ELSE '' END AS line FROM x)
      SELECT o::VARCHAR AS source_name, '# Redaction plan: ' || o || chr(10) || chr(10) || count_if(part % 2 = 0) || ' of ' || count(*) || ' items are ticked and will be removed.' || chr(10) || chr(10)
        || string_agg(CASE WHEN placed THEN '## Page ' || k ELSE '## Added by hand' END || chr(10) || chr(10) || line || chr(10), chr(10) ORDER BY NOT placed, k) AS body FROM l GROUP BY o""",
    "proposal_filters": """
      WITH c AS (SELECT c_custkey, c_custkey % 8 AS g, chr((c_custkey % 26 + 65)::INT) AS u, chr((c_custkey % 26 + 97)::INT) AS l FROM customer),
      t AS (SELECT c_custkey, g, CASE g WHEN 0 THEN '$1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.00' WHEN 1 THEN '123' || lpad((c_custkey % 100000000)::VARCHAR, 8, '0') WHEN 2 THEN 'Name: Ann ' || u || 'ee' WHEN 3 THEN 'Form ' || (c_custkey % 9000 + 1000)
        WHEN 4 THEN 'lower case words' || l WHEN 5 THEN (c_custkey % 90 + 10) || 'a' WHEN 6 THEN 'Box ' || (c_custkey % 9 + 1) ELSE 'Schedule K Ann ' || u || 'ee' END AS text FROM c)
      SELECT c_custkey, text, g IN (0, 3, 6) AS not_identifying, CASE WHEN g = 2 THEN substr(text, 7) ELSE text END AS bare, g = 5 AS slight, g IN (1, 2, 4, 7) AS allowed, g IN (0, 3, 5, 6) AS excluded, g = 4 AS odd_name, g <> 5 AS value_like FROM t""",
    "chunked_texts": "SELECT doc_id, md5(text) AS digest, CASE WHEN length(text) <= 1200 THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 1200)) END::BIGINT AS n_over FROM documents WHERE text <> ''",
    "own_matcher_spans": f"WITH {DOCS}, {_places('[A-Z]{5,}', 'length(MATCH) <= 12')} SELECT doc_id, 'shouted words' AS rule_description, (start + 1)::INT AS start, (start + length(matched_text))::INT AS stop, substr(matched_text, 2) AS matched_text FROM p QUALIFY count(*) OVER (PARTITION BY doc_id) <= 40",
    "redact_with_annotations": f"""WITH {_NOTES}, i AS (SELECT page_id, (CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN len(list_filter(notes, lambda x: x = 'n')) ELSE 0 END)::BIGINT AS items FROM p)
      SELECT page_id AS doc_id, items, CASE WHEN items > 0 THEN 'written' ELSE 'nothing_matched' END AS disposition, items > 0 AS is_settled FROM i""",
    "annotations_deleted": f"WITH {_NOTES}, a AS (SELECT page_id, mail, notes, unnest(range(len(notes))) AS i FROM p WHERE page_id % 3 = 0) SELECT page_id AS doc_id, i::INT AS annotation, 'write to ' || mail AS value FROM a WHERE notes[i + 1] = 'n'",
    "plan_with_annotations": f"""WITH {_NOTES}, h AS (SELECT page_id, len(notes) AS n, CASE WHEN page_id % 2 = 0 THEN len(list_filter(notes, lambda x: x = 'f')) ELSE 0 END AS gone FROM p)
      SELECT page_id AS doc_id, gone::BIGINT AS items, CASE WHEN gone > 0 THEN 'redacted' ELSE 'no_matches' END AS status, (n - gone)::BIGINT AS n_left FROM h""",
    "published_copies": f"""{IP}, c AS (SELECT count(*) AS n_pages, sum(length(n))::BIGINT AS n_chars, (SELECT sum(length(matched_text)) FROM ip)::BIGINT AS n_masked FROM n)
      SELECT unnest(['verified', 'failed']) AS step, n_pages, n_chars, n_masked FROM c""",
    "replaced_copies": f"""{BOTH}, m AS (SELECT doc_id, sum(length(matched_text)) AS k FROM hits WHERE category = 'ipAddresses' OR doc_id % 10 = 0 GROUP BY doc_id)
      SELECT n.doc_id, length(n)::BIGINT AS n_chars, coalesce(k, 0)::BIGINT AS n_masked FROM n LEFT JOIN m USING (doc_id)""",
    "hot_page_overlap": """
      WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_orderkey * 40 + l_partkey % 200 AS a FROM lineitem), r AS (SELECT a, a + 5 + l_suppkey % 20 AS b FROM l WHERE l_linenumber % 2 = 1),
      e AS (SELECT a AS pos, 1 AS k, b FROM r UNION ALL SELECT a + 3, 0, NULL FROM l WHERE l_linenumber % 2 = 0), w AS (SELECT DISTINCT pos, k, max(b) OVER (ORDER BY pos, k) AS b FROM e)
      SELECT l_orderkey, l_linenumber, l.a AS start FROM l JOIN w ON w.pos = l.a + 3 AND w.k = 0 WHERE l_linenumber % 2 = 0 AND coalesce(w.b, l.a) <= l.a""",
    "read_and_drawn_boxes": """
      WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q FROM lineitem),
      a AS (SELECT o, n, p % 90 - 10 AS x, s % 40 AS y, q % 30 + 5 AS w, 8 AS h FROM l WHERE n % 2 = 1), b AS (SELECT o, n, p % 80 - 20 AS x, s % 50 - 5 AS y, CASE WHEN q % 7 = 0 THEN 4000 ELSE q % 45 + 4 END AS w, q % 15 + 1 AS h FROM l WHERE n % 2 = 0),
      m AS (SELECT a.o, a.n AS rn, b.n AS dn, a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h AS meets, b.w <= 1.5 * a.w AND b.h <= 1.5 * a.h AS small,
              b.x <= a.x AND b.y <= a.y AND b.x + b.w >= a.x + a.w AND b.y + b.h >= a.y + a.h AS held FROM a JOIN b USING (o))
      SELECT o AS doc_id, rn AS read_line, dn AS drawn_line, meets AND small AS agrees, held FROM m WHERE meets""",
    "token_boxes": """
      WITH t AS (SELECT l_orderkey AS o, l_linenumber * 6 AS s, l_linenumber * 10 AS x, l_partkey % 5 AS y FROM lineitem), h AS (SELECT o_orderkey AS o, o_custkey % 20 AS a FROM orders),
      u AS (SELECT h.o, min(x) AS x, min(y) AS y, max(x + 9) - min(x) AS w, max(y + 4) - min(y) AS h FROM h JOIN t ON t.o = h.o AND s < a + 13 AND a < s + 5 GROUP BY h.o)
      SELECT h.o AS doc_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, u.h::DOUBLE AS h FROM h LEFT JOIN u USING (o)""",
    "category_offsets": """
      WITH o AS (SELECT o_orderkey AS k, (o_orderkey // 2) % 6 AS g FROM orders WHERE o_orderkey % 2 = 0),
      v AS (SELECT k, 1 AS rule_line, 7 AS start, 'GB29NWBK' || lpad(k::VARCHAR, 8, '0') AS v FROM o WHERE g = 0 UNION ALL SELECT k, 1, 40, 'DEUTDE' || lpad((k % 100)::VARCHAR, 2, '0') FROM o WHERE g = 0
        UNION ALL SELECT k, 2, 5, 'fe80::' || lower(to_hex(k % 65536)) FROM o WHERE g = 1 UNION ALL SELECT k, 3, 4, 'asthma, ICD-10: J' || (k % 90 + 10) FROM o WHERE g = 2 UNION ALL SELECT k, 3, 20, 'J' || (k % 90 + 10) FROM o WHERE g = 2
        UNION ALL SELECT k, 4, 5, lpad((k % 1000)::VARCHAR, 3, '0') FROM o WHERE g = 3 UNION ALL SELECT k, 4, 13, '04/27' FROM o WHERE g = 3
        UNION ALL SELECT k, 5, 8, 'PO Box ' || (k % 9999 + 1) FROM o WHERE g = 4 UNION ALL SELECT k, 6, 5, 'GB' || lpad(k::VARCHAR, 9, '0') FROM o WHERE g = 5)
      SELECT k AS doc_id, rule_line, start, (start + length(v))::INT AS stop, v AS matched_text FROM v""",
    "page_rail": f"""{_RAIL} SELECT doc_id, page, status, items, first(page) OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'not_examined' THEN 0 WHEN 'redacted' THEN 1 ELSE 2 END, page) AS first_page FROM c""",
    "conversation_documents": f"""{_RAIL}, d AS (SELECT doc_id, sum(items)::BIGINT AS items, count_if(status = 'redacted') AS pages_redacted, max(CASE WHEN items > 0 THEN 1 ELSE 0 END)::INT AS worst_pass, count_if(status = 'not_examined') AS n_unexamined, bool_or(k > 40) AS bad FROM c GROUP BY doc_id)
      SELECT doc_id, items, pages_redacted, worst_pass, n_unexamined, items > 0 AND NOT bad AND n_unexamined = 0 AS is_settled,
        CASE WHEN items = 0 THEN 'nothing matched' WHEN bad THEN 'not written: it did not verify' ELSE items || CASE WHEN items = 1 THEN ' item removed' ELSE ' items removed' END || CASE WHEN n_unexamined > 0 THEN '; ' || n_unexamined || ' pages not examined' ELSE '' END END AS verdict FROM d""",
    "gap_report": f"""{THE} SELECT 'Problem' AS title, 'document ' || doc_id || ', page 1: “the” matched ' || n || ' times on one page and was refused' AS detail FROM c WHERE n > 40
      UNION ALL SELECT 'Pages not examined', 'document ' || doc_id || ', pages 1' FROM n WHERE coalesce(n, '') = '' UNION ALL SELECT 'Category without a detector', 'person names' UNION ALL SELECT 'Rule set aside', 'line 3: nonsense'""",
}
