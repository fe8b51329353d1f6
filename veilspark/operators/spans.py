"""Pages and a rule book into spans: one wide projection, no join, no shuffle.

Pages are (doc_id, page, text). Every matcher is an array expression over the normalised text, behind a cheap
gate; exact rules are matched the same way up to MANY_EXACT of them, beyond that by one Aho-Corasick pass with
the same results.
Spans have half-open ranges in the normalised text, and on request in the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.text import PARAGRAPH, has_adjacent_digits, normalized, normalized_breaks
from veilspark.operators.patterns import COLUMNS, DISTINCT, PATTERNS, WIDEST, Pattern, unlabelled_digits
from veilspark.operators.matchers import Matchers
from veilspark.operators.tables import TABLE_ROW, table_cells
from veilspark.sources.rules import CANONICAL, UNSUPPORTED, Rule, RuleBook

MANY_EXACT = 64
SPAN = "array<struct<start:int,stop:int,matched_text:string,engine_no:int>>"
RUNAWAY = 40


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body).getItem(0)


def _located(text: Column, regex: Column | str, whole: Column, body) -> Column:
    """body(start, match, its number) for each match of regex in text, whole being all matches; nulls are left out.

    Starts are folded once: what lies between the matches is what splitting the text leaves.
    """

    def folded(parts: Column) -> Column:
        lead, hit = parts["lead"], parts["whole"]

        def step(state: Column, w: Column) -> Column:
            i = F.size(state["out"])
            start = state["at"] + F.length(F.get(lead, i))
            return F.struct((start + F.length(w)).alias("at"), F.array_append(state["out"], start).alias("out"))

        starts = F.aggregate(hit, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]
        return _let(starts, lambda st: F.filter(F.transform(hit, lambda w, i: body(F.get(st, i), w, i)), lambda x: x.isNotNull()))

    parts = F.struct(F.split(text, regex, -1).alias("lead"), whole.alias("whole"))
    return F.when(F.size(whole) > 0, _let(parts, folded)).otherwise(F.array().cast(SPAN))


def _span(start: Column, value: Column, engine_no: int) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("stop"), value.alias("matched_text"), F.lit(engine_no).alias("engine_no"))


def digit_runs(text: Column) -> Column:
    """Length of the longest run of ASCII digits, up to 9: worked out once a page, most patterns need some."""
    return F.when(~F.rlike(text, F.lit("[0-9]")), F.lit(0)).otherwise(F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[0-9]{1,9}"), 0), lambda x: F.length(x))), F.lit(0)))


def hits(text: Column, raw: Column, runs: Column, pattern: Pattern, engine_no: int) -> Column:
    """All non-overlapping matches of one pattern, as spans of its value. raw: the text before it was normalised; runs: its digit_runs()."""
    regex = F.lit(pattern.regex)

    def found(whole: Column) -> Column:
        if pattern.group == 0:
            keep = lambda start, w, i: F.when(pattern.keep(w, F.lit(0)), _span(start, w, engine_no)) if pattern.keep else _span(start, w, engine_no)
            return _located(text, pattern.regex, whole, keep)
        # What stands before the value in each match has a length of its own: the value may stand in its label too.
        inner = F.struct(F.regexp_extract_all(text, F.lit(pattern.led), 1).alias("led"), F.regexp_extract_all(text, regex, 1).alias("value"), (normalized_breaks(raw) if pattern.breaks else F.lit(None)).alias("breaks"))

        def one(x: Column) -> Column:
            def span(start: Column, w: Column, i: Column) -> Column:
                size, value = F.length(F.get(x["led"], i)), F.get(x["value"], i)
                if not pattern.breaks:
                    found = _span(start + size, value, engine_no)
                    return F.when(pattern.keep(value, F.lit(0)), found) if pattern.keep else found
                skipped = F.substring(x["breaks"], start + F.lit(1), size)
                lines, paragraphs = (size - F.length(F.replace(skipped, F.lit(c), F.lit(""))) for c in ("\n", PARAGRAPH))
                return F.when(pattern.keep(value, lines + 2 * paragraphs), _span(start + size, value, engine_no))

            return _located(text, pattern.regex, whole, span)

        return F.when(F.size(whole) > 0, _let(inner, one)).otherwise(F.array().cast(SPAN))

    every = _let(F.regexp_extract_all(text, regex, 0), found)
    gate = (runs >= pattern.digits) if pattern.digits else F.lit(True)
    gate = gate & (F.rlike(text, regex) if pattern.gate is None else F.contains(text, F.lit(pattern.gate)))
    return F.when(gate, every).otherwise(F.array().cast(SPAN))


def literal_hits(text: Column, literal: Column, sensitive: Column | bool, engine_no: int) -> Column:
    """All non-overlapping occurrences of a literal, as substrings; case is folded letter by letter unless it counts."""
    return _let(normalized(literal), lambda needle: needle_hits(text, needle, sensitive, engine_no))


def needle_hits(text: Column, needle: Column, sensitive: Column | bool, engine_no: int) -> Column:
    """literal_hits() of a literal that is normalised already."""
    flags = F.when(F.lit(sensitive) if isinstance(sensitive, bool) else sensitive, F.lit("")).otherwise(F.lit("(?iu)"))

    pattern = F.concat(flags, F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    whole = F.call_function("regexp_extract_all", text, pattern, F.lit(0))
    return F.when(needle == "", F.array().cast(SPAN)).otherwise(_let(whole, lambda w: _located(text, pattern, w, lambda start, x, i: _span(start, x, engine_no))))


def exact_hits(text: Column, rule: Rule, engine_no: int) -> Column:
    """literal_hits() of a rule, whose pattern is folded when the query is planned."""
    needle = normalized(F.lit(rule.literal))
    pattern = F.concat(F.lit("" if rule.is_case_sensitive else "(?iu)"), F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    whole = F.call_function("regexp_extract_all", text, pattern, F.lit(0))
    there = F.contains(text, needle) if rule.is_case_sensitive else F.rlike(text, pattern)
    found = _let(whole, lambda w: _located(text, pattern, w, lambda start, x, i: _span(start, x, engine_no)))
    return F.when((needle != "") & there, found).otherwise(F.array().cast(SPAN))


def first_of_equal_ranges(spans: Column) -> Column:
    """Of spans with one range the first engine's stays; sorted by start."""
    ordered = F.array_sort(spans, lambda a, b: _compare(a, b, "start", "stop", "engine_no"))

    def firsts(held: Column) -> Column:  # sorted once, not once for each span
        return F.filter(held, lambda x, i: (i == 0) | (F.get(held, i - 1)["start"] != x["start"]) | (F.get(held, i - 1)["stop"] != x["stop"]))

    return _let(ordered, firsts)


def _compare(a: Column, b: Column, *keys: str) -> Column:
    out = F.lit(0)
    for k in reversed(keys):
        x, y = (a[k], b[k]) if not k.startswith("-") else (b[k[1:]], a[k[1:]])
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def widest_of_overlapping(spans: Column) -> Column:
    """By start, longest first, each span that does not overlap the last kept one."""
    ordered = F.array_sort(spans, lambda a, b: _compare(a, b, "start", "-stop", "engine_no"))
    return F.aggregate(ordered, F.array().cast(SPAN), lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(F.element_at(kept, -1)["stop"] > x["start"], kept).otherwise(F.array_append(kept, x)))


def merged(spans: Column) -> Column:
    """The disjoint ranges that spans cover, in order."""
    kind = "array<struct<start:int,stop:int>>"
    ranges = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        grown = F.array_append(F.slice(kept, 1, F.size(kept) - 1), F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop")))
        return F.when(F.size(kept) == 0, F.array(x)).when(last["stop"] >= x["start"], grown).otherwise(F.array_append(kept, x))

    return F.aggregate(ranges, F.array().cast(kind), step)


def category_hits(category: str, text: Column, raw: Column, runs: Column, unlabelled: int | None = None, cells: Column | None = None) -> Column:
    """Spans of a category on a page, those of its tables' columns with them; a cell that a pattern has found already is not reported again."""
    patterns = PATTERNS[category]
    if category == "accountNumbers" and unlabelled is not None:
        patterns = (*patterns, unlabelled_digits(unlabelled))
    found = F.concat(*(hits(text, raw, runs, p, i) for i, p in enumerate(patterns)), *([] if cells is None else [column_hits(category, cells)]))
    if category in WIDEST:
        return widest_of_overlapping(found)
    if category in DISTINCT:
        return first_of_equal_ranges(found)
    return F.array_sort(found, lambda a, b: _compare(a, b, "start", "stop", "engine_no"))


def supported(book: RuleBook) -> tuple[str, ...]:
    return tuple(c for c in book.categories if c not in UNSUPPORTED)


def unsupported(book: RuleBook) -> tuple[str, ...]:
    """Categories without a detector: always reported, never skipped silently."""
    return tuple(CANONICAL[c] for c in book.categories if c in UNSUPPORTED)


def spans(pages: DataFrame, book: RuleBook, unlabelled: int | None = None, carry: tuple[str, ...] = (), matchers: Matchers | None = None) -> DataFrame:
    """doc_id, page, columns to carry along, source_kind, category, rule_description, rule_line, start, stop, matched_text, engine_no.

    matchers: what categories of the book that are none of the fixed ones look for.
    """
    book.required()
    keys = ["doc_id", "page", *carry]
    out, base = None, page_spans(pages, book, unlabelled, carry, matchers)
    if len(book.exact) <= MANY_EXACT or book.categories:
        # Outer: of other explosions Spark infers that their arrays are not empty, and works out all matches for that filter, below the projection, again.
        found = base.select(*keys, F.explode_outer("sources").alias("s")).select(*keys, "s.*")
        found = found.select(*keys, "source_kind", "category", "rule_description", "rule_line", F.explode_outer("spans").alias("m")).filter("m is not null")
        out = found.select("*", "m.*").drop("m")
    if len(book.exact) > MANY_EXACT:
        many = many_exact(base.select(*keys, "n"), book.exact)
        out = many if out is None else out.unionByName(many)
    return out


SOURCES = f"array<struct<source_kind:string,category:string,rule_description:string,rule_line:int,spans:{SPAN}>>"


def page_spans(pages: DataFrame, book: RuleBook | None, unlabelled: int | None = None, carry: tuple[str, ...] = (), matchers: Matchers | None = None) -> DataFrame:
    """doc_id, page, columns to carry along, text, n (the normalised text) and sources: each rule with its spans on the page, without more than MANY_EXACT literals.

    One projection: what masks a page's spans needs no join to find them.
    """
    base = _read(pages, carry)
    if book is None:
        return base.withColumn("sources", F.array().cast(SOURCES))
    lines = {r.category: r.line_number for r in book.rules if r.kind == "category"}
    own = matchers.named(book) if matchers else {}
    for category in own:
        base = base.withColumn(f"own {category}", own[category].found(F.col("n")))
    if any(c in COLUMNS for c in supported(book)):  # only pages that hold tables go through Python
        base = base.withColumn("cells", table_cells(F.when(F.rlike("text", F.lit(TABLE_ROW)), F.col("text"))))
    sources = []
    for rule in book.exact if len(book.exact) <= MANY_EXACT else ():
        sources.append(_source("exact", None, rule.description, rule.line_number, exact_hits(F.col("n"), rule, 0)))
    for category in supported(book):
        if category in own:
            sources.append(_source("category", category, own[category].description, lines[category], own[category].hits(F.col(f"own {category}"))))
            continue
        found = category_hits(category, F.col("n"), F.col("text"), F.col("runs"), unlabelled, F.col("cells") if category in COLUMNS else None)
        sources.append(_source("category", category, CANONICAL[category], lines[category], found))
    return base.select("doc_id", "page", *carry, "text", "n", F.array(*sources).cast(SOURCES).alias("sources"))


def _read(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pages with n, the normalised text, and the longest run of digits in it."""
    pages = with_pages(pages, carry)
    return pages.select("*", normalized(F.col("text")).alias("n")).withColumn("runs", digit_runs(F.col("n")))


def with_pages(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pages with a page column; a table without one has one page a document."""
    page = F.col("page").cast("int") if "page" in pages.columns else F.lit(1)
    return pages.select("doc_id", page.alias("page"), *carry, F.coalesce("text", F.lit("")).alias("text"))


def _source(kind: str, category: str | None, description: str, line: int, found: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("source_kind"), F.lit(category).cast("string").alias("category"), F.lit(description).alias("rule_description"),
        F.lit(line).alias("rule_line"), found.cast(SPAN).alias("spans"),
    )


def column_hits(category: str, cells: Column) -> Column:
    """Cells of a page's tables under a header that names the category, as spans; null cells (no table) give none."""
    header, value = COLUMNS[category]

    def fits(c: Column) -> Column:
        fit = F.rlike(c["header"], F.lit(f"(?i)^(?:{header})$")) & F.rlike(c["cell"], F.lit(f"^(?:{value})$"))
        return fit & has_adjacent_digits(c["cell"]) if category == "accountNumbers" else fit

    found = F.transform(F.filter(cells, fits), lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["cell"].alias("matched_text"), F.lit(9).alias("engine_no")))
    return F.coalesce(found, F.array().cast(SPAN))


class _Folded(dict):
    """What each character becomes when case is folded letter by letter: lower case of its upper case, if these are single."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        upper = c.upper() if len(c.upper()) == 1 else c
        self[code] = "i" if c == "\u0130" else upper.lower() if len(upper.lower()) == 1 else upper
        return self[code]


_folded = _Folded()


def many_exact(base: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One pass of an Aho-Corasick automaton for many literals over (keys and carried columns, n); each rule's own hits do not overlap.

    The automaton is built on the driver, once, and broadcast; it is as large as the rule book.
    """
    import ahocorasick

    from veilspark.operators.offsets import normalize

    keys = [c for c in base.columns if c != "n"]
    schema = T.StructType([*base.select(*keys).schema.fields, *T._parse_datatype_string("source_kind string, category string, rule_description string, rule_line int, start int, stop int, matched_text string, engine_no int").fields])
    words: dict[bool, dict[str, list[int]]] = {True: {}, False: {}}
    rows = []
    for k, r in enumerate(rules):
        needle = normalize(r.literal)[0]
        rows.append((r.description, r.line_number, len(needle)))
        if needle:
            words[r.is_case_sensitive].setdefault(needle if r.is_case_sensitive else needle.translate(_folded), []).append(k)
    trees = {}
    for sensitive, own in words.items():
        if own:
            trees[sensitive] = ahocorasick.Automaton()
            for needle, ks in own.items():
                trees[sensitive].add_word(needle, tuple(ks))
            trees[sensitive].make_automaton()
    shared = base.sparkSession.sparkContext.broadcast((trees, rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, rows = shared.value
        for pdf in batches:
            out = []
            for *row, text in zip(*(pdf[k] for k in keys), pdf["n"], strict=True):
                for sensitive, tree in trees.items():
                    free: dict[int, int] = {}
                    for last, ks in tree.iter(text if sensitive else text.translate(_folded)):
                        for k in ks:
                            description, line, size = rows[k]
                            a = last - size + 1
                            if a >= free.get(k, 0):
                                free[k] = a + size
                                out.append((*row, "exact", None, description, line, a, a + size, text[a : a + size], 0))
            yield pd.DataFrame(out, columns=schema.names)

    return base.mapInPandas(run, schema)


def counts_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_description").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"))


def refused(found: DataFrame, limit: int = RUNAWAY) -> tuple[DataFrame, DataFrame]:
    """Spans without those of rules that run away on a page, and the (page, rule) pairs refused.

    The counts are a partial aggregation; only the refused pairs, not the spans, are broadcast or shuffled back.
    """
    keys = ["doc_id", "page", "source_kind", "rule_line", "rule_description"]
    away = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    kept = found.join(away.select("doc_id", "page", "source_kind", "rule_line"), ["doc_id", "page", "source_kind", "rule_line"], "left_anti")
    return kept, away


def unused_rules(book: RuleBook, found: DataFrame) -> DataFrame:
    """Rules that matched nothing."""
    spark = found.sparkSession
    every = spark.createDataFrame([(r.line_number, r.description) for r in book.rules if r.kind == "exact" or r.category not in UNSUPPORTED], "rule_line int, rule_description string")
    return every.join(found.select("rule_line").distinct(), "rule_line", "left_anti")
