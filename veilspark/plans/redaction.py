"""Redaction of text with read-back: mask, read again, match again, at most a few passes, then verify.

Masking is an expression over each page and its spans; pages without spans are copied through. A pass looks only at
pages that still have residue: what rules, plan values or an inspector still find there outside the ranges masked so
far. Every pass is written to the run's folder, so lineage stays short and a lost executor repeats one pass at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import has_text, normalized
from veilspark.operators.matchers import Matchers
from veilspark.operators.spans import MANY_EXACT, RUNAWAY, literal_hits, merged, page_spans, refused, spans, with_pages
from veilspark.plans import plan
from veilspark.plans.progress import Progress
from veilspark.sources import copies
from veilspark.sources.rules import RuleBook
from veilspark.sources.tables import Store, published, withdrawn

MAX_PASSES = 3
BLOCK = "█"
RANGES = "array<struct<start:int,stop:int>>"
FOUND = ("doc_id", "page", "place", "rule_line", "rule_description", "start", "stop", "matched_text", "origin")


class NothingMatched(ValueError):
    """No rule hit anything: there is nothing to write."""


def masked(text: Column, ranges: Column, fill: str = BLOCK) -> Column:
    """text with every covered character replaced; the length stays."""
    disjoint = merged(ranges)

    def built(r: Column) -> Column:
        begin = F.transform(r, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1)["stop"]))
        pieces = F.transform(r, lambda x, i: F.concat(F.substring(text, F.get(begin, i) + F.lit(1), x["start"] - F.get(begin, i)), F.repeat(F.lit(fill), x["stop"] - x["start"])))
        tail = F.coalesce(F.element_at(r, -1)["stop"], F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.substring(text, tail + F.lit(1), F.length(text)))

    return F.when(F.size(disjoint) == 0, text).otherwise(F.transform(F.array(disjoint), built).getItem(0))


def located_elsewhere(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans whose recorded text is not what their range holds: they must not be masked blindly."""
    joined = found.join(with_pages(pages), ["doc_id", "page"])
    held = F.substring(normalized(F.col("text")), F.col("start") + F.lit(1), F.col("stop") - F.col("start"))
    return joined.filter(held != F.col("matched_text")).select(found.columns)


def worth_acting_on(reported: Column, intended: Column) -> Column:
    """Whether a reported value contains, or is contained in, any intended one, white space and case aside."""
    bare = F.lower(F.trim(F.regexp_replace(reported, r"(?U)\s+", " ")))

    def near(value: Column) -> Column:
        v = F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))
        return (v != "") & (F.contains(v, bare) | F.contains(bare, v))

    return (bare != "") & F.exists(intended, near)


@dataclass
class Redaction:
    pages: DataFrame  # doc_id, page, text (masked, normalised), status, items, passes, reason; annotations that stay, if pages have some
    findings: DataFrame  # one row a span that was masked or dooms an annotation (place > 0), with its origin
    annotations: DataFrame  # doc_id, page, annotation (its number from 0), value: annotations that hold a hit and went with it
    problems: DataFrame  # doc_id, page, problem
    documents: DataFrame  # one row a document: totals, disposition
    folder: str | None = None  # where its passes are stored

    def discard(self) -> bool:
        """Delete the stored passes, once nothing reads this result any more."""
        return self.folder is not None and withdrawn(self.pages.sparkSession, self.folder)


def redact(
    pages: DataFrame,
    book: RuleBook | None = None,
    extra: DataFrame | None = None,
    values: DataFrame | None = None,
    inspector: Callable[[DataFrame], DataFrame] | None = None,
    max_passes: int = MAX_PASSES,
    verify: bool = True,
    hold: bool = False,
    folder: str | None = None,
    matchers: Matchers | None = None,
    progress: Progress | None = None,
    runaway: int | None = RUNAWAY,
) -> Redaction:
    """Mask what is to go, read back, and judge each document.

    What goes: hits of the book's rules (with a user's matchers, if it names some); extra spans, as from a reviewer (doc_id,
    page, start, stop, matched_text in the normalised text: those whose range holds another text are reported, not masked);
    and all occurrences of a document's values (doc_id, value). inspector gets the masked pages (doc_id, page, text) and
    returns what it can still read there (doc_id, page, value); reports that contain or are contained in what was meant to
    go are masked, too. folder: where passes are stored. progress counts pages as they are masked, read back and masked again.

    pages may have annotations (array<struct<value, contents>>), a second source of strings: each string is a place of its
    page, as the page's text is place 0, and all that goes is looked for in both, reviewers' texts and inspectors' reports
    included. An annotation with a hit in either string goes as a whole and counts once; a rule that runs away on a page's text is
    refused there, not in its annotations. runaway: so many hits a page a rule may have; with None no rule is refused, and all that is found goes.
    """
    if book is None and values is None and extra is None:
        raise ValueError("nothing says what to redact")
    if book is not None:
        book.required()
    store = Store(pages.sparkSession, folder)
    noted = "annotations" in pages.columns
    base = with_pages(pages, ("annotations",) if noted else ())
    wrong = None
    if extra is not None:
        extra = extra.select("doc_id", "page", F.lit(0).alias("place"), F.lit(0).alias("rule_line"), F.lit("proposal").alias("rule_description"), "start", "stop", "matched_text", F.lit("proposal").alias("origin"))
        wrong = store.kept(located_elsewhere(extra, base), "located-elsewhere")
        extra = store.kept(extra.join(wrong.select("doc_id", "page", "start", "stop"), ["doc_id", "page", "start", "stop"], "left_anti").select(*FOUND), "extra")
    more, notes = [], None
    if book is not None and len(book.exact) > MANY_EXACT:
        many = _refused(store.kept(_hits(_places(base.select("doc_id", "page", "text")), RuleBook(book.exact), None, None, matchers), "spans-of-many"), runaway)
        more.append(many[0])
    if values is not None:
        more.append(value_spans(base, values))
    if extra is not None:
        more.append(extra)
    if noted:
        notes = store.kept(_hits(_places(base).filter("place > 0"), book, values, extra, matchers).filter("place > 0"), "spans-of-annotations")
    def counted(df: DataFrame, phase: str) -> DataFrame:
        return df if progress is None else progress.counted(df, phase)

    done = store.kept(counted(_first(base, book, matchers, more, notes, runaway), "masked"), "pages-1")
    found = done.select("doc_id", "page", F.explode("found").alias("f")).select("doc_id", "page", F.lit(0).alias("place"), "f.*")
    findings = (found if notes is None else found.select(*FOUND).unionByName(notes.select(*FOUND))).select(*FOUND).withColumn("pass", F.lit(1))
    away = done.select("doc_id", "page", F.explode("away").alias("a")).select("doc_id", "page", "a.*")
    if book is not None and len(book.exact) > MANY_EXACT:
        away = away.unionByName(many[1].select(*away.columns))
    done = done.drop("found", "away")
    left, unlocated, refusals = findings.drop("pass").limit(0), None, away
    for n in range(2, max(max_passes, 1) + 2) if verify else ():
        residue, unlocated, late = _residue(done, findings, book, values, extra, refusals, inspector, matchers, store, n, counted, runaway)
        refusals = refusals.unionByName(late)
        left = store.kept(residue, f"residue-{n}")
        if n > max_passes or left.isEmpty():
            break
        done = store.kept(counted(_apply(done, left, n), f"masked {n}"), f"pages-{n}")
        findings = findings.unionByName(left.withColumn("pass", F.lit(n)))
    problems = refusals.select("doc_id", "page", F.concat(F.col("rule_description"), F.lit(" matched "), F.col("n").cast("string"), F.lit(" times on one page and was refused")).alias("problem"))
    problems = problems.unionByName(left.select("doc_id", "page", F.concat(F.col("rule_description"), F.lit(" can still be read")).alias("problem")))
    problems = problems.unionByName(done.filter("misplaced > 0").select("doc_id", "page", F.concat(F.col("misplaced").cast("string"), F.lit(" ranges hold another text; they were not masked")).alias("problem")))
    if unlocated is not None:
        problems = problems.unionByName(unlocated.select("doc_id", "page", F.lit("the inspector reports a value that is not found on the page").alias("problem")))
    if wrong is not None:
        problems = problems.unionByName(wrong.select("doc_id", "page", F.lit("a proposal's range holds another text; it was not masked").alias("problem")))
    problems = store.kept(problems, "problems")
    if progress is not None:
        progress.finished()
    status = F.when(F.col("n") > 0, "redacted").when(~F.col("readable"), "not_examined").otherwise("no_matches")
    stay = [F.filter("annotations", lambda a, i: ~F.array_contains("gone", i)).alias("annotations")] if noted else []
    out = done.select("doc_id", "page", "text", status.alias("status"), F.col("n").alias("items"), "passes", F.when(status == "not_examined", "no text layer").alias("reason"), *stay)
    doomed = _doomed(findings).groupBy("doc_id", "page", "annotation").agg(F.min_by("place", F.struct("pass", "place")).alias("place"))
    if noted:
        texts = done.select("doc_id", "page", F.posexplode(_strings(F.col("annotations"))).alias("at", "value")).withColumn("place", F.col("at") + 1)
        doomed = doomed.join(texts, ["doc_id", "page", "place"]).select("doc_id", "page", "annotation", "value")
    else:
        doomed = doomed.select("doc_id", "page", "annotation", F.lit("").alias("value"))
    return Redaction(out, findings, store.kept(doomed, "annotations"), problems, documents(out, problems, hold, left), store.folder)


ONE = "array<struct<rule_line:int,rule_description:string,start:int,stop:int,matched_text:string,origin:string>>"
AWAY = "array<struct<rule_line:int,rule_description:string,n:long>>"


def _first(base: DataFrame, book: RuleBook | None, matchers: Matchers | None, more: list[DataFrame], notes: DataFrame | None, runaway: int | None) -> DataFrame:
    """The first pass: pages masked, with the spans found on them and the rules refused there.

    What rules find is masked in the projection that finds it; only spans that come from elsewhere (values of plans, reviewers, many
    literals) and annotations are joined, and only if there are any.
    """
    carry = ("annotations",) if "annotations" in base.columns else ()
    pages = page_spans(base, book, carry=carry, matchers=matchers)

    def much(s: Column) -> Column:
        return F.lit(False) if runaway is None else F.size(s["spans"]) > runaway

    kept = F.filter("sources", lambda s: ~much(s))

    def rows(s: Column) -> Column:
        return F.transform(s["spans"], lambda m: F.struct(s["rule_line"], s["rule_description"], m["start"], m["stop"], m["matched_text"], F.lit("rule")))

    away = F.transform(F.filter("sources", much), lambda s: F.struct(s["rule_line"], s["rule_description"], F.size(s["spans"]).cast("long")))
    pages = pages.select("doc_id", "page", *carry, F.col("n").alias("text"), has_text(F.col("text")).alias("readable"), F.flatten(F.transform(kept, rows)).cast(ONE).alias("found"), away.cast(AWAY).alias("away"))
    if more:
        joined = reduce(lambda a, b: a.unionByName(b), (m.select(*FOUND) for m in more))
        grouped = joined.groupBy("doc_id", "page").agg(F.collect_list(F.struct("rule_line", "rule_description", "start", "stop", "matched_text", "origin")).cast(ONE).alias("more"))
        pages = pages.join(grouped, ["doc_id", "page"], "left").withColumn("found", F.concat("found", F.coalesce("more", F.array().cast(ONE)))).drop("more")
    gone = F.array().cast("array<int>")
    if notes is not None:
        doomed = _doomed(notes).groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("annotation")).alias("noted"))
        pages, gone = pages.join(doomed, ["doc_id", "page"], "left"), F.coalesce("noted", gone)
    pages = pages.select("doc_id", "page", *carry, "text", "readable", "away", "found", gone.alias("gone"))
    right = F.filter("found", lambda m: _holds(F.col("text"), m))
    checked = pages.withColumn("right", right).withColumn("ranges", F.transform("right", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"))))
    items = (F.size("right") + F.size("gone")).cast("long")
    return checked.select(
        "doc_id", "page", *carry, masked(F.col("text"), F.col("ranges")).alias("text"), "readable", merged(F.col("ranges")).alias("cover"), F.when(items > 0, 1).otherwise(0).alias("passes"), items.alias("n"),
        (F.size("found") - F.size("right")).alias("misplaced"), "gone", "found", "away",
    )


def _holds(text: Column, m: Column) -> Column:
    """Whether a span's range holds its recorded text."""
    return F.substring(text, m["start"] + F.lit(1), m["stop"] - m["start"]) == m["matched_text"]


def _strings(annotations: Column) -> Column:
    """Both strings of each annotation, in order: that of annotation i are at 2 i and 2 i + 1."""
    return F.flatten(F.transform(F.coalesce(annotations, F.array().cast("array<struct<value:string,contents:string>>")), lambda a: F.array(a["value"].cast("string"), a["contents"].cast("string"))))


def _places(pages: DataFrame) -> DataFrame:
    """(doc_id, page, place, text): a page's text at place 0, and the strings of its annotations at the places from 1 on."""
    if "annotations" not in pages.columns:
        return pages.select("doc_id", "page", F.lit(0).alias("place"), "text")
    places = F.concat(F.array("text"), _strings(F.col("annotations")))
    each = pages.select("doc_id", "page", F.posexplode(places).alias("place", "text"))
    return each.filter("place = 0 or text <> ''")


def _doomed(found: DataFrame) -> DataFrame:
    return found.filter("place > 0").withColumn("annotation", F.expr("cast((place - 1) div 2 as int)"))


def _hits(places: DataFrame, book: RuleBook | None, values: DataFrame | None, extra: DataFrame | None, matchers: Matchers | None) -> DataFrame:
    """Spans of rules and values in all places; in annotations also of the texts of extra spans, which have a range on the page only."""
    out = None
    if book is not None:
        out = spans(places, book, carry=("place",), matchers=matchers).withColumn("origin", F.lit("rule")).select(*FOUND)
    if values is not None:
        own = value_spans(places, values)
        out = own if out is None else out.unionByName(own)
    if extra is not None:
        noted = value_spans(places.filter("place > 0"), extra.select("doc_id", F.col("matched_text").alias("value"))).withColumn("rule_description", F.lit("proposal")).withColumn("origin", F.lit("proposal"))
        noted = noted.unionByName(extra)
        out = noted if out is None else out.unionByName(noted)
    return out.select(*FOUND)


def _refused(found: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(spans that count, (page, rule) pairs refused): only rules can run away, and only on the text of a page."""
    if limit is None:
        return found.select(*FOUND), found.select("doc_id", "page", "rule_line", "rule_description", F.lit(0).cast("long").alias("n")).limit(0)
    away = refused(found.filter("place = 0 and origin = 'rule'").withColumn("source_kind", F.lit("rule")), limit)[1].drop("source_kind")
    keys = away.select("doc_id", "page", "rule_line", F.lit(0).alias("place"), F.lit("rule").alias("origin"))
    return found.join(keys, ["doc_id", "page", "rule_line", "place", "origin"], "left_anti").select(*FOUND), away


def value_spans(pages: DataFrame, values: DataFrame) -> DataFrame:
    """All occurrences in a document's places of its own values (doc_id, value), in any case. A document's values are as few as its plan."""
    own = values.groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    places = pages if "place" in pages.columns else pages.withColumn("place", F.lit(0))
    base = with_pages(places, ("place",)).join(own, "doc_id").select("doc_id", "page", "place", normalized(F.col("text")).alias("t"), F.explode("values").alias("v"))
    hit = base.select("doc_id", "page", "place", "v", F.explode(literal_hits(F.col("t"), F.col("v"), False, 0)).alias("m"))
    return hit.select("doc_id", "page", "place", F.lit(0).alias("rule_line"), F.lit("plan value").alias("rule_description"), "m.start", "m.stop", "m.matched_text", F.lit("plan").alias("origin"))


def _residue(
    done: DataFrame, findings: DataFrame, book: RuleBook | None, values: DataFrame | None, extra: DataFrame | None, away: DataFrame, inspector: Callable[[DataFrame], DataFrame] | None, matchers: Matchers | None, store: Store, n: int, counted: Callable[[DataFrame, str], DataFrame], runaway: int | None
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """What is still found in what would be written, outside the ranges masked so far; what an inspector reports but no page holds; rules refused only now.

    Refused (page, rule) pairs stay refused in every pass.
    """
    read = done.filter("n > 0")
    if "annotations" in done.columns:  # those that are gone keep their number, without strings
        read = read.withColumn("annotations", F.transform("annotations", lambda a, i: F.when(~F.array_contains("gone", i), a)))
    places = _places(counted(read, f"read back {n - 1}"))
    seen, late = _refused(store.kept(_hits(places, book, values, extra, matchers), f"spans-{n}"), runaway)
    late = store.kept(late.join(away.select("doc_id", "page", "rule_line").distinct(), ["doc_id", "page", "rule_line"], "left_anti").select(*away.columns), f"refused-{n}")
    known = away.select("doc_id", "page", "rule_line", F.lit(0).alias("place"), F.lit("rule").alias("origin")).distinct()
    seen = seen.join(known, ["doc_id", "page", "rule_line", "place", "origin"], "left_anti").select(*FOUND)
    unlocated = None
    if inspector is not None:
        meant = findings.groupBy("doc_id").agg(F.collect_set("matched_text").alias("meant"))
        reports = inspector(done.select("doc_id", "page", "text")).select("doc_id", "page", "value").distinct().join(meant, "doc_id").filter(worth_acting_on(F.col("value"), F.col("meant")))
        reports = store.kept(reports.select("doc_id", "page", "value"), f"reports-{n}")
        placed = reports.join(_places(read.unionByName(done.filter("n <= 0"))), ["doc_id", "page"], "left").withColumn("hits", F.coalesce(literal_hits(normalized(F.coalesce("text", F.lit(""))), F.col("value"), False, 0), F.array()))
        unlocated = placed.groupBy("doc_id", "page", "value").agg(F.sum(F.size("hits")).alias("k")).filter("k = 0").select("doc_id", "page", "value")
        hit = placed.select("doc_id", "page", "place", F.explode("hits").alias("m"))
        seen = seen.unionByName(hit.select("doc_id", "page", "place", F.lit(0).alias("rule_line"), F.lit("inspector").alias("rule_description"), "m.start", "m.stop", "m.matched_text", F.lit("inspector").alias("origin")))
    with_cover = seen.join(done.select("doc_id", "page", "cover"), ["doc_id", "page"])
    hidden = (F.col("place") == 0) & F.exists("cover", lambda c: (c["start"] <= F.col("start")) & (F.col("stop") <= c["stop"]))
    return with_cover.filter(~hidden).withColumn("origin", F.when(F.col("origin") == "inspector", "inspector").otherwise("residue")).select(*FOUND), unlocated, late


def _apply(base: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """base with text masked and annotations gone, the ranges masked so far, the last pass that did something, and n, the number of items.

    A range that does not hold its recorded text is not masked; misplaced counts those. A page's spans are bounded by its text.
    """
    on_page = F.when(F.col("place") == 0, F.struct("start", "stop", "matched_text"))
    doomed = F.when(F.col("place") > 0, F.expr("cast((place - 1) div 2 as int)"))
    grouped = found.groupBy("doc_id", "page").agg(F.collect_list(on_page).alias("spans"), F.collect_set(doomed).alias("more_gone"))
    joined = base.join(grouped, ["doc_id", "page"], "left").withColumn("new", F.col("spans").isNotNull())
    spans_here, more = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int,matched_text:string>>")), F.coalesce("more_gone", F.array().cast("array<int>"))
    rest = [c for c in base.columns if c not in ("text", "cover", "passes", "n", "misplaced", "gone")]

    checked = joined.withColumn("right", F.filter(spans_here, lambda m: _holds(F.col("text"), m))).withColumn("ranges", F.transform("right", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"))))
    fresh = F.array_except(more, F.col("gone"))
    return checked.select(
        *rest, F.when(F.size("ranges") > 0, masked(F.col("text"), F.col("ranges"))).otherwise(F.col("text")).alias("text"),
        F.when(F.size("ranges") > 0, merged(F.concat("cover", "ranges"))).otherwise(F.col("cover")).alias("cover"),
        F.when(F.col("new"), number).otherwise(F.col("passes")).alias("passes"), (F.col("n") + F.size("right") + F.size(fresh)).alias("n"),
        (F.col("misplaced") + F.size(spans_here) - F.size("right")).alias("misplaced"), F.array_union("gone", more).alias("gone"),
    )


def redact_plan(pages: DataFrame, items: DataFrame, book: RuleBook | None = None, **options) -> Redaction:
    """Run a plan as a person left it: the ticked values of each document's items (source_name is its doc_id) go, and nothing that is not ticked.

    A plan without a usable ticked value refuses to run. Values that cannot be used are reported as problems.
    """
    used, refused_values = plan.usable_values(items)
    if used.isEmpty():
        raise plan.EmptyPlan("no ticked value of the plan can be used")
    kind = pages.schema["doc_id"].dataType
    out = redact(pages, book, values=used.select(F.col("source_name").cast(kind).alias("doc_id"), "value"), **options)
    unused = refused_values.select(F.col("source_name").cast(kind).alias("doc_id"), F.lit(None).cast("int").alias("page"), F.lit("a ticked value is too short to be used").alias("problem"))
    out.problems = out.problems.unionByName(unused)
    return out


def committed(result: Redaction, staging: str, final: str, hold: bool = False) -> str | None:
    """Stage the pages and move them to their place if every document is settled as written (or if they are held for review).

    Refuses with NothingMatched where there is nothing to remove. Returns the final path, or nothing if the copy was withdrawn.
    """
    state = result.documents.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.count_if(F.col("n_problems") > 0).alias("bad")).first()
    if not state["items"]:
        raise NothingMatched("no rule matched anything")
    return published(result.pages, staging, final, verified=state["bad"] == 0, hold=hold)


def copied(result: Redaction, root: str, hold: bool = False, source: str | None = None, buckets: int = copies.BUCKETS) -> int | None:
    """Put a run's pages among the copies at root, in place of earlier copies of the same documents; the version's number, or nothing if the run was withdrawn.

    Refuses with NothingMatched where there is nothing to remove, and never writes to the source.
    """
    state = result.documents.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.count_if(F.col("n_problems") > 0).alias("bad")).first()
    if not state["items"]:
        raise NothingMatched("no rule matched anything")
    if state["bad"] and not hold:  # the read-back has said already that nothing of it may be seen
        return None
    run = copies.staged(result.pages, root, buckets=buckets, source=source)
    return copies.published(result.pages.sparkSession, run, verified=state["bad"] == 0, hold=hold)


def documents(pages: DataFrame, problems: DataFrame, hold: bool = False, left: DataFrame | None = None) -> DataFrame:
    """One row a document: items, pages redacted, worst pass, pages not examined, distinct residue in order, disposition and whether it is settled."""
    whole = pages.groupBy("doc_id").agg(
        F.sum("items").alias("items"), F.count_if(F.col("status") == "redacted").alias("pages_redacted"), F.max("passes").alias("worst_pass"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "not_examined", F.col("page")))).alias("unexamined_pages"),
    )
    bad = problems.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_problems"))
    out = whole.join(bad, "doc_id", "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))
    none = F.array().cast("array<string>")
    if left is None:
        out = out.withColumn("residue", none)
    else:
        rest = left.groupBy("doc_id").agg(F.array_sort(F.collect_set("matched_text")).alias("residue"))
        out = out.join(rest, "doc_id", "left").withColumn("residue", F.coalesce("residue", none))
    unverified = F.lit("written_unverified" if hold else "failed")
    disposition = F.when(F.col("items") == 0, "nothing_matched").when(F.col("n_problems") == 0, "written").otherwise(unverified)
    settled = (disposition == "written") & (F.size("unexamined_pages") == 0)
    return out.select("*", disposition.alias("disposition"), settled.alias("is_settled"))


def flags(documents: DataFrame) -> DataFrame:
    """One row a run: whether all documents are settled, and whether any failed, is held unverified, or has pages not examined."""
    return documents.agg(
        F.coalesce(F.every("is_settled"), F.lit(False)).alias("all_settled"), F.coalesce(F.some(F.col("disposition") == "failed"), F.lit(False)).alias("any_failed"),
        F.coalesce(F.some(F.col("disposition") == "written_unverified"), F.lit(False)).alias("any_unverified"), F.coalesce(F.some(F.size("unexamined_pages") > 0), F.lit(False)).alias("any_unexamined"),
    )
