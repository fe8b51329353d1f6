"""Values proposed by a model or a person: chunking, filters in order, location on pages, overlap with rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import proposals as P
from veilspark.functions.text import normalized
from veilspark.operators.intervals import touched
from veilspark.operators.spans import literal_hits, with_pages

CHUNK = 1200
LEAST_CHUNK = 240
PROPOSAL = "text string, kind string, reason string, n_unread int"


class TooLong(Exception):
    """A proposer raises this when a chunk does not fit its window; the chunk is halved and asked again."""


def chunks(text: str, most: int = CHUNK) -> list[str]:
    """Whole lines packed greedily; an over-long line stays whole; joined by newlines they give the text back."""
    if len(text) <= most:
        return [text] if text else []
    out, held = [], None
    for line in text.split("\n"):
        if held is None:
            held = line
        elif len(held) + 1 + len(line) > most:
            out.append(held)
            held = line
        else:
            held += "\n" + line
    return [*out, held]


def chunked(pages: DataFrame, most: int = CHUNK) -> DataFrame:
    """doc_id, page, number (from 0), chunk: each page's chunks()."""
    base = with_pages(pages)
    schema = T.StructType([*base.select("doc_id", "page").schema.fields, *T._parse_datatype_string("number int, chunk string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, page, k, c) for doc, page, text in zip(pdf["doc_id"], pdf["page"], pdf["text"], strict=True) for k, c in enumerate(chunks(text, most))]
            yield pd.DataFrame(rows, columns=schema.names)

    return base.mapInPandas(run, schema)


def halves(text: str) -> tuple[str, str] | None:
    """Cut at the line break nearest the middle, else at white space, else in the middle."""
    middle = len(text) // 2
    if len(text) < 2:
        return None
    for fits in (lambda c: c in "\n\r\x0b\x0c\x85\u2028\u2029", str.isspace):
        near = sorted((abs(i - middle), i > middle, i) for i in range(1, len(text)) if fits(text[i]) and abs(i - middle) < middle)
        if near:
            return text[: near[0][2]], text[near[0][2] :]
    return text[:middle], text[middle:]


def _asked(text: str, propose: Callable[[str], list[tuple[str, str, str]]]) -> tuple[list[tuple[str, str, str]], int]:
    """What propose says about a chunk, and how many characters stayed too long for it."""
    try:
        return propose(text), 0
    except TooLong:
        cut = halves(text) if len(text) > LEAST_CHUNK else None
        if cut is None:
            return [], len(text)
        (a, m), (b, n) = (_asked(half, propose) for half in cut)
        return a + b, m + n


def proposed(pages: DataFrame, propose: Callable[[str], list[tuple[str, str, str]]]) -> DataFrame:
    """doc_id, page, text, kind, reason, n_unread: what propose says about each chunk, one row a distinct text of a page.

    A page with characters that no chunk could bring to propose has one more row, without text, that tells how many.
    """
    base = with_pages(pages)
    schema = T.StructType([*base.select("doc_id", "page").schema.fields, *T._parse_datatype_string(PROPOSAL).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, text in zip(pdf["doc_id"], pdf["page"], pdf["text"], strict=True):
                seen: set[str] = set()
                unread = 0
                for chunk in chunks(text):
                    said, missed = _asked(chunk, propose)
                    unread += missed
                    for value, kind, reason in said:
                        if value.strip() not in seen:
                            seen.add(value.strip())
                            rows.append((doc, page, value, kind, reason, 0))
                if unread:
                    rows.append((doc, page, None, None, None, unread))
            yield pd.DataFrame(rows, columns=schema.names)

    return base.mapInPandas(run, schema)


def spans_of_proposals(pages: DataFrame, propose: Callable[[str], list[tuple[str, str, str]]], found: DataFrame, residue: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans for redact()'s extra, proposals not located, pages not fully read): propose, filter, locate, drop what rules cover."""
    rows = stored_rows(proposed(pages, propose))
    asked = filtered(rows.filter("n_unread = 0").drop("n_unread"), residue)
    placed, unlocated = located(without_rule_hits(asked, found), pages)
    return not_covered(placed, found), unlocated, rows.filter("n_unread > 0").select("doc_id", "page", "n_unread")


def stored_rows(rows: DataFrame) -> DataFrame:
    """A proposer may be dear and may answer otherwise the next time: its rows are asked for once and stored."""
    from veilspark.sources.tables import Store

    return Store(rows.sparkSession).kept(rows, "proposals")


def filtered(rows: DataFrame, residue: bool = False) -> DataFrame:
    """Proposals worth acting on. Residue must look like a value before its caption goes, first passes after."""
    if residue:
        rows = rows.filter(P.looks_like_a_value(F.col("text")))
    rows = rows.withColumn("text", P.value_without_label(F.col("text")))
    text, kind = F.col("text"), F.coalesce("kind", F.lit(""))
    bad = P.is_not_identifying(text) | P.is_too_slight(text) | ~P.is_allowed_kind(kind) | P.is_excluded_kind(kind) | P.is_implausible_name(text, kind) | P.is_implausible_identifier(text, kind)
    return rows.filter(~bad)


def located(rows: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, unlocated): proposals found as text on their page, each non-overlapping occurrence a span."""
    base = with_pages(pages).select("doc_id", "page", normalized(F.col("text")).alias("n"))
    joined = rows.join(base, ["doc_id", "page"]).withColumn("hits", literal_hits(F.col("n"), F.col("text"), False, 0))
    spans = joined.select("doc_id", "page", "text", "kind", F.explode("hits").alias("s")).select("doc_id", "page", "text", "kind", "s.start", "s.stop", "s.matched_text")
    return spans, joined.filter(F.size("hits") == 0).select(rows.columns)


def not_covered(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates that overlap no rule's span on their page: an interval anti join by a sweep, which a hot page does not make quadratic."""
    return touched(candidates, found).filter(~F.col("touched")).drop("touched")


def without_rule_hits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Proposals that are not merely a rule's value with a caption."""
    rule = found.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("matched_text").alias("m")).distinct()
    same = (rows["doc_id"] == rule["d"]) & (rows["page"] == rule["p"]) & P.is_rule_hit_with_caption(rows["text"], rule["m"])
    return rows.join(rule, same, "left_anti")
