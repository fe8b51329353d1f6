"""A user's own matchers: Arrow functions over batches of texts, registered by name and used like the fixed categories.

A rule book names a matcher by its name; its spans go through the same overlap rules, refusal, masking, plans and
reports as all others, because they are one more array of the projection that spans() builds. In SQL a matcher is a
table function over pages (register()), whose columns follow from the table it is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

RANGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("matched_text", pa.string())]))
RANGES_DDL = "array<struct<start:int,stop:int,matched_text:string>>"
Range = tuple[int, int]


class OutOfText(ValueError):
    """A matcher reports a range that its text does not have: masking it would hide something else."""


def checked(name: str, find: Callable[[list[str]], list[list[Range]]], texts: list[str]) -> list[list[Range]]:
    """What find says of texts: as many lists as texts, each within its text, none empty, in order."""
    found = find(texts)
    if len(found) != len(texts):
        raise OutOfText(f"{name}: {len(found)} answers to {len(texts)} texts")
    for text, own in zip(texts, found, strict=True):
        for a, b in own:
            if not 0 <= a < b <= len(text):
                raise OutOfText(f"{name}: {a} to {b} of {len(text)} characters")
    return [sorted(own) for own in found]


@dataclass(frozen=True)
class Matcher:
    """find: gets a batch of normalised texts and gives each one's ranges, half-open, in code points.

    gate: a string that must stand in a text, else find never sees it. accept: given a value (a column), whether it
    counts; a value that does not is dropped and not looked for again. refine: given a span (start, stop, matched_text),
    the start and stop to report, within it; a span that it empties or widens is dropped. overlaps: 'all' keeps all spans, 'distinct' one of equal
    ranges, 'widest' only the widest of an overlapping run.
    """

    name: str
    find: Callable[[list[str]], list[list[Range]]]
    gate: str | None = None
    accept: Callable[[Column], Column] | None = None
    refine: Callable[[Column], tuple[Column, Column]] | None = None
    overlaps: str = "all"

    @property
    def description(self) -> str:
        return self.name

    def ranges(self, texts: list[str]) -> list[list[Range]]:
        return checked(self.name, self.find, texts)

    def found(self, text: Column) -> Column:
        """What find says of a page, as a column of its own: an Arrow function cannot stand within other expressions' lambdas."""

        name, find = self.name, self.find  # workers need no more of the matcher

        def run(texts: pa.Array) -> pa.Array:
            there = [i for i, t in enumerate(texts.to_pylist()) if t is not None]
            out: list[list[dict] | None] = [None] * len(texts)
            values = [texts[i].as_py() for i in there]
            for i, text, own in zip(there, values, checked(name, find, values) if values else (), strict=True):
                out[i] = [{"start": a, "stop": b, "matched_text": text[a:b]} for a, b in own]
            return pa.array(out, RANGES)

        return F.arrow_udf(run, RANGES_DDL)(text if self.gate is None else F.when(F.contains(text, F.lit(self.gate)), text))

    def hits(self, raw: Column) -> Column:
        """Spans of a page, like those of a fixed category, from the column that found() made."""
        from veilspark.operators.spans import SPAN, _compare, first_of_equal_ranges, widest_of_overlapping

        def span(start: Column, stop: Column, value: Column) -> Column:
            return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), value.alias("matched_text"), F.lit(0).alias("engine_no"))

        def refined(m: Column) -> Column:  # cut from the value, not from the page, whose start may be far away
            start, stop = self.refine(m)
            within = (start >= m["start"]) & (stop > start) & (stop <= m["stop"])
            return F.when(within, span(start, stop, F.substring(m["matched_text"], start - m["start"] + F.lit(1), stop - start)))

        found = F.transform(F.coalesce(raw, F.array().cast(RANGES_DDL)), lambda r: span(r["start"], r["stop"], r["matched_text"]))
        if self.accept is not None:
            found = F.filter(found, lambda m: F.coalesce(self.accept(m["matched_text"]), F.lit(False)))
        if self.refine is not None:
            found = F.filter(F.transform(found, refined), lambda m: m.isNotNull())
        found = found.cast(SPAN)
        if self.overlaps == "widest":
            return widest_of_overlapping(found)
        if self.overlaps == "distinct":
            return first_of_equal_ranges(found)
        return F.array_sort(found, lambda a, b: _compare(a, b, "start", "stop", "engine_no"))


@dataclass
class Matchers:
    """Matchers by name. Names are folded like category names and must not be those of fixed categories."""

    by_name: dict[str, Matcher] = field(default_factory=dict)

    def add(self, matcher: Matcher) -> Matchers:
        from veilspark.sources.rules import CATEGORIES

        taken = {a for names in CATEGORIES.values() for a in names} | set(CATEGORIES)
        if matcher.name in self.by_name or " ".join(matcher.name.lower().split()) in taken:
            raise ValueError(f"{matcher.name} is taken")
        if matcher.overlaps not in ("all", "distinct", "widest"):
            raise ValueError(matcher.overlaps)
        self.by_name[matcher.name] = matcher
        return self

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.by_name)

    def named(self, book) -> dict[str, Matcher]:
        """The matchers that a rule book names."""
        return {c: self.by_name[c] for c in book.categories if c in self.by_name}


FOUND = (T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("matched_text", T.StringType()))


def register(spark: SparkSession, matchers: Matchers, name: str = "find_spans") -> None:
    """SELECT * FROM find_spans(TABLE(pages), 'matcher'): each page's columns but its text, then start, stop, matched_text.

    accept and refine are column expressions and take no part here; ranges are in the text as it is given.
    """
    held = {m.name: m.find for m in matchers.by_name.values()}

    class FindSpans:
        def __init__(self, analyzed: AnalyzeResult | None = None):
            self.columns = [f.name for f in analyzed.schema.fields[:-3]] if analyzed else []

        @staticmethod
        def analyze(pages: AnalyzeArgument, matcher: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable or "text" not in pages.dataType.names:
                raise ValueError("the first argument is a table with a column text")
            if not matcher.isConstantExpression or matcher.value not in held:
                raise ValueError(f"no matcher goes by this name; there are {', '.join(sorted(held)) or 'none'}")
            kept = [f for f in pages.dataType.fields if f.name != "text"]
            return AnalyzeResult(T.StructType([*kept, *FOUND]))

        def eval(self, row, matcher: str) -> Iterator[tuple]:
            text = row["text"]
            if text is not None:
                for a, b in checked(matcher, held[matcher], [text])[0]:
                    yield (*(row[c] for c in self.columns), a, b, text[a:b])

    spark.udtf.register(name, F.udtf(FindSpans))
