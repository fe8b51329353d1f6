"""Operator 12: audit of how filters interact, by multilinear extensions.

Each document becomes a bit mask of the filters that it fails; documents are counted by part and mask, so what follows
is as small as parts x masks. If filter i is applied with probability x_i, independently, the expected number of
documents removed from a part is a polynomial without squares,

    f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)),

whose coefficient at the monomial of a set T of filters is (-1)^(|T|+1) times the documents that fail all of T. At a
corner, where each x_i is 0 or 1, f is what that set of filters removes; along the diagonal x_1 = ... = x_n = t the
integral of its i-th partial derivative is the Shapley value of filter i. The integral of c * t^(k-1) is c / k, and n!
is a multiple of each k, so n! times the value is a whole number: the documents that the filter removes, summed over
all orders. The same polynomial over labelled documents tells what is lost of them.

All of it is DataFrame work: one pass over the texts that keeps a row of flags a document, one aggregation that finds
each text's least doc_id (by digest, with partial minima), a join of flags with those on digest and doc_id, which no
copy makes hot, and sums by part and mask that are combined before they are shuffled.

Defined results: a null text is empty, a null source the part ''; an empty text fails what its counts say (A, not B, C
or D); a null doc_id has no smaller one and no labels; rows that repeat a doc_id each count, and none is smaller than
the other; labels that repeat a doc_id count once, and are good or toxic if one of them says so; an empty table gives no
rows. Columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import let, literal_array, stored

BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Filter:
    """name: one letter; fails: given the statistics of facts() (columns), whether a document fails; null counts as not."""

    name: str
    fails: Column


def facts(text: Column) -> Column:
    """n_words, n_distinct, n_upper, n_chars, symbols (any of #$%&*|) of a text."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    return F.struct(
        sizes["n"].alias("n_words"), sizes["d"].alias("n_distinct"), (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("n_upper"),
        F.length(text).alias("n_chars"), F.rlike(text, F.lit("[#$%&*|]")).alias("symbols"),
    )


def five() -> tuple[Filter, ...]:
    """A: short; B: repeats its words; C: capitals; D: symbols; E: a copy of a document with a smaller doc_id."""
    c = F.col
    return (
        Filter("A", c("n_words") < 200), Filter("B", 100 * c("n_distinct") < 50 * c("n_words")), Filter("C", 100 * c("n_upper").cast("long") > 2 * c("n_chars").cast("long")),
        Filter("D", c("symbols")), Filter("E", c("copied")),
    )


def failures(docs: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """doc_id, part, mask: one row a document; bit i of mask is set if it fails filter i."""
    text = F.coalesce("text", F.lit(""))
    flags = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), facts(text).alias("facts"))
    flags = stored(flags.select("doc_id", "part", "digest", "facts.*"), "filter-flags")
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = flags.join(first, ["digest", "doc_id"], "left").withColumn("copied", F.col("first").isNull() & F.col("doc_id").isNotNull())
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.when(f.fails, 1 << i).otherwise(0) for i, f in enumerate(filters)))
    return judged.select("doc_id", "part", mask.alias("mask"))


def polynomial(counts: Column, n: int) -> Column:
    """Coefficients of the removal polynomial by set of filters (a bit mask), from documents by mask: both have 2^n entries."""

    def coefficient(t: Column) -> Column:
        failing = F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda total, m: total + F.when(m.bitwiseAND(t) == t, F.get(counts, m)).otherwise(0))
        return F.when(t == 0, F.lit(0).cast("long")).when(F.bit_count(t) % 2 == 1, failing).otherwise(-failing)

    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), coefficient)


def at_corner(coefficients: Column, applied: Column, n: int) -> Column:
    """What a set of filters removes: the polynomial with x_i = 1 for the filters in it, and 0 for the others."""
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda total, t: total + F.when(t.bitwiseAND(applied) == t, F.get(coefficients, t)).otherwise(0))


def scaled_shapley(coefficients: Column, bit: Column, n: int) -> Column:
    """n! times the integral of the partial derivative to one variable along the diagonal: exact, in whole numbers."""
    weights = literal_array([0] + [factorial(n) // k for k in range(1, n + 1)], "long")  # n! / |T|, the integral of t^(|T|-1) scaled
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda total, t: total + F.when(t.bitwiseAND(bit) != 0, F.get(coefficients, t) * F.get(weights, F.bit_count(t))).otherwise(0))


def by_mask(failed: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """part, every, good, toxic: documents by mask, as arrays of 2^n counts."""
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = failed.join(marks, "doc_id", "left")
    counted = known.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("every"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    held = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("every", "good", "toxic")))).alias("by"))  # at most 2^n entries

    def counts(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: F.coalesce(F.try_element_at("by", m)[name], F.lit(0).cast("long"))).alias(name)

    return held.select("part", counts("every"), counts("good"), counts("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] | None = None) -> DataFrame:
    """One row for each part, order of all filters and step in it: what stays, what goes here and why, and the filter's Shapley value times n!."""
    filters = tuple(filters or five())
    n, names = len(filters), "".join(f.name for f in filters)
    if n > 6 or len(set(names)) != n or len(names) != n:
        raise ValueError("an audit takes up to six filters with one letter each: all their orders are reported")
    parts = by_mask(failures(docs, filters), labels, n)
    grown = parts.select("part", F.aggregate("every", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), *(polynomial(F.col(c), n).alias(c) for c in ("every", "good", "toxic")))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(names))), ",")
    steps = grown.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    def bits(upto: Column) -> Column:
        """The filters of an order's first steps, as a mask."""
        letters = F.when(upto > 0, F.sequence(F.lit(1), F.greatest(upto, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(letters, F.lit(0), lambda m, k: m + F.call_function("shiftleft", F.lit(1), (F.instr(F.lit(names), F.substring("filter_order", k, F.lit(1))) - 1).cast("int")))

    placed = steps.select("*", bits(F.col("step") - 1).alias("before"), bits(F.col("step").cast("int")).alias("after"))
    placed = placed.withColumn("own", F.col("after") - F.col("before"))

    def here(c: str) -> Column:
        return at_corner(F.col(c), F.col("after"), n) - at_corner(F.col(c), F.col("before"), n)

    full = F.lit((1 << n) - 1)
    valued = placed.select(
        "part", "filter_order", "step", (F.col("total") - at_corner(F.col("every"), F.col("after"), n)).alias("kept"), here("every").alias("removed"),
        at_corner(F.col("every"), F.col("own"), n).alias("failing"), (at_corner(F.col("every"), full, n) - at_corner(F.col("every"), full - F.col("own"), n)).alias("unique_fails"),
        here("good").alias("good_lost"), here("toxic").alias("toxic_lost"), scaled_shapley(F.col("every"), F.col("own"), n).alias("shapley"),
    )
    return valued.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
