"""Operator 2: learned decision lists over text statistics (native).

Statistics of each whole text are computed in one projection. Sequential covering then learns,
from the labelled rows, an ordered list of conjunctions of thresholds that mark bad documents:
a rule is grown condition by condition on the growing rows by information gain, pruned from
its end on the pruning rows, kept if it is precise there, and the rows it covers are set aside.
Each step is one aggregation of all labelled rows into counts by feature, bin and label, of which
the driver sees at most features x bins x 4 numbers. The list becomes one Spark CASE expression.

Defined results: a null or empty text has no words, so n_words = 0 and base_failed; repeated
rows are judged each by its own text; an empty table gives no rows; without labels (none, or of
one class) no rule is learned and every document that the base rules keep is kept; labels that are
null or other than 0 and 1 are ignored, as are columns other than doc_id and text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import let, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Features the rules may test, as expressions over the statistics; none falls or rises with length alone.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
}
BINS = 32


def _count_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of 8 that occur twice or more; hashes: an array with a hash for each word."""

    def covered(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def among(s: Column) -> Column:
            def same(i: Column, step: int) -> Column:
                return F.coalesce(F.get(s, i)["h"] == F.get(s, i + F.lit(step))["h"], F.lit(False))

            twice = F.filter(F.transform(s, lambda x, i: F.when(same(i, -1) | same(i, 1), x["i"])), lambda x: x.isNotNull())
            return let(
                F.sort_array(twice),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(x - F.get(p, i - F.lit(1)), F.lit(WINDOW)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(tagged, among))

    last = F.size(hashes) - F.lit(WINDOW)
    windows = F.filter(F.transform(hashes, lambda h, i: F.when(i <= last, F.xxhash64(*(F.get(hashes, i + F.lit(k)) for k in range(WINDOW))))), lambda h: h.isNotNull())
    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


STATISTICS = ("n_words", "n_repeat_words", "word_chars", "n_lines", "n_dup_lines", "n_symbols", "n_upper")


def statistics_of(text: Column) -> Column:
    """A struct with the statistics of a whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def by_words(w: Column) -> Column:
        return let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.size(h).cast("long").alias("n_words"),
                _repeat_words(h).alias("n_repeat_words"),
            ),
        )

    def by_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    both = F.struct(let(words, by_words).alias("w"), let(lines, by_lines).alias("l"), _count_of(text, r"[#*$%&|<>]+").alias("n_symbols"), _count_of(text, r"\p{Lu}+").alias("n_upper"))

    def flat(x: Column) -> Column:
        inner = [(x["w"], k) for k in STATISTICS[:3]] + [(x["l"], k) for k in STATISTICS[3:5]] + [(x, k) for k in STATISTICS[5:]]
        return F.struct(*(c[k].alias(k) for c, k in inner))

    return let(both, flat)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    return docs.select("doc_id", statistics_of(F.col("text")).alias("s")).select("doc_id", "s.*")


@dataclass(frozen=True)
class Condition:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of narrowing p0 bad and n0 good rows down to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.9, least_bad: int = 3) -> list[Rule]:
    """The ordered rules that mark bad documents (quality 0), learned from all labelled rows."""
    label = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = F.array(*(F.expr(FEATURES[f]).cast("double") for f in FEATURES))
    usable = stats.filter("n_words >= 20")
    known = stored(
        usable.join(label, "doc_id").select(
            *(c for c in stats.columns if c != "doc_id"),
            (F.col("quality") == 0).alias("bad"),
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"),
        ),
        "labelled",
    )
    quantiles = known.agg(*(F.percentile_approx(F.expr(FEATURES[f]).cast("double"), [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES)).first()
    if quantiles[0] is None:
        return []
    cuts = {f: sorted(set(quantiles[f])) for f in FEATURES}

    def bin_of(i: int, f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c < F.get(values, F.lit(i))))

    bins = F.array(*(bin_of(i, f) for i, f in enumerate(FEATURES)))
    known = stored(known.withColumn("bins", bins), "labelled-bins")
    names = list(FEATURES)

    def counts(where: Column) -> dict:
        """Rows by feature, bin, label and part: a bounded table."""
        rows = known.filter(where).select("bad", "grow", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin", "bad", "grow").count().collect()
        return {(r["f"], r["bin"], r["bad"], r["grow"]): r["count"] for r in rows}

    def totals(c: dict, grow: bool) -> tuple[int, int]:
        return tuple(sum(v for k, v in c.items() if k[0] == 0 and k[2] == bad and k[3] == grow) for bad in (True, False))

    def centred(c: Condition, where: Column) -> Condition:
        """The threshold moved half-way towards the bad rows beyond it (all but their nearest twentieth), to leave
        good documents that are a little unusual alone."""
        x = F.expr(FEATURES[c.feature]).cast("double")
        near = known.filter(where & c.column() & F.col("bad")).agg(F.percentile_approx(x, 0.05 if c.above else 0.95, 10_000)).first()[0]
        return c if near is None else Condition(c.feature, c.above, (c.threshold + near) / 2)

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        path: list[tuple[Condition, tuple[int, int]]] = []
        where, now = left, counts(left)
        start = totals(now, False)
        while len(path) < max_conditions:
            p0, n0 = totals(now, True)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for i, f in enumerate(names):
                p = n = 0
                for k, cut in enumerate(cuts[f]):
                    p += now.get((i, k, True, True), 0)
                    n += now.get((i, k, False, True), 0)
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp >= least_bad and (g := _gain(pp, nn, p0, n0)) > best[0] + 1e-9:
                            best = (g, Condition(f, above, float(cut)))
            if best[1] is None:
                break
            chosen = centred(best[1], where)
            where = where & chosen.column()
            now = counts(where)
            path.append((chosen, totals(now, False)))
        if not path:
            break
        # Prune from the end: the shortest prefix with the best value on the pruning rows.
        worth = [(p - n) / (p + n) if p + n else -1.0 for _, (p, n) in path]
        keep = worth.index(max(worth)) + 1
        p, n = path[keep - 1][1]
        if p + n == 0 or p < least_precision * (p + n) or p * (start[0] + start[1]) <= start[0] * (p + n):
            break
        rules.append(Rule(tuple(c for c, _ in path[:keep]), p, n))
        left = left & ~rules[-1].column()
    return rules


def decision_list(rules: list[Rule]) -> tuple[Column, Column]:
    """Two Spark expressions over the statistics: the number of the first rule that fires (0: none), and its text."""
    number, text = F.lit(0), F.lit(None).cast("string")
    for i, rule in reversed(list(enumerate(rules, 1))):
        number, text = F.when(rule.column(), F.lit(i)).otherwise(number), F.when(rule.column(), F.lit(str(rule))).otherwise(text)
    return number, text


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: its statistics, base_failed, the rule that rejected it and kept."""
    stats = stored(statistics(docs), "quality")
    number, text = decision_list(learn(stats, labels))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (number == 0)).alias("kept"), number.alias("rule"), text.alias("rule_text"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rules and the learned rules keep, all columns unchanged.

    The statistics are stored beside their documents, so no document is joined or shuffled.
    """
    own = "quality_statistics"
    while own in docs.columns:
        own += "_"
    both = stored(docs.withColumn(own, statistics_of(F.col("text"))), "quality-docs")
    number, _ = decision_list(learn(both.select("doc_id", f"{own}.*"), labels))
    inner = both.select(F.struct(*docs.columns).alias("row"), f"{own}.*")
    return inner.filter(~base_failed() & (number == 0)).select("row.*")
