"""Rule books as tables: pages against any number of literals, each page by its own tenant's book.

Nothing of a book comes to the driver and nothing is broadcast. Literals and pages meet in an inverted join:

1. A literal is cut into grams, at one of LEVELS by its length, and so is each page, at the levels that literals use.
   Long literals need few grams: of each window of neighbouring grams only the one with the least hash is kept, and a text
   that holds the literal holds its windows, so it keeps the same grams.
2. Grams of pages that no literal has go in the first join. What is left is counted, each literal keeps its rarest
   gram (a literal with a gram that no page has is done), and the pages that hold this gram are its candidates.
3. Candidates meet their pages on (doc_id, page), and there the literal is matched for good, as exact rules are.

Grams are taken over letters folded one by one, so that texts that match in any case share them; all that is not ASCII
folds to one sign. Joins are plain equi joins over stored tables, which adaptive execution splits where a gram is hot.
The documents are read twice, however many literals there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import normalized
from veilspark.operators.spans import needle_hits, spans, with_pages
from veilspark.sources.rules import CATEGORIES, Rule, RuleBook, rules
from veilspark.sources.tables import Store

#: (least length of a literal, length of a gram, grams in a window): a literal has at least one whole window.
LEVELS = ((24, 12, 13), (8, 5, 4), (3, 3, 1), (1, 1, 1))
BATCH = 1 << 22  # characters looked at together
ALL = ""  # the book of pages without one


def folded_codes(text: str) -> np.ndarray:
    """Code points with A-Z and the four letters that match ASCII in another case folded, and all others as one sign."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
    for code, letter in ((0x212A, "k"), (0x17F, "s"), (0x130, "i"), (0x131, "i")):
        out[codes == code] = ord(letter)
    out[out > 127] = 1
    return out


def grams(codes: np.ndarray, level: int) -> np.ndarray:
    """Distinct hashes of a text's grams at a level, those that are least in some window of neighbours; none if it is too short."""
    _, q, width = LEVELS[level]
    n = len(codes) - q + 1
    if n < width:
        return np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(level + 1), dtype=np.uint64)
        for k in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    least, done = h, 1
    while done < width:  # minima of windows twice as wide each time
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return np.unique(least).view(np.int64)


def level_of(size: int) -> int:
    return next(i for i, (least, _, _) in enumerate(LEVELS) if size >= least)


def _repeated(batch: pa.RecordBatch, counts: list[int], new: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The batch's rows, each as often as counts says, with new columns."""
    take = pa.array(np.repeat(np.arange(batch.num_rows), counts))
    return pa.record_batch([*(c.take(take) for c in batch.columns), *new], names=names)


def page_grams(pages: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(rules_id, doc_id, page, gram) of pages with a normalised text n."""
    base = pages.select("rules_id", "doc_id", "page", "n")
    names = ["rules_id", "doc_id", "page", "gram"]
    kinds = dict(base.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column(3), 0
            while start < batch.num_rows:
                stop, size, own = start, 0, []
                while stop < batch.num_rows and (size < BATCH or stop == start):
                    text = texts[stop].as_py() or ""
                    codes = folded_codes(text)
                    own.append(np.concatenate([grams(codes, k) for k in levels]))
                    size, stop = size + len(text), stop + 1
                yield _repeated(batch.select([0, 1, 2]).slice(start, stop - start), [len(x) for x in own], [pa.array(np.concatenate(own))], names)
                start = stop

    return base.mapInArrow(run, f"rules_id {kinds['rules_id']}, doc_id {kinds['doc_id']}, page int, gram long")


def literal_grams(literals: DataFrame) -> DataFrame:
    """literals (with needle, a normalised text) with level and gram, a row for each gram."""
    names = [*literals.columns, "level", "gram"]
    at = literals.columns.index("needle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needles = batch.column(at).to_pylist()
            levels = [level_of(len(x)) for x in needles]
            own = [grams(folded_codes(x), k) for x, k in zip(needles, levels, strict=True)]
            counts = [len(x) for x in own]
            yield _repeated(batch, counts, [pa.array(np.repeat(levels, counts), pa.int32()), pa.array(np.concatenate(own) if own else [], pa.int64())], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in literals.dtypes)
    return literals.mapInArrow(run, f"{kinds}, level int, gram long")


def literal_spans(pages: DataFrame, literals: DataFrame, store: Store | None = None) -> DataFrame:
    """All non-overlapping occurrences of each literal in the pages of its book, as spans() has them, with rules_id.

    pages: doc_id, page, text and, if there is more than one book, rules_id. literals: rules_id (if pages have one),
    line_number, literal, is_case_sensitive. Null or blank literals match nothing; two rows of one literal are two rules;
    a page whose rules_id is null has no book. Ranges are in the normalised text.
    """
    store = store or Store(pages.sparkSession)
    tenants = "rules_id" in pages.columns
    book = F.col("rules_id").cast("string") if tenants else F.lit(ALL)
    base = with_pages(pages, ("rules_id",) if tenants else ()).select("doc_id", "page", book.alias("rules_id"), normalized(F.col("text")).alias("n"))
    rows = literals.select(book.alias("rules_id"), F.col("line_number").cast("int").alias("rule_line"), "literal", F.coalesce("is_case_sensitive", F.lit(False)).alias("sensitive"), normalized(F.col("literal")).alias("needle"))
    keys = store.kept(literal_grams(rows.filter("needle <> '' and rules_id is not null")), "literal-grams")
    levels = tuple(sorted(r[0] for r in keys.select("level").distinct().collect()))  # at most len(LEVELS)
    if not levels:
        levels = (0,)
    wanted = store.kept(keys.select("rules_id", "gram").distinct(), "wanted-grams")
    held = store.kept(page_grams(base, levels).join(wanted, ["rules_id", "gram"]), "held-grams")
    seen = held.groupBy("rules_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    rule = ["rules_id", "rule_line", "literal", "needle", "sensitive"]
    rarest = keys.join(seen, ["rules_id", "gram"], "left").groupBy(*rule).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key"), F.count(F.lit(1)).alias("grams"))
    rarest = store.kept(rarest.filter("key.n > 0").select(*rule, "key.gram", "grams"), "rarest-grams")
    candidates = held.join(rarest, ["rules_id", "gram"]).select("doc_id", "page", *rule).distinct()
    c, p = candidates.alias("c"), base.select("doc_id", "page", "n").alias("p")
    met = c.join(p, F.col("c.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("c.page").eqNullSafe(F.col("p.page"))).select("c.*", "p.n")
    found = met.select("doc_id", "page", "rules_id", "rule_line", "literal", F.explode(needle_hits(F.col("n"), F.col("needle"), F.col("sensitive"), 0)).alias("m"))
    out = found.select(
        "doc_id", "page", "rules_id", F.lit("exact").alias("source_kind"), F.lit(None).cast("string").alias("category"), F.concat(F.lit("“"), "literal", F.lit("”")).alias("rule_description"), "rule_line",
        "m.start", "m.stop", "m.matched_text", "m.engine_no",
    )
    return out if tenants else out.drop("rules_id")


def book_spans(pages: DataFrame, books: DataFrame, store: Store | None = None) -> DataFrame:
    """Spans of pages (doc_id, page, text, rules_id) by their own tenant's rule book, from a table of books (rules_id, body).

    Literals go through literal_spans(). Categories, of which there are few, are looked for once a page, those that any
    book names; the spans, not the texts, then meet the books that ask for them. Lines of books that cannot be used are
    what diagnostics() reports; a book without a usable rule finds nothing, and unusable_books() names it.
    """
    store = store or Store(pages.sparkSession)
    parsed = store.kept(rules(books.select(F.col("rules_id").cast("string").alias("rules_id"), "body")), "parsed-rules")
    exact = literal_spans(pages, parsed.filter("kind = 'exact'"), store)
    named = [r[0] for r in parsed.filter("kind = 'category'").select("category").distinct().collect()]  # at most the fixed categories
    if not named:
        return exact
    one = RuleBook(tuple(Rule("category", None, False, c, 0) for c in CATEGORIES if c in named))
    kind = dict(pages.dtypes)["rules_id"]
    every = spans(pages.withColumn("rules_id", F.col("rules_id").cast("string")), one, carry=("rules_id",)).drop("rule_line")
    asked = parsed.filter("kind = 'category'").select("rules_id", "category", F.col("line_number").alias("rule_line"))
    return exact.unionByName(every.join(asked, ["rules_id", "category"])).withColumn("rules_id", F.col("rules_id").cast(kind))


def unusable_books(books: DataFrame) -> DataFrame:
    """Books (rules_id) without a single usable rule: their documents must not pass as clean."""
    ids = books.select(F.col("rules_id").cast("string").alias("rules_id"), "body")
    return ids.select("rules_id").distinct().join(rules(ids).select("rules_id").distinct(), "rules_id", "left_anti")
