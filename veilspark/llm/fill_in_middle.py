"""Operator 11: fill-in-the-middle by escaped marker injection.

A text is cut into units without ever becoming an array: a delimiter that the text cannot hold (its own occurrences
are escaped first) is put after each unit by regexp_replace; counting it counts the units, and substring_index takes
the units before, between and after two ranks. The parts lose their delimiters, are unescaped and assembled around
markers. All of it is a projection over the scan: no shuffle, no Python, cost linear in the text.

Cuts and forms hang on the document's id and a seed alone, so lost tasks and later runs give the same rows.

Defined results: a null text counts as empty; an empty text, and one that holds a marker, stays plain; a null doc_id
takes part like the text 'null'; repeated rows get equal results; an empty table gives no rows; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import let

#: The delimiter put after each unit, and the character that escapes both in a text.
END, ESCAPE = "\x01", "\x02"
ESCAPED_END, ESCAPED_ESCAPE = ESCAPE + "1", ESCAPE + "2"


@dataclass(frozen=True)
class Forms:
    """How documents are transformed. unit: a regex whose matches cover any text; an escaped character counts as [^A-Za-z0-9] does there.

    plain: per cent of documents that stay as they are; spm: per cent of the others whose suffix comes first.
    """

    seed: int = 1
    plain: int = 10
    spm: int = 20
    unit: str = "[A-Za-z]+|[^A-Za-z]"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def escaped(text: Column) -> Column:
    """text without the delimiter: unescaped() gives it back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(END), F.lit(ESCAPED_END))


def unescaped(text: Column) -> Column:
    """escaped() undone. Escapes are read left to right as pairs, and the first pass makes no new escape character."""
    return F.replace(F.replace(text, F.lit(ESCAPED_END), F.lit(END)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def injected(text: Column, unit: str) -> Column:
    """text, escaped, with the delimiter after each unit; an escaped character is one unit."""
    return F.regexp_replace(escaped(text), f"{ESCAPE}[12]|{unit}", f"$0{END}")


def n_units(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit(END), F.lit("")))


def units(marked: Column, first: Column, last: Column, n: Column) -> Column:
    """The text of the units with ranks first <= rank < last, of n."""
    head = F.call_function("substring_index", marked, F.lit(END), last.cast("int"))
    # head holds last - 1 delimiters where it was cut before one, and all n where nothing was cut
    tail = F.call_function("substring_index", head, F.lit(END), (first - last).cast("int"))
    return unescaped(F.replace(F.when(first == 0, head).when(first == last, F.lit("")).otherwise(tail), F.lit(END), F.lit("")))


def transformed(docs: DataFrame, forms: Forms = Forms()) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null where plain) and output for each document."""
    if not all(forms.markers) or len({*forms.markers}) < 3 or any(m[0] in m[1:] or a != m and m in a for m in forms.markers for a in forms.markers):
        raise ValueError("markers must differ, hold none of the others, and not repeat their first character")
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{forms.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = docs.select("doc_id", text.alias("text"), F.transform(F.array(*(F.substring(digest, 8 * i + 1, 8) for i in range(4))), lambda x: F.conv(x, 16, 10).cast("long")).alias("h"))
    rows = rows.select("doc_id", "text", "h", injected(F.col("text"), forms.unit).alias("marked"))
    rows = rows.select("doc_id", "text", "h", "marked", n_units(F.col("marked")).cast("long").alias("n"))
    a, b = (F.col("h")[i] % (F.col("n") + 1) for i in range(2))
    held = F.lit(False)
    for m in forms.markers:
        held = held | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | held | (F.col("h")[2] % 100 >= 100 - forms.plain), "plain").when(F.col("h")[3] % 100 < forms.spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    marked, n, lo, hi = (F.col(c) for c in ("marked", "n", "lo", "hi"))
    cut = F.when(F.col("form") != "plain", F.struct(units(marked, F.lit(0), lo, n).alias("prefix"), units(marked, lo, hi, n).alias("middle"), units(marked, hi, n, n).alias("suffix")))
    rows = rows.select("doc_id", "text", "n", "form", cut.alias("cut")).select("doc_id", "n", "form", "text", "cut.*")
    p, s, m = (F.lit(x) for x in forms.markers)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, forms: Forms = Forms()) -> Column:
    """The exact text, from what transformed() made of it and the form alone."""

    def between(text: Column, opening: str, closing: str) -> Column:
        rest = F.substring(text, F.lit(len(opening) + 1), F.length(text))
        return F.call_function("substring_index", rest, F.lit(closing), F.lit(1))

    def rebuilt(first: str, second: str, swapped: bool) -> Column:
        def parts(one: Column) -> Column:
            rest = F.substring(output, F.length(one) + F.lit(len(first) + 1), F.length(output))

            def both(two: Column) -> Column:
                last = F.substring(rest, F.length(two) + F.lit(len(second) + len(forms.middle) + 1), F.length(rest))
                return F.concat(two, last, one) if swapped else F.concat(one, last, two)

            return let(between(rest, second, forms.middle), both)

        return let(between(output, first, second), parts)

    return F.when(form == "plain", output).when(form == "psm", rebuilt(forms.prefix, forms.suffix, False)).otherwise(rebuilt(forms.suffix, forms.prefix, True))


def report(docs: DataFrame, forms: Forms = Forms()) -> DataFrame:
    """One row a document: its units, form, sizes of prefix and middle, digests of the output and of the text rebuilt from it."""
    rows = transformed(docs.selectExpr("cast(doc_id as long) doc_id", "text"), forms)
    back = rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "output", restored(F.col("output"), F.col("form"), forms).alias("back"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("back").cast("binary"), 256).alias("restored_sha256"))
