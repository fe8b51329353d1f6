"""Values on recognised pages by joins: a line is a row, so that a page may hold any number of lines.

The rungs are those of recognition.boxes: a value exactly, else as part of a whole line, else across the ends of consecutive lines,
else approximately; the first rung that finds anything on the page answers. No page is gathered.

A page's lines meet its values by the page where it has at most FEW of them, one row a line; the values of other pages, however
many, meet lines by what they must share:

exact, line: the first characters of the value's first word stand in the line.
across: the first line's last word is a word of the value. Words are alike if they have the same length and differ in
    min(2, length // 4) places at most, so cut into one piece more than that they share a piece.
approximate: a window differs in max(1, n // 3) places at most, so of one piece more than that one is exact; its first two characters
    name the places to look at, and only those are compared (on pages of few values, too).

Two decimal digits are never taken for each other. Letters are folded as recognition.lowered does, which keeps a text's length. Values that are
null or blank, lines without text and lines less sure than LEAST_CONFIDENCE are on no page; values asked twice are asked once; other columns
of either side are ignored. What is compared grows with the number of such meetings on a page; equal pieces of a very large page are one
key, which adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilspark.operators.recognition import LEAST_APPROXIMATE, LEAST_CONFIDENCE, LINES
from veilspark.sources.tables import Store

KEYS = ("doc_id", "page")
HIT = (*KEYS, "value", "rung", "line", "start", "stop")
#: Values of a page that its lines may carry along.
FEW = 64
#: Lines of one block of the running count of words.
BLOCK = 1024
#: Characters of windows that are compared at once.
AT_ONCE = 1 << 22
BOX = "struct<x:double,y:double,w:double,h:double>"
_WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_WINDOW = T.StructType([T.StructField("misread", T.IntegerType()), T.StructField("at", T.IntegerType())])
_ENDS = T.StructType([T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), *_WORD.fields])))])
_HELD = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("rung", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def line_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page, line, text, confidence, box, tokens: the lines (an array, in reading order) of pages as rows, numbered from 0."""
    each = pages.select(*KEYS, F.posexplode(F.col("lines").cast(LINES)).alias("line", "l"))
    return each.select(*KEYS, F.col("line").cast("long").alias("line"), "l.*")


def in_page_space(box: Column, page: Column, turned: Column | None = None) -> Column:
    """A box read on an image (fractions of its width and height, origin below on the left) on the page's own axes.

    page is the page's box before it is turned; turned is how far its image was turned clockwise, in degrees: a multiple of 90, negative ones
    too, null for none. Another angle gives null, as does a null box.
    """
    x, y, w, h = (box[n] for n in "xywh")
    angle = F.pmod(F.coalesce(turned, F.lit(0)), F.lit(360)) if turned is not None else F.lit(0)

    def on_page(u: Column, v: Column, wide: Column, high: Column) -> Column:
        return F.struct((page["x"] + u * page["w"]).alias("x"), (page["y"] + v * page["h"]).alias("y"), (wide * page["w"]).alias("w"), (high * page["h"]).alias("h"))

    known = F.when(angle == 0, on_page(x, y, w, h)).when(angle == 90, on_page(1 - y - h, x, h, w)).when(angle == 180, on_page(1 - x - w, 1 - y - h, w, h)).when(angle == 270, on_page(y, 1 - x - w, h, w))
    return F.when(box.isNotNull(), known)


def scaled(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """lines with box and tokens' boxes in the space of their page: pages, or lines themselves, have page_box and turned (degrees)."""
    sizes = ("page_box", "turned")
    joined = lines if pages is None else lines.drop(*sizes).join(pages.select(*KEYS, *sizes), list(KEYS))
    page = F.col("page_box").cast(BOX)
    moved = joined.withColumn("box", in_page_space(F.col("box"), page, F.col("turned")))
    return moved.withColumn("tokens", F.transform("tokens", lambda t: t.withField("box", in_page_space(t["box"], page, F.col("turned"))))).select(*(c for c in lines.columns if c not in sizes))


def _low(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


@F.pandas_udf(T.ArrayType(_WORD))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"word": m.group(), "start": m.start(), "stop": m.end()} for m in re.finditer(r"\S+", t)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places(values: pd.Series, texts: pd.Series) -> pd.Series:
    """Where a value starts in a text, from left to right without overlap."""
    return pd.Series([[m.start() for m in re.finditer(re.escape(v), t)] for v, t in zip(values, texts, strict=True)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _digits(text: str) -> np.ndarray:
    return np.char.isdecimal(np.array(list(text), dtype="U1"))


def _offsets(n: int) -> list[int]:
    """Where the pieces of a value of n characters start."""
    k = max(1, n // 3) + 1
    return [i * n // k for i in range(k)]


def _window(value: str, text: str, t: np.ndarray, places: np.ndarray) -> tuple[int, int] | None:
    """Of these places the first with the fewest misread characters, and how many they are; nothing where all have too many."""
    n, best = len(value), None
    at = np.unique(places[(places >= 0) & (places + n <= len(t))])
    if not len(at):
        return None
    v, v_digit, t_digit, step = _codes(value), _digits(value), _digits(text), max(1, AT_ONCE // n)
    for i in range(0, len(at), step):
        here = at[i : i + step]
        window = here[:, None] + np.arange(n)
        differs = t[window] != v
        wrong = differs.sum(axis=1)
        wrong[(differs & t_digit[window] & v_digit).any(axis=1)] = n + 1
        k = int(wrong.argmin())
        if wrong[k] <= max(1, n // 3) and (best is None or wrong[k] < best[0]):
            best = (int(wrong[k]), int(here[k]))
    return best


@F.pandas_udf(_WINDOW)
def _best(values: pd.Series, texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    out = [_window(v, t, _codes(t), np.asarray(at, dtype=np.int64)) or (None, None) for v, t, at in zip(values, texts, places, strict=True)]
    return pd.DataFrame(out, columns=["misread", "at"]).astype("Int32")


@F.pandas_udf(_HELD)
def _few_at_once(texts: pd.Series, values: pd.Series) -> pd.Series:
    """Of a page's few values those that a line holds: each place, or the whole line where only blanks differ."""
    out = []
    for text, asked in zip(texts, values, strict=True):
        found, bare = [], None
        for v in asked:
            low = v["low"]
            if low in text:
                found.extend({"value": v["value"], "rung": "exact", "start": m.start(), "stop": m.end()} for m in re.finditer(re.escape(low), text))
            elif v["bare"].partition(" ")[0] in text:
                bare = " ".join(text.split()) if bare is None else bare
                if v["bare"] in bare:
                    found.append({"value": v["value"], "rung": "line", "start": None, "stop": None})
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(_HELD)
def _few_approximate(texts: pd.Series, values: pd.Series) -> pd.Series:
    """Of a page's few values those that a line holds approximately, one character wider on each side."""
    out = []
    for text, asked in zip(texts, values, strict=True):
        found, t = [], _codes(text)
        for v in asked:
            low = v["low"]
            code, n = _codes(low), len(low)
            seeds = [np.flatnonzero((t[:-1] == code[o]) & (t[1:] == code[o + 1])) - o for o in _offsets(n)] if n <= len(t) else []
            best = _window(low, text, t, np.concatenate(seeds)) if seeds else None
            if best is not None:
                found.append({"value": v["value"], "rung": "approximate", "start": max(0, best[1] - 1), "stop": min(len(t), best[1] + n + 1)})
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(_ENDS)
def _ends(texts: pd.Series, most: pd.Series) -> pd.DataFrame:
    """How many words a line has, and its first and last few."""
    out = []
    for text, m in zip(texts, most, strict=True):
        found = [(x.start(), x.end()) for x in re.finditer(r"\S+", text)]
        n = len(found)
        kept = range(n) if n <= 2 * m else (*range(m), *range(n - m, n))
        out.append((n, [{"i": i, "word": text[found[i][0] : found[i][1]], "start": found[i][0], "stop": found[i][1]} for i in kept]))
    return pd.DataFrame(out, columns=["n", "words"])


def _alike(a: Column, b: Column) -> Column:
    """Whether two words of the same length differ in few places, none of them two digits."""
    wrong = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).when(F.rlike(x, F.lit(r"^\p{Nd}$")) & F.rlike(y, F.lit(r"^\p{Nd}$")), 9).otherwise(1))
    few = F.aggregate(wrong, F.lit(0), lambda s, x: s + x) <= F.least(F.lit(2), F.floor(F.length(a) / 4))
    return (F.length(a) == F.length(b)) & F.when(a == b, True).otherwise(few)


def _pieces(word: Column) -> Column:
    """A word's length and its pieces, one more than the places in which a word like it may differ."""
    n = F.length(word)
    k = F.least(F.lit(2), F.floor(n / 4)).cast("int") + 1

    def piece(i: Column) -> Column:
        a = F.floor(i * n / k).cast("int")
        return F.struct(n.alias("n"), i.alias("i"), F.substring(word, a + 1, F.floor((i + 1) * n / k).cast("int") - a).alias("piece"))

    return F.transform(F.sequence(F.lit(0), k - 1), piece)


def _grams(low: Column) -> Column:
    """All runs of one to three characters of a text, each once."""
    one = F.split(low, "")
    two = F.zip_with(one, F.slice(one, 2, F.size(one)), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(one, 3, F.size(one)), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(F.concat(one, two, three)))


def _at_once(asked: DataFrame, used: DataFrame) -> DataFrame:
    """Hits of the rungs exact and line."""
    seeds = asked.select(*KEYS, "value", F.regexp_extract("low", r"(?U)^\S{1,3}", 0).alias("gram"))
    grams = used.select(*KEYS, "line", F.explode(_grams(F.col("low"))).alias("gram"))
    met = seeds.join(grams, [*KEYS, "gram"]).select(*KEYS, "value", "line")
    texts = met.join(asked.select(*KEYS, "value", "low", "bare"), [*KEYS, "value"]).join(used.select(*KEYS, "line", F.col("low").alias("text"), F.col("bare").alias("text_bare")), [*KEYS, "line"])
    held = texts.filter(F.contains("text", "low") | F.contains("text_bare", "bare")).withColumn("places", _places("low", "text")).withColumn("rung", F.when(F.size("places") > 0, "exact").otherwise("line"))
    each = held.withColumn("start", F.explode_outer("places"))
    return each.select(*KEYS, "value", "rung", "line", "start", (F.col("start") + F.length("low")).alias("stop"))


def _of_few(rung: Callable, asked: DataFrame, sure: DataFrame) -> DataFrame:
    """Hits of the values of pages with few of them: each line carries its page's values."""
    held = asked.groupBy(*KEYS).agg(F.collect_list(F.struct("value", "low", "bare")).alias("values"))
    return sure.join(held, list(KEYS)).select(*KEYS, "line", F.explode(rung(_low(F.col("text")), F.col("values"))).alias("h")).select(*KEYS, "h.value", "h.rung", "line", "h.start", "h.stop")


def _numbered(used: DataFrame) -> DataFrame:
    """used with rank (of the line on its page) and before (words of the page's earlier lines): sums within blocks of lines and over blocks."""
    sized = used.select(*KEYS, "line", "words", F.col("n").alias("_n"), F.floor(F.col("line") / BLOCK).alias("_block"))
    blocks = sized.groupBy(*KEYS, "_block").agg(F.sum("_n").alias("_words"), F.count("*").alias("_lines"))
    ahead = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*KEYS, "_block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*KEYS, "_block", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_w"), F.coalesce(F.sum("_lines").over(ahead), F.lit(0)).alias("_l"))
    own = sized.withColumn("_ow", F.coalesce(F.sum("_n").over(within), F.lit(0))).withColumn("_ol", F.count("*").over(within))
    return own.join(offsets, [*KEYS, "_block"]).select(*KEYS, "line", "words", F.col("_n").alias("n"), (F.col("_w") + F.col("_ow")).alias("before"), (F.col("_l") + F.col("_ol")).alias("rank"))


def _across(asked: DataFrame, sure: DataFrame, store: Store) -> DataFrame:
    """Hits of the first place on a page where a value ends a line, fills whole lines and begins a last one; a line without words ends it."""
    several = asked.withColumn("parts", F.transform("words", lambda w: w["word"])).filter(F.size("parts") > 1).select(*KEYS, "value", "parts")
    longest = several.groupBy(*KEYS).agg(F.max(F.size("parts")).alias("m"))
    ended = sure.join(longest, list(KEYS)).select(*KEYS, "line", _ends(_low(F.col("text")), F.col("m")).alias("e")).select(*KEYS, "line", "e.*")
    numbered = _numbered(store.kept(ended, "ends"))
    word = several.select(*KEYS, "value", F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("k", "word"))
    seeds = word.select(*KEYS, "value", "k", F.explode(_pieces(F.col("word"))).alias("seed"))
    ends = numbered.filter("n > 0").select(*KEYS, "before", (F.col("before") + F.col("n") - 1).alias("end"), F.explode(_pieces(F.element_at("words", -1)["word"])).alias("seed"))
    starts = seeds.join(ends, [*KEYS, "seed"]).withColumn("first", F.col("end") - F.col("k")).filter("first >= before").select(*KEYS, "value", "first").distinct()
    wanted = starts.join(several, [*KEYS, "value"]).select(*KEYS, "value", "first", F.size("parts").alias("m"), F.posexplode("parts").alias("i", "part")).withColumn("no", F.col("first") + F.col("i"))
    every = numbered.select(*KEYS, "line", "rank", "before", F.explode("words").alias("w")).select(*KEYS, "line", "rank", (F.col("before") + F.col("w.i")).alias("no"), "w")
    alike = wanted.join(every, [*KEYS, "no"]).filter(_alike(F.col("part"), F.col("w.word")))
    spans = F.array_sort(F.collect_list(F.struct("no", "line", "w.start", "w.stop")))
    whole = alike.groupBy(*KEYS, "value", "first").agg(F.count("*").alias("k"), F.first("m").alias("m"), F.count_distinct("rank").alias("lines"), (F.max("rank") - F.min("rank") + 1).alias("span"), spans.alias("spans")).filter("k = m and lines = span and lines > 1")
    best = whole.groupBy(*KEYS, "value").agg(F.min(F.struct("first", "spans")).alias("best"))
    each = best.select(*KEYS, "value", F.inline("best.spans"))
    return each.groupBy(*KEYS, "value", "line").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(*KEYS, "value", F.lit("across").alias("rung"), "line", "start", "stop")


def _approximate(asked: DataFrame, used: DataFrame) -> DataFrame:
    """Hits of each line's best window, one character wider on each side."""
    n = F.length("low")
    k = F.greatest(F.lit(1), F.floor(n / 3)).cast("int") + 1
    offsets = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * n / k).cast("int"))
    long = asked.filter(n >= LEAST_APPROXIMATE)
    seeds = long.select(*KEYS, "value", "low", F.explode(offsets).alias("off")).select(*KEYS, "value", "off", F.substring("low", F.col("off") + 1, F.lit(2)).alias("gram"))
    one = F.split("low", "")
    pairs = F.zip_with(one, F.slice(one, 2, F.size(one)), lambda a, b: F.concat(a, b))
    grams = used.join(long.select(*KEYS).distinct(), list(KEYS), "left_semi").select(*KEYS, "line", F.posexplode(pairs).alias("pos", "gram"))
    met = seeds.join(grams, [*KEYS, "gram"]).groupBy(*KEYS, "value", "line").agg(F.collect_set(F.col("pos") - F.col("off")).alias("places"))
    texts = met.join(long.select(*KEYS, "value", "low"), [*KEYS, "value"]).join(used.select(*KEYS, "line", F.col("low").alias("text")), [*KEYS, "line"])
    found = texts.withColumn("best", _best("low", "text", "places")).filter("best.at is not null")
    start = F.greatest(F.lit(0), F.col("best.at") - 1)
    stop = F.least(F.length("text"), F.col("best.at") + F.length("low") + 1)
    return found.select(*KEYS, "value", F.lit("approximate").alias("rung"), "line", start.alias("start"), stop.alias("stop"))


def located(values: DataFrame, lines: DataFrame, store: Store | None = None, few: int = FEW) -> DataFrame:
    """doc_id, page, value, rung, line, start, stop, box: where each value (doc_id, page, value) stands on its page's lines.

    lines: doc_id, page, line (its number, which no other line of the page has), text, confidence, box, tokens, as line_rows()
    gives them. start and stop are code points of the line's text, null on the rung line; box is that of the tokens that touch them,
    else the line's. A value that is not found has no row. few: values of a page that its lines carry along; any number gives the same rows. What a rung finds is stored before the next one looks for the rest.
    """
    store = store or Store(values.sparkSession)
    asked = values.select(*KEYS, "value").dropna().distinct().withColumn("low", _low(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))).withColumn("words", _words("low"))
    asked = asked.filter(F.size("words") > 0).withColumn("bare", F.array_join(F.transform("words", lambda w: w["word"]), " "))
    asked = store.kept(asked.join(asked.groupBy(*KEYS).agg((F.count("*") > few).alias("many")), list(KEYS)), "asked")
    sure = lines.filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.length("text") > 0))
    crowded = asked.filter("many").select(*KEYS).distinct()
    used = None
    if not crowded.isEmpty():
        used = sure.join(crowded, list(KEYS), "left_semi").select(*KEYS, "line", _low(F.col("text")).alias("low")).withColumn("words", _words("low"))
        used = store.kept(used.select(*KEYS, "line", "low", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("bare")), "lines")

    def at_once(rest: DataFrame) -> DataFrame:
        found = _of_few(_few_at_once, rest.filter("not many"), sure).select(*HIT)
        found = found if used is None else found.unionByName(_at_once(rest.filter("many"), used).select(*HIT))
        return found.withColumn("_first", F.min("rung").over(Window.partitionBy(*KEYS, "value"))).filter("rung = _first")

    def approximate(rest: DataFrame) -> DataFrame:
        found = _of_few(_few_approximate, rest.filter(~F.col("many") & (F.length("low") >= LEAST_APPROXIMATE)), sure).select(*HIT)
        return found if used is None else found.unionByName(_approximate(rest.filter("many"), used).select(*HIT))

    hits, rest = None, asked
    for name, rung in (("at-once", at_once), ("across", lambda r: _across(r, sure, store)), ("approximate", approximate)):
        found = store.kept(rung(rest).select(*HIT), name)
        hits, rest = found if hits is None else hits.unionByName(found), rest.join(found.select(*KEYS, "value").distinct(), [*KEYS, "value"], "left_anti")
    placed = hits.join(sure.select(*KEYS, "line", F.col("box").alias("_line"), "tokens"), [*KEYS, "line"])
    near = F.filter(F.coalesce("tokens", F.array().cast(f"array<struct<start:int,stop:int,box:{BOX}>>")), lambda t: (t["start"] < F.col("stop")) & (F.col("start") < t["stop"]))
    edge = placed.withColumn("_near", F.transform(near, lambda t: t["box"]))
    right, below = F.array_max(F.transform("_near", lambda b: b["x"] + b["w"])), F.array_max(F.transform("_near", lambda b: b["y"] + b["h"]))
    x, y = F.array_min(F.transform("_near", lambda b: b["x"])), F.array_min(F.transform("_near", lambda b: b["y"]))
    union = F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (below - y).alias("h"))
    return edge.withColumn("box", F.when(F.size("_near") > 0, union).otherwise(F.col("_line"))).select(*HIT, "box")
