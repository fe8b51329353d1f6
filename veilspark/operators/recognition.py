"""Values on recognised pages: lines with token boxes in, boxes to cover out.

A value is looked for exactly, then as part of a whole line, then across consecutive lines, then approximately; the
first that finds anything answers. Digits are never approximated: a digit read as another digit is another number.
Boxes are (x, y, w, h).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_CONFIDENCE = 0.4
LEAST_APPROXIMATE = 6
Box = tuple[float, float, float, float]
LINES = "array<struct<text:string,confidence:float,box:struct<x:double,y:double,w:double,h:double>,tokens:array<struct<start:int,stop:int,box:struct<x:double,y:double,w:double,h:double>>>>>"


@dataclass(frozen=True)
class Line:
    text: str
    box: Box
    tokens: tuple[tuple[int, int, Box], ...] = ()

    def covering(self, a: int, b: int) -> Box:
        """Box of the tokens that touch [a, b); the whole line where none do."""
        touched = [box for s, e, box in self.tokens if s < b and a < e]
        return union(touched) if touched else self.box


def union(boxes: list[Box]) -> Box:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


def contains(outer: Box, inner: Box) -> bool:
    return outer[0] <= inner[0] and outer[1] <= inner[1] and outer[0] + outer[2] >= inner[0] + inner[2] and outer[1] + outer[3] >= inner[1] + inner[3]


def agrees(read: Box, drawn: Box) -> bool:
    """Whether a drawn box meets a read one and is at most half again as large."""
    meets = read[0] < drawn[0] + drawn[2] and drawn[0] < read[0] + read[2] and read[1] < drawn[1] + drawn[3] and drawn[1] < read[1] + read[3]
    return meets and drawn[2] <= 1.5 * read[2] and drawn[3] <= 1.5 * read[3]


def lowered(text: str) -> str:
    """text in lower case, as long as before: the one capital whose small form is two characters is a plain i."""
    return text.replace("İ", "i").lower()


def folded(text: str) -> str:
    return " ".join(lowered(text).split())


def is_artefact(a: str, b: str) -> bool:
    """Whether two characters may be one misread; two digits never are."""
    return not (a.isdigit() and b.isdigit())


def _mismatches(a: str, b: str, most: int) -> int | None:
    n = 0
    for x, y in zip(a, b, strict=True):
        if x != y:
            n += 1
            if n > most or not is_artefact(x, y):
                return None
    return n


def boxes(value: str, lines: list[Line]) -> list[Box]:
    wanted, bare = value.strip(), folded(value)
    if not bare:
        return []
    found = [x.covering(m.start(), m.end()) for x in lines for m in re.finditer(re.escape(lowered(wanted)), lowered(x.text))]
    return found or [x.box for x in lines if bare in folded(x.text)] or across_lines(bare, lines) or approximate(wanted, lines)


def _like(a: list[str], b: list[str]) -> bool:
    return len(a) == len(b) and all(len(x) == len(y) and _mismatches(x, y, min(2, len(x) // 4)) is not None for x, y in zip(a, b, strict=True))


def across_lines(value: str, lines: list[Line]) -> list[Box]:
    """value as the end of one line, whole lines, and the start of a last one."""
    words = value.split()
    split = [folded(x.text).split() for x in lines]
    for i, first in enumerate(split):
        for k in range(min(len(first), len(words) - 1), 0, -1):
            if not _like(first[-k:], words[:k]):
                continue
            rest, out, j = words[k:], [_words_box(lines[i], len(first) - k, len(first))], i + 1
            while rest and j < len(lines):
                here = split[j]
                n = min(len(here), len(rest))
                if not n or not _like(here[:n], rest[:n]):
                    break
                out.append(_words_box(lines[j], 0, n))
                rest = rest[n:]
                if rest and n < len(here):
                    break
                j += 1
            if not rest:
                return out
    return []


def _words_box(line: Line, a: int, b: int) -> Box:
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", line.text)]
    return line.covering(places[a][0], places[b - 1][1])


def approximate(value: str, lines: list[Line]) -> list[Box]:
    """In each line the window with the fewest misread characters, if few enough; one character wider on each side."""
    n = len(value)
    if n < LEAST_APPROXIMATE:
        return []
    low, most, out = lowered(value), max(1, n // 3), []
    for x in lines:
        text, best = lowered(x.text), None
        for a in range(len(text) - n + 1):
            m = _mismatches(low, text[a : a + n], most if best is None else best[0] - 1)
            if m is not None:
                best = (m, a)
        if best is not None:
            out.append(x.covering(max(0, best[1] - 1), min(len(text), best[1] + n + 1)))
    return out


def confident(lines: DataFrame) -> DataFrame:
    """Recognised lines that are sure enough to use."""
    return lines.filter(F.col("confidence") >= LEAST_CONFIDENCE)


def located(values: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, value, boxes: each value (doc_id, page, value) on its page (doc_id, page, lines)."""
    joined = values.select("doc_id", "page", "value").join(pages.select("doc_id", "page", F.col("lines").cast(LINES).alias("lines")), ["doc_id", "page"])
    schema = T.StructType([*joined.drop("lines").schema.fields, *T._parse_datatype_string("boxes array<struct<x:double,y:double,w:double,h:double>>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def box(b: dict) -> Box:
            return b["x"], b["y"], b["w"], b["h"]

        for pdf in batches:
            out = []
            for value, lines in zip(pdf["value"], pdf["lines"], strict=True):
                use = [Line(x["text"], box(x["box"]), tuple((t["start"], t["stop"], box(t["box"])) for t in (x["tokens"] if x["tokens"] is not None else ()))) for x in lines if x["confidence"] >= LEAST_CONFIDENCE]
                out.append([dict(zip("xywh", b, strict=True)) for b in boxes(value or "", use)])
            yield pdf.drop(columns="lines").assign(boxes=out)

    return joined.select("doc_id", "page", "value", "lines").mapInPandas(run, schema)


def new_boxes(found: DataFrame) -> DataFrame:
    """Boxes not contained in one that is already drawn: found has boxes and drawn, both arrays of boxes."""
    def inside(o, i):
        return (o["x"] <= i["x"]) & (o["y"] <= i["y"]) & (o["x"] + o["w"] >= i["x"] + i["w"]) & (o["y"] + o["h"] >= i["y"] + i["h"])

    return found.withColumn("boxes", F.filter("boxes", lambda b: ~F.exists("drawn", lambda d: inside(d, b))))
