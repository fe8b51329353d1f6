"""Ranges of the normalised text back in the original, as an Arrow function; only on request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BREAKS = frozenset("\n\x0b\x0c\r\x85\u2028\u2029")
#: Unicode's white space, as the patterns of functions/text.py have it.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def normalize(text: str) -> tuple[str, list[int], list[int]]:
    """Normalised text, and for each of its characters where it starts and ends in the original."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    i, n = (1 if text[:1] == "\ufeff" else 0), len(text)
    space_from = -1
    while i < n:
        c = text[i]
        if c in SPACES:
            space_from = i if space_from < 0 else space_from
            i += 1
            continue
        if space_from >= 0:
            if out:
                out.append(" ")
                starts.append(space_from)
                ends.append(i)
            space_from = -1
        if c == "-":
            j = i + 1
            while j < n and text[j] in SPACES:
                j += 1
            if j < n and any(x in BREAKS for x in text[i + 1 : j]):
                if not (i and text[i - 1].isalpha() and text[j].isalpha()):
                    out.append("-")
                    starts.append(i)
                    ends.append(i + 1)
                i = j
                continue
        out.append(c)
        starts.append(i)
        ends.append(i + 1)
        i += 1
    return "".join(out), starts, ends


def original_range(starts: list[int], ends: list[int], a: int, b: int) -> tuple[int, int] | None:
    """The original's range of [a, b); nothing if it is empty or out of bounds."""
    return (starts[a], ends[b - 1]) if 0 <= a < b <= len(starts) else None


def in_original(pages: DataFrame, found: DataFrame) -> DataFrame:
    """found with original_start, original_stop and original_text. Joins on (doc_id, page) once; only pages with
    spans go through Python."""
    from veilspark.operators.spans import with_pages

    joined = found.join(with_pages(pages), ["doc_id", "page"])
    fields = [f for f in joined.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("original_start", T.IntegerType()), T.StructField("original_stop", T.IntegerType()), T.StructField("original_text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, maps, rows = None, ([], []), []
            for text, a, b in zip(pdf["text"], pdf["start"], pdf["stop"], strict=True):
                if text is not last:
                    last, maps = text, normalize(text)[1:]
                r = original_range(*maps, int(a), int(b))
                rows.append((r[0], r[1], text[r[0] : r[1]]) if r else (None, None, None))
            out = pdf.drop(columns="text")
            new = pd.DataFrame(rows, columns=["original_start", "original_stop", "original_text"], index=out.index).astype({"original_start": "Int32", "original_stop": "Int32"})
            yield pd.concat([out, new], axis=1)

    return joined.select(*[f.name for f in fields], "text").mapInPandas(run, schema)
