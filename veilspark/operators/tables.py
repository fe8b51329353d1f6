"""Pipe tables inside texts: cells under their headers."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pages that hold a line like this may hold a table.
TABLE_ROW = r"(?m)^[ \t]*\|"

ROW = re.compile(r"^[ \t]*\|")
RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
EDGE = " \t*_`"


def row_cells(line: str, at: int) -> list[tuple[str, int, int]]:
    """(text, start, end) of each cell, trimmed of blanks and emphasis; empty ones keep their column."""
    first = line.index("|") + 1
    out, begin = [], first
    body = line.rstrip(" \t\r")
    stop = len(body) - 1 if body.endswith("|") and len(body) > first else len(body)
    while begin <= stop:
        end = line.find("|", begin, stop)
        end = stop if end < 0 else end
        cell = line[begin:end]
        a = begin + len(cell) - len(cell.lstrip(EDGE))
        text = cell.strip(EDGE)
        out.append((text, at + a, at + a + len(text)))
        begin = end + 1
    return out


def cells(text: str) -> list[tuple[str, str, int, int]]:
    """(header, cell, start, end) of all tables: blocks of rows whose second row is a rule."""
    out: list[tuple[str, str, int, int]] = []
    block: list[tuple[str, int]] = []
    at = 0
    for line in [*text.split("\n"), ""]:
        if ROW.match(line):
            block.append((line, at))
        else:
            if len(block) >= 2 and RULE.match(block[1][0]) and "-" in block[1][0]:
                headers = [c[0] for c in row_cells(*block[0])]
                for row in block[2:]:
                    out += [(h, *c) for h, c in zip(headers, row_cells(*row), strict=False) if c[0]]
            block = []
        at += len(line) + 1
    return out


CELLS = "array<struct<header:string,cell:string,original_start:int,original_stop:int,start:int,stop:int>>"


def table_cells(text: Column) -> Column:
    """The cells of a page's tables, with their ranges in the original and in the normalised text; null for null."""
    return F.arrow_udf(_table_cells, CELLS)(text)


def _table_cells(texts: pa.Array) -> pa.Array:
    from veilspark.operators.offsets import normalize

    names = [field.split(":")[0] for field in CELLS.removeprefix("array<struct<").split(",")]
    out = []
    for text in texts.to_pylist():
        found = cells(text) if text is not None else None
        if found:
            _, starts, ends = normalize(text)
            found = [dict(zip(names, (h, c, a, b, bisect.bisect_left(starts, a), bisect.bisect_left(ends, b) + 1), strict=True)) for h, c, a, b in found]
        out.append(found)
    kinds = [pa.string()] * 2 + [pa.int32()] * 4
    return pa.array(out, pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))
