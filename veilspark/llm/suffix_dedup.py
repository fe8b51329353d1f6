"""Operator 10: repeated passages by the common-prefix interval tree of enhanced suffix arrays.

Every string of 100 bytes that also starts earlier is removed. Equal 100-byte strings must meet, so they are
dealt out by content: of the 51 grams of 50 bytes in a string, the one with the least hash (the leftmost of
equals) is its anchor, and equal strings have equal anchors at equal places. Only anchors that occur twice or
more anywhere matter; around those, the strings with that anchor are brought together as short contexts.

Where contexts meet, an enhanced suffix array is built over the starts of their strings: suffixes in order and
the lengths of common prefixes between neighbours. A stack scan yields the common-prefix intervals of
100 bytes or more, each of which stands for one repeat with all of its occurrences; an interval whose
occurrences can all be extended to the left by the same byte is not maximal and is left to the
extended one. Of each maximal repeat all occurrences but the earliest are covered.

Texts are shuffled once, into a bucketed table; whole copies of a text are settled by a hash. Occurrences that
repeat within one task are settled there, so a hot passage sends one context a task; anchors with more
occurrences than one task should get (their number is bounded by the share they need) send the
hashes of their strings instead, which spread by string.

Defined results: a null text counts as empty, with the digest of no bytes; texts under 100 bytes keep all;
a null doc_id comes after all others; rows that share a doc_id but not the text are ordered by a hash of the
text; rows equal in both are one document and get equal results; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import scratch_path, stored
from veilspark.llm.words import mixed, slices, texts

LENGTH = 100
GRAM = 50
SPAN = LENGTH - GRAM + 1  # grams in a string
SEGMENT = 1 << 19  # string starts worked on at a time
TABLE = 200_000  # entries of a task's tables
HOT_ANCHORS = 1 << 18  # at most so many anchors are hot
LEAST_HOT = 5_000
CHUNK = 60_000  # suffixes sorted at a time
PART_BYTES = 32 << 20  # of text for each partition
LAST = (1 << 63) - 1
FACTOR = 0x9E3779B97F4A7C15
#: digest = own, said so that it stays a filter: as a second join key it would have the texts shuffled anew.
SAME = "not (digest < own or digest > own)"
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers 0 to n - 1, and to their negatives, modulo 2^64."""
    up, down = (np.full(n, f, dtype=np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up, dtype=np.uint64), np.multiply.accumulate(down, dtype=np.uint64)


_table: list[tuple[np.ndarray, np.ndarray]] = []


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n bytes."""
    m = len(data) - n + 1
    if not _table or len(_table[0][0]) < len(data):
        _table[:] = [_powers(max(len(data), SEGMENT + 4 * LENGTH))]
    up, down = _table[0]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[data] * up[: len(data)], dtype=np.uint64)))
    return mixed((total[n:] - total[:-n]) * down[:m])


def leftmost_least(h: np.ndarray, n: int) -> np.ndarray:
    """Where the least of each n neighbours is; the leftmost of equals."""
    at, value, width = np.arange(len(h)), h, 1
    while width < n:
        step = min(width, n - width)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.minimum(value[step:], value[:-step])
        width += step
    return at


def runs(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor's hash, its place, first and last start of the strings it anchors), segment by segment."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data) - LENGTH + 1
    for a in range(0, max(n, 0), SEGMENT):
        b = min(n, a + SEGMENT)
        h = rolling(data[a : b + LENGTH - 1], GRAM)
        at = leftmost_least(h, SPAN)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        place = at[first]
        yield h[place], place + a, first + a, last + a


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, d, x, n): n = 1 for an anchor not seen before in this task, else 0; count rows have d null."""
    more: dict[int, int] = {}

    def batch_of(k: np.ndarray, d: list | np.ndarray | None, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(k.view(np.int64)), pa.nulls(len(k), pa.int64()) if d is None else pa.array(d, pa.int64()), pa.array(x, pa.int64()), pa.array(n, pa.int64())], names=["k", "d", "x", "n"])

    def flushed() -> pa.RecordBatch:
        k, n = np.fromiter(more, dtype=np.uint64, count=len(more)), np.fromiter(more.values(), dtype=np.int64, count=len(more))
        more.clear()
        return batch_of(k[n > 0], None, np.zeros(int((n > 0).sum()), dtype=np.int64), n[n > 0])

    for batch in slices(batches, most_bytes=2 << 20):
        parts = []
        for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
            for h, place, _, _ in runs(text):
                parts.append((h, np.full(len(h), d, dtype=np.int64), place + (t << 40)))
        if not parts:
            continue
        h, d, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        # One document may name an anchor's place twice, where segments meet: that is one occurrence.
        values, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        n = np.zeros(len(h), dtype=np.int64)
        n[first] = 1
        k = h.copy()
        for i in np.flatnonzero(count > 1).tolist():
            v = int(values[i])
            if v in more:
                n[first[i]] = 0
                more[v] += int(count[i])
            else:
                more[v] = int(count[i]) - 1
        again = n == 0
        k[again] = mixed(h[again] ^ mixed(d[again].astype(np.uint64) + x[again].astype(np.uint64)))
        yield batch_of(k, d, x, n)
        if len(more) > TABLE:
            yield flushed()
    if more:
        yield flushed()


def _repeated(hot_from: int):
    """Of anchors dealt by k: those that occur twice or more; and the hashes with hot_from occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        counts: list[list[np.ndarray]] = [[], []]
        for b in batches:
            row = np.asarray(b.column(1).is_valid())
            k, x, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            d = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for out, c in zip(columns, (k, d, x, n), strict=True):
                out.append(c[row])
            counts[0].append(k[~row])
            counts[1].append(n[~row])
        if not columns[0]:
            return
        k, d, x, n = (np.concatenate(c) for c in columns)
        ck, cn = (np.concatenate(c) for c in counts)
        fresh = n > 0
        values, inverse = np.unique(np.concatenate((k[fresh], ck)), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate((np.ones(fresh.sum()), cn)), minlength=len(values))
        keep = ~fresh
        keep[fresh] = total[inverse[: fresh.sum()]] >= 2
        d, x, hot = d[keep], x[keep], values[total >= hot_from]
        for a in range(0, len(d), 100_000):
            m = len(d[a : a + 100_000])
            yield pa.record_batch([pa.array(np.zeros(m, dtype=bool)), pa.array(d[a : a + m]), pa.array(x[a : a + m])], names=["hot", "d", "x"])
        if len(hot):
            yield pa.record_batch([pa.array(np.ones(len(hot), dtype=bool)), pa.array(np.zeros(len(hot), dtype=np.int64)), pa.array(hot)], names=["hot", "d", "x"])

    return run


PARTS = "k long, d long, x long, kind int, n long, context binary"
CONTEXT, STRING, SETTLED = 0, 1, 2


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _contexts(hot: np.ndarray):
    """Contexts of repeated anchors. kind: a context (n: 1 if it begins with the byte before), a string of a
    hot anchor, or a settled span of n bytes."""
    hot = np.sort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for batch in slices(batches, most_bytes=1 << 20):
            rows: list[tuple] = []

            def add(key: int, k: int, d: int, x: int, kind: int, n: int, context: bytes, whole: int) -> None:
                seen = least.get(key)
                if seen is not None and seen < (d, x):
                    rows.append((0, d, x, SETTLED, whole, b""))  # noqa: B023
                    return
                if seen is None and len(least) > TABLE:
                    least.clear()
                if seen != (d, x):
                    least[key] = (d, x)
                rows.append((k, d, x, kind, n, context))  # noqa: B023

            order = np.argsort(np.array(batch.column(0).to_pylist(), dtype=np.int64), kind="stable").tolist()
            ds, ts, xs, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), texts(batch)
            for r in order:
                d, t, text = ds[r], ts[r], bodies[r]
                wanted = np.array(xs[r], dtype=np.int64)
                wanted = np.sort(wanted[wanted >> 40 == t] & ((1 << 40) - 1))
                for h, place, first, last in runs(text):
                    pick = _among(place, wanted)
                    is_hot = _among(h[pick].view(np.int64), hot)
                    for k, a, b, many in zip(h[pick].view(np.int64).tolist(), first[pick].tolist(), last[pick].tolist(), is_hot.tolist(), strict=True):
                        whole = text[a : b + LENGTH]
                        x = (t << 40) + a
                        if not many:
                            left = int(a > 0)
                            add(xxhash.xxh3_64_intdigest(whole), k, d, x, CONTEXT, left, text[a - left : a] + whole, len(whole))
                        else:
                            for i, key in enumerate(rolling(np.frombuffer(whole, dtype=np.uint8), LENGTH).view(np.int64).tolist()):
                                add(key ^ 1, key, d, x + i, STRING, 0, b"", LENGTH)
            if rows:
                *numbers, context = zip(*rows, strict=True)
                k, d, x, kind, n = (np.array(c, dtype=np.int64) for c in numbers)
                k = np.where(kind == SETTLED, mixed((d ^ x).view(np.uint64)).view(np.int64), k)  # settled spans are dealt by their place
                yield pa.record_batch([pa.array(k), pa.array(d), pa.array(x), pa.array(kind.astype(np.int32)), pa.array(n), pa.array(context, pa.binary())], names=[c.split(" ")[0] for c in PARTS.split(", ")])

    return run


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts (each up to its end), and the common prefix of each with the one before.

    data holds no zero byte; the first prefix length is 0.
    """
    padded = np.concatenate((data, np.zeros(reach, dtype=np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, reach)[starts]
    rows = np.where(np.arange(reach)[None, :] < (ends - starts)[:, None], rows, 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{reach}").ravel(), kind="stable")
    rows = rows[order]
    same = (rows[1:] == rows[:-1]) & (rows[1:] != 0)
    common = np.where(same.all(axis=1), reach, np.argmin(same, axis=1)) if len(rows) > 1 else np.empty(0, dtype=np.int64)
    return order, np.concatenate((np.zeros(min(1, len(rows)), dtype=np.int64), common))


def maximal_intervals(common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of each common-prefix interval of at least `least` whose left bytes differ.

    common: prefix lengths between neighbours in suffix order; left: the byte before each suffix in that order,
    0 if it has none, in which case it cannot be extended. The stack holds the open intervals as
    length, first suffix and the one left byte they have so far (-1 if several).
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []
    lefts = left.tolist()
    for i in range(1, len(lefts) + 1):
        c = int(common[i]) if i < len(lefts) else 0
        first, byte = i - 1, lefts[i - 1] or -1
        while stack and stack[-1][0] > c:
            length, first, own = stack.pop()
            byte = own if own == byte else -1
            if byte == -1:
                out.append((first, i - 1, length))
        if c < least:
            continue
        if stack and stack[-1][0] == c:
            stack[-1][2] = byte if stack[-1][2] == byte else -1
        else:
            stack.append([c, first, byte])
    return out


def covered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, rank: np.ndarray, least: int = LENGTH, reach: int = 2 * LENGTH) -> np.ndarray:
    """Which bytes of data lie in an occurrence, but the earliest, of a maximal repeat. rank: order of occurrences."""
    step = np.zeros(len(data) + 1, dtype=np.int64)
    if len(starts) > 1:
        order, common = suffix_array(data, starts, ends, reach)
        found = np.array(maximal_intervals(common, left[order], least), dtype=np.int64).reshape(-1, 3)
        if len(found):
            size = found[:, 1] - found[:, 0] + 1
            head = np.concatenate(([0], np.cumsum(size)[:-1]))
            member = np.repeat(found[:, 0] - head, size) + np.arange(size.sum())
            own = rank[order][member]
            later = own > np.repeat(np.minimum.reduceat(own, head), size)
            at, length = starts[order][member[later]], np.repeat(found[:, 2], size)[later]
            np.add.at(step, at, 1)
            np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def _ranks(d: np.ndarray, x: np.ndarray) -> np.ndarray:
    order = np.lexsort((x, d))
    new = np.concatenate(([False], (np.diff(d[order]) != 0) | (np.diff(x[order]) != 0)))
    out = np.empty(len(d), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _met(k: np.ndarray, d: np.ndarray, x: np.ndarray, left: np.ndarray, contexts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(d, x, n) of the spans to remove, from contexts in the order of k."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    strings = sizes - left - LENGTH + 1
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    groups = np.flatnonzero(new_key)
    single = np.diff(np.append(groups, len(k))) == 1
    total = np.cumsum(strings)
    a = 0
    while a < len(groups):
        base = total[groups[a]] - strings[groups[a]]
        b = max(a + 1, int(np.searchsorted(total[np.append(groups[1:], len(k)) - 1], base + CHUNK, side="right")))
        rows = np.arange(groups[a], groups[b] if b < len(groups) else len(k))
        rows = rows[~np.repeat(single[a:b], np.diff(np.append(groups[a:b], rows[-1] + 1)))]
        a = b
        if not len(rows):
            continue
        data = np.frombuffer(b"".join(contexts[i] for i in rows.tolist()), dtype=np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
        end = np.cumsum(sizes[rows])
        begin = end - sizes[rows] + left[rows]
        n = strings[rows]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(begin, n) + within
        before = np.where(within > 0, data[np.maximum(starts - 1, 0)], 0).astype(np.int64)
        rank = _ranks(np.repeat(d[rows], n), np.repeat(x[rows], n) + within)
        marks = np.zeros(len(data), dtype=bool)
        pieces = -(-len(starts) // (4 * CHUNK))
        deal = rolling(data, LENGTH)[starts] % np.uint64(pieces) if pieces > 1 else None
        for piece in range(pieces):
            s = slice(None) if deal is None else deal == piece
            marks |= covered(data, starts[s], np.repeat(end, n)[s], before[s], rank[s])
        edge = np.diff(np.concatenate(([0], marks.view(np.int8), [0])))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # A run may reach over contexts: cut it where they meet.
        cuts = np.unique(np.concatenate((lo, end[:-1][(end[:-1] < len(data)) & marks[np.minimum(end[:-1], len(data) - 1)]])))
        row = np.searchsorted(end, cuts, side="right")
        stop = np.minimum(hi[np.searchsorted(hi, cuts, side="right")], end[row])
        yield d[rows][row], x[rows][row] + cuts - begin[row], stop - cuts


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple] = []
    contexts: list[bytes] = []
    for b in batches:
        parts.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(5)))
        contexts += b.column(5).to_pylist()
    if not parts:
        return
    k, d, x, kind, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    out = [(d[kind == SETTLED], x[kind == SETTLED], n[kind == SETTLED])]
    s = np.flatnonzero(kind == STRING)
    if len(s):
        rank = _ranks(d[s], x[s])
        _, inverse = np.unique(k[s], return_inverse=True)
        first = np.full(inverse.max() + 1, len(s), dtype=np.int64)
        np.minimum.at(first, inverse, rank)
        s = s[rank > first[inverse]]
        out.append((d[s], x[s], np.full(len(s), LENGTH, dtype=np.int64)))
    c = np.flatnonzero(kind == CONTEXT)
    c = c[np.argsort(k[c], kind="stable")]
    if len(c):
        out += list(_met(k[c], d[c], x[c], n[c], [contexts[i] for i in c.tolist()]))
    d, x, n = (np.concatenate(v) for v in zip(*out, strict=True))
    for a in range(0, len(d), 100_000):
        yield pa.record_batch([pa.array(v[a : a + 100_000], pa.int64()) for v in (d, x, n)], names=["d", "x", "n"])


def _joined(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of the spans of n bytes at x."""
    order = np.argsort(x, kind="stable")
    x, reach = x[order], np.maximum.accumulate(x[order] + n[order])
    new = np.concatenate((np.ones(min(1, len(x)), dtype=bool), x[1:] > reach[:-1]))
    return x[new], reach[np.append(new[1:], True)] if len(x) else x


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        ds, ts, whole = (batch.column(i).to_pylist() for i in (0, 1, 3))
        spans = batch.column(4)
        places, sizes = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cut, there = spans.offsets.to_pylist(), spans.is_valid().to_pylist()
        for i, text in enumerate(texts(batch)):
            n, starts, stops = len(text), [], []
            if whole[i] and n >= LENGTH:
                starts, stops = [0], [n]
            elif there[i]:
                x, size = places[cut[i] : cut[i + 1]], sizes[cut[i] : cut[i + 1]]
                own = x >> 40 == ts[i]
                starts, stops = (v.tolist() for v in _joined(x[own] & ((1 << 40) - 1), size[own]))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(starts, stops, strict=True):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((ds[i], n, sum(stops) - sum(starts), len(starts), digest.hexdigest()))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, (*[pa.int64()] * 4, pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A task gathers what meets in its partition: their number follows the input.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -int(-size // PART_BYTES))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(text).bitwiseAND((1 << 22) - 1).alias("t"),
        F.md5(text.cast("binary")).alias("digest"),
        text.alias("text"),
    )
    name = f"texts_{uuid.uuid4().hex}"
    rows.repartition(parts, "d").write.option("path", scratch_path(spark, "texts")).option("compression", "zstd").bucketBy(parts, "d").saveAsTable(name)
    whole = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files and the plans that read them stay

    known = whole.select("d", "digest", F.octet_length("text").alias("n")).groupBy("d", "digest").agg(F.max("n").alias("n"))
    first = known.groupBy("digest").agg(F.min("d").alias("least"))
    flags = stored(known.join(first, "digest").select("d", F.col("digest").alias("own"), "n", (F.col("d") > F.col("least")).alias("copy")), "copies")
    total = flags.agg(F.coalesce(F.sum(F.when(~F.col("copy"), F.col("n"))), F.lit(0))).first()[0]
    firsts = whole.join(flags.filter(f"not copy and n >= {LENGTH}").select("d", "own").hint("shuffle_hash"), "d").filter(SAME)

    hot_from = max(LEAST_HOT, 2 * total // SPAN * 2 // HOT_ANCHORS)
    anchors = firsts.select("d", "t", "text").mapInArrow(_anchors, "k long, d long, x long, n long")
    repeated = stored(anchors.repartition(parts, "k").mapInArrow(_repeated(hot_from), "hot boolean, d long, x long"), "anchors")
    hot = np.array([r[0] for r in repeated.filter("hot").select("x").collect()], dtype=np.int64)  # HOT_ANCHORS rows at most

    places = repeated.filter("not hot").groupBy("d").agg(F.collect_list("x").alias("xs"))
    near = firsts.join(places.hint("shuffle_hash"), "d").select("d", "t", "text", "xs")
    met = near.mapInArrow(_contexts(hot), PARTS).repartition(parts, "k").mapInArrow(_spans, "d long, x long, n long")
    spans = stored(met, "spans").groupBy("d").agg(F.collect_list(F.struct("x", "n")).alias("spans"))

    judged = whole.join(flags.select("d", "own", "copy").hint("shuffle_hash"), "d").filter(SAME)
    side = judged.join(spans.hint("shuffle_hash"), "d", "left")
    return side.select("doc_id", "t", "text", "copy", "spans").mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
