"""Operator 1: benchmark decontamination by template windows.

Words of items and documents become templates: numbers, names (capitalised words inside a
sentence, and at its start where the text also has them inside one) and units (after a number) turn into typed placeholders; other words are lower-cased and lose the
punctuation around them. Windows of five template words are hashed; a document is joined with
the items by the hashes of its windows. Where the windows of an item that a document holds
are aligned, slots are checked: one value of the item must stand for one value in the document, so
"3 apples for Ann ... Ann" may become "7 apples for Bob ... Bob" but not "... Eve": a text with other values than the item
of which one value of the item takes two is another text. (A copy that has the item's own values may have a slip in
one of them; it costs the windows that hold the slip.) Each occurrence is judged on its own: hits whose offsets (position
in the document less that in the item) are equal or close, and also all hits together, for an item that is spread over a
document. A leak is a document in which one of these holds at least 0.75 of an item's windows with consistent slots.

Items that differ in their slots' values only (and repeat them alike) are one class, which is searched once; a leak of it
is reported under the item whose values the document has, else under the least item_id, with the number of
items in the class.

The benchmark is a stated query set: it is read in blocks of at most BLOCK_WINDOWS windows, each of
which is broadcast (a proven bound: 16 bytes a window and the block's words) and held against
all documents in one pass without a shuffle, one block after the other. Neither documents nor hits are gathered anywhere.

Windows with fewer than three literal words are no evidence and are left out. Items without any
other window (under five words, in title case, or dense in numbers and names) are searched by windows of their
lower-cased words as they are, without placeholders; those under five words by all their words at once.

Defined results: null and empty texts hold no window and items without words never match; repeated documents are each reported;
repeated items are one class with the least item_id; empty tables give no rows; items with a null
item_id are searched and reported with a null item_id; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored
from veilspark.llm.words import TABLE_LIMIT, slices, texts, windows

WORDS = 5
LEAST_LITERALS = 3
SIMILARITY = 0.75
BLOCK_WINDOWS = 1_000_000
BITS = 22
EDGES = b".,;:!?\"'()[]{}<>*_`"
NUMBER = re.compile(rb"[+-]?[$#]?[0-9][0-9.,:/]*%?|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundred|thousand|million)")
#: Units that become placeholders after a number.
UNITS = frozenset(b"kg g mg km m cm mm mi ft in lb lbs oz l ml kilograms grams kilometers metres meters centimeters miles feet foot inches inch pounds ounces liters litres gallons seconds second minutes minute hours hour days day weeks week months month years year dollars dollar euros euro cents percent degrees mph kmh".split())
NUM, NAME, UNIT = (np.uint64(xxhash.xxh3_64_intdigest(b"\x00" + x)) for x in (b"number", b"name", b"unit"))
IS_NUM, IS_CAP, ENDS, IS_UNIT = 1, 2, 4, 8


class _Words(dict):
    """Hash of the bare word and flags, packed in one integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_LIMIT // 2:
            self.clear()
        bare = word.strip(EDGES) or word
        low = bare.lower()
        flags = IS_NUM * bool(NUMBER.fullmatch(low))
        flags |= IS_CAP * (len(bare) > 1 and bare[:1].isupper() and bare[1:].islower() and not flags)
        flags |= ENDS * (word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":"))
        flags |= IS_UNIT * (low in UNITS)
        value = (xxhash.xxh3_64_intdigest(low) & ~15) | flags
        if len(word) <= 64:
            self[word] = value
        return value


_words = _Words()


def template(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash of each word; which are placeholders; which capitalised words start a sentence, and which of these are names.

    Words that start a sentence are literals in the hashes; named() makes names of those that are also inside one.
    """
    packed = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    flags = (packed & np.uint64(15)).astype(np.uint8)
    h = packed & ~np.uint64(15)
    before = np.empty_like(flags)
    if len(words):
        before[0] = ENDS
        before[1:] = flags[:-1]
    num = flags & IS_NUM > 0
    name = (flags & IS_CAP > 0) & (before & ENDS == 0)
    unit = (flags & IS_UNIT > 0) & (before & IS_NUM > 0)
    start = (flags & IS_CAP > 0) & ~name & ~unit
    h[unit], h[num] = UNIT, NUM
    if name.any():
        start_names = np.isin(h, h[name]) & start
        h[name] = NAME
    else:
        start_names = np.zeros(len(h), dtype=bool)
    return h, num | name | unit, start, start_names


def named(h: np.ndarray, start_names: np.ndarray) -> np.ndarray:
    """The template with names also at the start of sentences."""
    return np.where(start_names, NAME, h)


def _forms(h: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
    """All other forms of a window: each word that starts a sentence may stand as a name."""
    at = np.flatnonzero(start)
    for pick in range(1, 1 << len(at)):
        out = h.copy()
        out[[x for i, x in enumerate(at) if pick >> i & 1]] = NAME
        yield out


def plain(words: list[bytes]) -> np.ndarray:
    """Hash of each bare lower-cased word."""
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words)) & ~np.uint64(15)


def _usable(slot: np.ndarray) -> np.ndarray:
    """Which windows have enough literal words."""
    total = np.concatenate(([0], np.cumsum(~slot)))
    return total[WORDS:] - total[:-WORDS] >= LEAST_LITERALS


class Block:
    """Windows of some classes of items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.words: list[list[bytes]] = []  # of one item of each class
        self.slot: list[np.ndarray] = []  # its words whose values may differ
        self.members: list[dict[tuple[bytes, ...], int | None]] = []  # least item_id by the slots' values
        self.sizes: list[int] = []
        self.need: list[int] = []
        self.plain: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by size of the window: (class, position) by hash
        self.exact: set[int] = set()
        classes: dict[bytes, int] = {}
        parts = []
        for item_id, words in items:
            h, slot, start, _ = template(words)
            ok = np.flatnonzero(_usable(slot)) if len(words) >= WORDS else np.empty(0, dtype=np.int64)
            plainly = not len(ok)
            slot = np.zeros(len(words) + WORDS, dtype=bool) if plainly else slot | start
            values = tuple(_bare(words[p]) for p in np.flatnonzero(slot).tolist())
            seen: dict[bytes, int] = {}
            kind = plain(words).tobytes() + b"plain" if plainly else h.tobytes() + bytes(slot) + repr([seen.setdefault(v, len(seen)) for v in values]).encode()
            k = classes.setdefault(kind, len(self.words))
            if k < len(self.words):
                self.sizes[k] += 1
                there = self.members[k].get(values, item_id)
                self.members[k][values] = item_id if there is None or (item_id is not None and item_id < there) else there
                continue
            self.words.append(words)
            self.slot.append(slot)
            self.members.append({values: item_id})
            self.sizes.append(1)
            size = min(WORDS, len(words))
            if plainly:
                own = windows(plain(words), size).tolist() if size else []
                self.need.append(len(own))
                self.exact.add(k)
                for p, x in enumerate(own):
                    self.plain.setdefault(size, defaultdict(list))[x].append((k, p))
                continue
            self.need.append(len(ok))
            w = windows(h, WORDS)
            parts.append((w[ok], np.full(len(ok), k), ok))
            for p in ok.tolist():  # whether a sentence's first word is a name hangs on the rest of the document
                if start[p : p + WORDS].any():
                    other = np.concatenate([windows(x, WORDS) for x in _forms(h[p : p + WORDS], start[p : p + WORDS])])
                    parts.append((other, np.full(len(other), k), np.full(len(other), p)))
        joined = [np.concatenate(x) if x else np.empty(0) for x in zip(*parts, strict=True)] if parts else [np.empty(0)] * 3
        order = np.argsort(joined[0].astype(np.uint64), kind="stable")
        self.hash, self.item, self.pos = joined[0].astype(np.uint64)[order], joined[1].astype(np.int64)[order], joined[2].astype(np.int64)[order]
        self.bits = np.zeros(1 << BITS, dtype=bool)
        self.bits[self.hash >> np.uint64(64 - BITS)] = True

    def hits(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """By class: (position in the document, position in the item) of equal windows."""
        h, _, _, names = template(words)
        w = windows(named(h, names), WORDS)
        at = np.flatnonzero(self.bits[w >> np.uint64(64 - BITS)])
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if len(at):
            lo, hi = np.searchsorted(self.hash, w[at], "left"), np.searchsorted(self.hash, w[at], "right")
            for d, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for x in range(a, b):
                    found[int(self.item[x])].append((d, int(self.pos[x])))
        if self.plain:
            h = plain(words)
        for size, index in self.plain.items():
            w = windows(h, size)
            for d in np.flatnonzero(np.isin(w, np.fromiter(index, dtype=np.uint64, count=len(index)))).tolist():
                for k, p in index[int(w[d])]:
                    found[k].append((d, p))
        return found

    def leaks(self, words: list[bytes]) -> list[tuple[int | None, int, int, float, bool, int]]:
        """(item_id, windows needed, windows held, similarity, reparameterised, items of the class) of each leak."""
        out = []
        for k, pairs in self.hits(words).items():
            least, best = SIMILARITY * self.need[k], None
            if len({p for _, p in pairs}) < least:
                continue
            own, slot = self.words[k], self.slot[k]
            for group in _occurrences(pairs, len(own), least):
                held, chosen, mixed = _consistent(group, own, words, slot)
                if held < least:
                    continue
                values = tuple(chosen.get(v := _bare(own[p]), v) for p in np.flatnonzero(slot).tolist())
                same = values in self.members[k]
                if mixed and not same:
                    continue
                if best is None or (held, same) > best[:2]:
                    best = held, same, values
            if best is not None:
                held, same, values = best
                ids = [self.members[k][values]] if same else [i for i in self.members[k].values() if i is not None]
                out.append((min(ids, default=None), self.need[k], held, held / self.need[k], not same, self.sizes[k]))
        return out


def _occurrences(pairs: list[tuple[int, int]], size: int, least: float) -> Iterator[list[tuple[int, int]]]:
    """Groups of hits that may be one copy of an item of `size` words: by equal offsets, by close ones, and all."""
    pairs = sorted(pairs, key=lambda x: (x[0] - x[1], x))
    seen = set()
    for gap in (0, WORDS, size // 2):
        a = 0
        for b in range(1, len(pairs) + 1):
            if b == len(pairs) or (pairs[b][0] - pairs[b][1]) - (pairs[b - 1][0] - pairs[b - 1][1]) > gap:
                if b - a >= least and (a, b) not in seen:
                    seen.add((a, b))
                    yield pairs[a:b]
                a = b
    if (0, len(pairs)) not in seen:
        yield pairs


def _consistent(pairs: list[tuple[int, int]], own: list[bytes], words: list[bytes], slot: np.ndarray) -> tuple[int, dict[bytes, bytes], bool]:
    """Windows of the item whose slots hold the values chosen for them, the value chosen for each of the item's, and whether one of these takes two."""
    votes: dict[bytes, Counter] = defaultdict(Counter)
    filled: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
    for d, p in pairs:
        both = [(_bare(own[p + j]), _bare(words[d + j])) for j in range(WORDS) if slot[p + j]]
        filled[d, p] = both
        for a, b in both:
            votes[a][b] += 1
    best = {a: min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}
    return len({p for (d, p), both in filled.items() if all(best[a] == b for a, b in both)}), best, any(len(c) > 1 for c in votes.values())


def _bare(word: bytes) -> bytes:
    return (word.strip(EDGES) or word).lower()


def blocks(benchmark: DataFrame, most: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks of at most `most` windows (one item at least), streamed to the driver."""
    items, n = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator(prefetchPartitions=False):
        words = (text or "").encode().split()
        if n and n + len(words) > most:
            yield Block(items)
            items, n = [], 0
        items.append((item_id, words))
        n += len(words)
    if items:
        yield Block(items)


LEAKS = "doc_id long, item_id long, n_windows long, n_held long, similarity double, reparameterised boolean, n_items long"


def leaks(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each document and each class of items that it leaks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(benchmark, most):
        if out is not None:
            out = stored(out, "leaks")  # so that only one block is held at a time
            shared.unpersist()
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for x in shared.value.leaks(t.split())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.bool_(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in LEAKS.split(", ")])

        one = docs.mapInArrow(run, LEAKS)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], LEAKS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    sc = docs.sparkSession.sparkContext
    at, shared = docs.columns.index("text"), None
    for block in blocks(benchmark, most):
        if shared is not None:
            docs = stored(docs, "not-leaking")
            shared.unpersist()
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = [not shared.value.leaks(t.split()) for t in texts(batch, batch.schema.names[at])]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
