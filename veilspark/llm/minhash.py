"""Operator 9: near-duplicates by SuperMinHash, banding, verification and components.

Each document's set is its distinct five-word shingles, as 64-bit hashes. In SuperMinHash every element
walks its own pseudo-random permutation of the signature's places and offers rank + fraction to
each; ranks are correlated within a signature, which lowers the variance, and the walk stops when no
later rank can lower any place. Here all elements of a batch walk in step, rank by rank, which gives
the same minima. 32 bands of 4 places make candidates: a pair of similarity 0.75 shares no
band with probability (1 - 0.75^4)^32, about 5 in a million.

Documents with equal sets are one node. Within a band's bucket nodes are never paired all with all: each
is held against the bucket's leader, on the full sets. Nodes of buckets that this leaves in several
components (a passage shared by unlike texts puts them together) are settled exactly: similar sets share one of
their rarest shingles, so groups by those are held against a few leaders a round, until a group is in
one component or each node outside its largest one has led. None is lost to a cap. Components come from
links by stars (graph.py). Nothing grows on the driver.

Defined results: a text without words (null, empty, white space) has an empty set, is linked with nothing
and stays; with fewer than five words the whole sequence is its one shingle; rows that share a
doc_id are one document, linked by any of its texts; rows without doc_id are linked with nothing, have a
null component and stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored
from veilspark.llm.graph import components
from veilspark.llm.words import MIX, hashes_of, mixed, slices, texts, windows

SHINGLE = 5
PLACES = 128
ROWS = 4
SIMILARITY = 75  # per cent
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(hashes_of(words), min(SHINGLE, len(words))))


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each non-empty set: rank in the high 16 bits, fraction in the low 48."""
    n = len(sets)
    least = np.full(n * places, NEVER, dtype=np.uint64)
    if not n:
        return least.reshape(0, places)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = None
    for rank in range(places):
        draw = mixed(element + np.uint64(rank + 1) * MIX)
        pick = rank + ((mixed(draw) >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            row = np.arange(len(element))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, rank]
            order[:, rank] = place
        np.minimum.at(least, owner * places + place, (np.uint64(rank) << np.uint64(48)) | (draw >> np.uint64(16)))
        open_ = (least.reshape(n, places) >> np.uint64(48)).max(axis=1) > rank
        if not open_.any():
            break
        keep = open_[owner]
        if order is None:
            element, owner, pick = element[keep], owner[keep], pick[keep]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), pick] = 0
            order[:, 0] = pick
        elif keep.mean() < 0.7:
            element, owner, order = element[keep], owner[keep], order[keep]
    return least.reshape(n, places)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most_bytes=2 << 20):
        sets = [shingles(t) for t in texts(batch)]
        filled = [i for i, s in enumerate(sets) if len(s)]
        sig = signatures([sets[i] for i in filled])
        band = np.arange(PLACES // ROWS, dtype=np.uint64)[None, :]
        keys = mixed(windows_of_rows(sig) + band * MIX).view(np.int64)
        bands: list[np.ndarray | None] = [None] * len(sets)
        for k, i in enumerate(filled):
            bands[i] = keys[k]
        digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([d & (2**64 - 1) for d in digest], dtype=np.uint64).view(np.int64), pa.int64()),
                pa.array(np.array([d >> 64 for d in digest], dtype=np.uint64).view(np.int64), pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "f1", "f2", "bands"],
        )


def windows_of_rows(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = sig.reshape(len(sig), PLACES // ROWS, ROWS)
    out = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * MIX + parts[:, :, k])
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.record_batch([batch.column(0), pa.array([shingles(t).tobytes() for t in texts(batch)], pa.binary())], names=["node", "items"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for s, t in zip(x, y, strict=True):
            s, t = np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64)
            n = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * n >= SIMILARITY * (len(s) + len(t) - n))
        yield pa.record_batch([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A hot side is split by adaptive execution."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    small, large = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    both = left.join(right, "b").filter(F.lit(100) * small >= F.lit(SIMILARITY) * large).select("a", "b", "x", "y")
    return both.mapInArrow(_overlaps, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sketches")
    full = sketch.filter("n_shingles > 0 and doc_id is not null")
    print_of = ["n_shingles", "f1", "f2"]
    copies = stored(full.groupBy(print_of).agg(F.min("doc_id").alias("node")), "copies", narrow=True)
    nodes = full.join(copies.withColumnRenamed("node", "doc_id"), [*print_of, "doc_id"], "left_semi")
    places = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = stored(places.join(shared, "key").select("key", "node").distinct(), "members", narrow=True)

    involved = stored(members.select("node").distinct(), "involved", narrow=True)
    own = docs.join(involved.select(F.col("node").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    sets = stored(own.mapInArrow(_sets, "node long, items binary").dropDuplicates(["node", "items"]), "sets")

    # First each node against the least leader of its buckets, then against the leaders of all of them.
    leaders = members.groupBy("key").agg(F.min("node").alias("b"))
    led = stored(members.join(leaders, "key").filter("node <> b"), "led", narrow=True)
    first = led.groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b"))
    component = _merged(involved.select("node", F.col("node").alias("component")), _verified(first, sets))
    component = _merged(component, _verified(_apart(led.select(F.col("node").alias("a"), "b").distinct(), component), sets))
    # What shares a bucket without a link to its leader is settled exactly, by the rarest shingles.
    open_ = members.join(component, "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("n > 2 and x < y")
    crowd = stored(members.join(open_.select("key"), "key", "left_semi").select("node").distinct(), "crowd", narrow=True)
    if not crowd.isEmpty():
        sets = stored(sets.join(crowd, "node", "left_semi"), "crowd-sets", narrow=True)  # all that the rounds read of the sets
        component = _settled(_prefixes(sets), component, sets)

    return (
        sketch.join(copies, print_of, "left")
        .join(component, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("node")), "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component yet."""
    ends = pairs.join(component.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(component.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    return ends.filter("ca <> cb").select("a", "b")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
        if sets:
            nodes = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.record_batch([pa.array(nodes), pa.array(np.concatenate(sets))], names=["node", "key"])


def _prefixes(crowd: DataFrame) -> DataFrame:
    """(key, node, n, p, short): each node's rarest shingles, so many that similar sets must share one of them.

    In any one order of all shingles, the first that two sets of similarity t share is among the first
    n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller (marked short). Here
    shingles are ordered by their counts among the crowd, which are joined: no table of them has a bound.
    """
    items = crowd.select("node", "items").mapInArrow(_items, "node long, key long")
    several = items.groupBy("key").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    counted = items.join(several, "key", "left").select("node", F.struct(F.coalesce("count", F.lit(1)).alias("count"), "key").alias("x"))
    sets = counted.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.count(F.lit(1)).alias("n"))
    first = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1
    short = F.col("n") - F.ceil(F.col("n") * (2 * SIMILARITY) / (100 + SIMILARITY)) + 1
    places = sets.select("node", "n", short.alias("s"), F.posexplode(F.slice("xs", F.lit(1), first.cast("int"))).alias("p", "x"))
    # What only one node has puts it in no group.
    places = places.filter("x.count > 1").select("x.key", "node", "n", F.col("p").cast("long").alias("p"), (F.col("p") < F.col("s")).alias("short"))
    places = stored(places, "prefixes")
    groups = places.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("short").alias("s")).filter("k > 1 and s").select("key")
    return stored(places.join(groups, "key"), "prefix-members", narrow=True)


def _settled(members: DataFrame, component: DataFrame, sets: DataFrame) -> DataFrame:
    """component after all links inside the groups of members. A group is done when it is in one component, or
    when each of its nodes outside its largest component has led once; every round has sixteen times the leaders."""
    led, wide = None, 8
    while True:
        placed = members.join(component, "node")
        sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max_by("component", F.struct("n", -F.col("component"))).alias("largest")).filter("k > 1").drop("k")
        waiting = stored(placed.join(largest, "key"), "waiting", narrow=True)
        own = F.struct("node", "component", "n", "p", "short")
        able = waiting.filter("component <> largest").select("key", "node", own.alias("own"))
        if led is not None:
            able = able.join(led, ["key", "node"], "left_anti")
        turn = able.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(wide))).agg(F.min("own").alias("own"))
        turn = stored(turn.select("key", "own.*"), "leaders", narrow=True)
        if turn.isEmpty():
            return component
        lead = turn.select("key", F.col("node").alias("b"), F.col("component").alias("c"), F.col("n").alias("bn"), F.col("p").alias("bp"), F.col("short").alias("bs"))
        # Sizes, the smaller set's mark, and what can follow a first shared shingle must allow the similarity.
        near = (F.lit(100) * F.least("n", "bn") >= F.lit(SIMILARITY) * F.greatest("n", "bn")) & ((F.col("short") & (F.col("n") <= F.col("bn"))) | (F.col("bs") & (F.col("bn") <= F.col("n"))))
        room = F.lit(100 + SIMILARITY) * F.least(F.col("n") - F.col("p"), F.col("bn") - F.col("bp")) >= F.lit(SIMILARITY) * (F.col("n") + F.col("bn"))
        pairs = waiting.join(lead, "key").filter((F.col("component") != F.col("c")) & near & room).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        done = turn.select("key", "node")
        led = stored(done if led is None else led.union(done), "led", narrow=True)
        component = _merged(component, _verified(pairs, sets))
        wide *= 16


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (node, component) after the links (a, b) are added."""
    links = stored(links, "links", narrow=True)
    if links.isEmpty():
        return component
    ends = links.join(component.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(component.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    joined = components(ends.select("ca", "cb"))
    new = joined.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return stored(component.join(new, "component", "left").select("node", F.coalesce("merged", "component").alias("component")), "components", narrow=True)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; of rows that share a doc_id one stays."""
    verdict = stored(near_duplicates(docs).select("doc_id", "kept"), "near-verdict", narrow=True)
    known = verdict.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    known = stored(known.filter("kept"), "near-kept", narrow=True)
    one = docs.join(known.filter("n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    many = known.filter("n > 1").select("doc_id")
    if not many.isEmpty():
        one = one.unionByName(docs.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
    nameless = docs.filter(F.col("doc_id").isNull())
    return one if nameless.isEmpty() else one.unionByName(nameless)
