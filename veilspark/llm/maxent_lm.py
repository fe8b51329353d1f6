"""Operator 5: a hashed maximum-entropy language model with a class-factored softmax.

Tokens are the words (A-Z lower-cased) and one end for each text; the words of many texts are hashed at once, by
arrays. All tokens are counted, by hash, in one aggregation. Words are classed by frequency: sorted by their counts they are cut into FAN classes of near equal
mass, each of these into FAN again, down to single leaves. log P(w | history) is the sum of log P(class | class
around it, history) over the nested classes of w, each a softmax of FAN whose logits are the counts' own and the sum of
hashed weights of three features: the previous word, the previous two, and the one before the previous (a
skip) on the upper levels, and of the previous word alone below them. Frequent words (below) have a leaf each; the others are dealt to shared leaves by hash, and inside such
a leaf they follow their smoothed counts. Every word is thus predicted from its history, by about as many
softmaxes as its count says in digits, and the model is a proper distribution.

Sizes follow the counted words: there are at least as many leaves as words and as many rows of weights as words,
until the bounds of what is broadcast: HOT + MOST_SHARED leaves, 2 ** MOST_BITS rows. Beyond them more words share a
leaf and more histories a row; none is left out.

Training reads every training text once, half of them in each of two rounds: the workers start from the broadcast
weights, take stochastic gradient steps over their own texts in sparse numpy batches (a row's steps shrink with the root of
how often it was met), and emit what their steps changed in blocks of rows. The changes of a row are averaged by how often each worker met it, a task taking some blocks; only
the averaged weights (a fixed size) come to the driver.

Counts of frequent tokens are broadcast: those with at least 1/HOT of all tokens, of which there cannot be
more than HOT. Occurrences of the others are joined with the count table by hash; each has few
occurrences by definition, so no key of that join is hot.

Defined results: a null text counts as empty and has the end only; a null doc_id counts as the empty text
in the fold (held out); repeated rows are each counted, and scored alike; without training texts both
scores are 0; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored
from veilspark.llm.words import MIX, flat_words, mixed, slices, texts

HOT = 1 << 18
MOST_SHARED = 1 << 18
FAN = 8
LEAST_BITS, MOST_BITS = 14, 18
UPPER = 2  # levels whose classes see all three features; the classes below them see the previous word
ROUNDS = 2
RATE = 0.25
BATCH = 8192
LEAST_TASKS, PER_TASK = 16, 4  # of a round, and input partitions for each: every task emits the weights once
SMOOTHING = 0.1
MOST_SEEN = 300_000  # distinct tokens that a worker counts before it hands them on
END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
START = np.uint64(xxhash.xxh3_64_intdigest(b"\x00start"))
SALT = [np.uint64(xxhash.xxh3_64_intdigest(b"salt%d" % i) | 1) for i in range(6)]
ONES = np.ones(FAN, dtype=np.float32)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the end of each text, one text behind the other, and where each text's tokens start."""
    words, n = flat_words(parts)
    out = np.full(len(words) + len(parts), END)
    out[np.arange(len(words)) + np.repeat(np.arange(len(parts)), n)] = words
    return out, np.cumsum(n + 1) - (n + 1)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(token, c, a) of all parts, each token once with the sums of its counts."""
    token, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(token)
    token = token.take(order)
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    return token.take(first), *(np.add.reduceat(x.take(order), first) for x in counts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, c, a): occurrences in training texts and in all."""
    parts: list[tuple[np.ndarray, ...]] = []
    row_batch = lambda x: pa.record_batch([pa.array(y, pa.int64()) for y in x], names=["token", "c", "a"])
    for batch in slices(batches):
        own: tuple[list, list] = ([], [])
        for d, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            own[held_out(d)].append(t)
        for out, part in enumerate(own):
            if part:
                token, n = np.unique(tokens(part)[0].view(np.int64), return_counts=True)
                parts.append((token, np.zeros_like(n) if out else n, n))
        if sum(len(x[0]) for x in parts) > 2 * MOST_SEEN:
            parts = [_summed(parts)]
            if len(parts[0][0]) > MOST_SEEN:
                yield row_batch(parts.pop())
    if parts:
        yield row_batch(_summed(parts))


@dataclass
class Model:
    """Counts of the frequent tokens, the nested classes and the weights."""

    token: np.ndarray  # sorted hashes of the frequent tokens
    count: np.ndarray  # their counts in training texts
    n: int  # training tokens
    v: int  # distinct training tokens
    leaf: np.ndarray = field(init=False)  # own leaf of each frequent token, or -1
    own: int = field(init=False)  # number of these; the shared leaves follow
    mass: np.ndarray = field(init=False)  # of each leaf
    w: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.lexsort((self.token, -self.count))
        order = order[self.count[order] > 0]
        self.own = len(order)
        self.leaf = np.full(len(self.token), -1, dtype=np.int64)
        self.leaf[order] = np.arange(self.own)
        self.mass = np.full(self.own + min(max(1, self.v - self.own), MOST_SHARED), SMOOTHING)  # an unseen word may fall into any shared leaf
        self.mass[: self.own] = self.count[order]
        self.w = np.zeros((1 << weight_bits(self.v), FAN), dtype=np.float32)
        self._classes()

    def grow(self, leaf: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        """Class the words again, with the occurrences and the number of the words that share each leaf."""
        self.mass[leaf] += n + SMOOTHING * v
        self._classes()

    def _classes(self) -> None:
        """Node and child of each leaf on each level, and the bias of each node's children."""
        order = np.argsort(-self.mass, kind="stable")
        ends = np.concatenate(([0.0], np.cumsum(self.mass[order])))
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []
        biases, first = [], 0
        lo, hi = np.array([0]), np.array([len(order)])
        steps = np.arange(1, FAN)
        while len(lo):
            cuts = np.searchsorted(ends, ends[lo][:, None] + (ends[hi] - ends[lo])[:, None] * steps / FAN)
            cuts = np.maximum.accumulate(np.maximum(cuts, lo[:, None] + steps) - steps, axis=1) + steps  # one leaf at least in each
            cuts = np.minimum(np.minimum(cuts, np.maximum(hi[:, None] - FAN, lo[:, None]) + steps), hi[:, None])
            edges = np.concatenate((lo[:, None], cuts, hi[:, None]), axis=1)
            part = ends[edges[:, 1:]] - ends[edges[:, :-1]]
            with np.errstate(divide="ignore"):
                biases.append(np.maximum(np.log(part / part.sum(axis=1, keepdims=True)), -1e3).astype(np.float32))
            sizes = (edges[:, 1:] - edges[:, :-1]).ravel()
            at = np.repeat(np.arange(len(sizes)), sizes)  # child of each leaf below, numbered through the level
            leaves = order[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))]
            node, child = np.full(len(order), -1, dtype=np.int32), np.zeros(len(order), dtype=np.int8)
            node[leaves], child[leaves] = first + at // FAN, at % FAN
            self.paths.append((node, child))
            first += len(lo)
            more = np.flatnonzero(sizes > 1)
            lo, hi = edges[:, :-1].ravel()[more], edges[:, 1:].ravel()[more]
        self.bias = np.concatenate(biases)
        self.node_hash = mixed(np.arange(1, first + 1, dtype=np.uint64) * SALT[4])
        self.log_mass = np.log10(np.where(np.arange(len(self.mass)) < self.own, 1.0, self.mass))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among the frequent tokens, and which are there."""
        if not len(self.token):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        return at, self.token[at] == h

    def leaf_of(self, h: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Leaf of each token: its own, or a shared one."""
        shared = shared_leaf(h, self.own, len(self.mass))
        if not len(self.token):
            return shared
        own = np.where(there, self.leaf[at], -1)
        return np.where(own >= 0, own, shared)

    def __getstate__(self) -> dict:
        """What is broadcast: the counts, and the weights with half the bytes; the classes follow from the masses."""
        return {k: getattr(self, k) for k in ("token", "count", "n", "v", "leaf", "own", "mass")} | {"w": self.w.astype(np.float16)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"w": state["w"].astype(np.float32)}
        self._classes()


def weight_bits(v: int) -> int:
    """Bits of a row number: as many rows as distinct words, within the bounds."""
    return min(max(int(v).bit_length(), LEAST_BITS), MOST_BITS)


def shared_leaf(h: np.ndarray, own: int, leaves: int) -> np.ndarray:
    """Shared leaf of each word: those from `own` on, by hash."""
    return own + (mixed(h * SALT[5]) % np.uint64(leaves - own)).astype(np.int64)


def histories(h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hashes of the three features of each token; starts: where texts begin."""
    before = np.empty_like(h)
    before[1:], before[starts] = h[:-1], START
    skip = np.empty_like(h)
    skip[1:], skip[starts] = before[:-1], START
    return [mixed(before * SALT[0]), mixed(before * SALT[1] + skip * SALT[2]), mixed(skip * SALT[3])]


def _levels(m: Model, features: list[np.ndarray], leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """For each level of the classes: the tokens that reach it, the child each takes, its rows of weights, and the logits' exponentials."""
    shift = np.uint64(65 - len(m.w).bit_length())  # len(m.w) is a power of two
    at = np.arange(len(leaf))
    for k, (nodes, children) in enumerate(m.paths):
        node = nodes.take(leaf)
        if k == UPPER:
            features = features[:1]
        if len(node) and node.min() < 0:  # some tokens have reached their leaf
            on = np.flatnonzero(node >= 0)
            at, leaf, node, features = at.take(on), leaf.take(on), node.take(on), [f.take(on) for f in features]
        if not len(at):
            return
        own = m.node_hash.take(node)
        rows = [(((f ^ own) * MIX) >> shift).astype(np.int64) for f in features]
        z = m.bias.take(node, axis=0)
        for r in rows:
            z += m.w.take(r, axis=0)
        yield at, children.take(leaf), rows, np.exp(np.minimum(z, 60.0, out=z), out=z)


def train_batch(m: Model, features: list[np.ndarray], leaf: np.ndarray, met: np.ndarray) -> None:
    """One gradient step; a row's steps shrink with the root of how often it was met (met, which this adds to)."""
    pairs = m.w.view(np.complex64)  # two weights are added at a time
    for _, child, rows, g in _levels(m, features, leaf):
        g /= (g @ ONES)[:, None]
        g[np.arange(len(child)), child] -= 1
        for r in rows:
            np.add.at(met, r, np.float32(1))
            step = (g * (np.float32(-RATE) / np.sqrt(met.take(r)))[:, None]).view(np.complex64)
            for k in range(FAN // 2):
                np.add.at(pairs[:, k], r, step[:, k])


def score_batch(m: Model, features: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
    """log10 P(leaf | history) of each token."""
    out = np.zeros(len(leaf))
    for a in range(0, len(leaf), BATCH):
        own = out[a : a + BATCH]
        for at, child, _, e in _levels(m, [f[a : a + BATCH] for f in features], leaf[a : a + BATCH]):
            own[at] += np.log10(e[np.arange(len(child)), child] / (e @ ONES))
    return out


def _flat(batch: pa.RecordBatch, train_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens (of training rows only if so asked), and where each row's tokens start."""
    parts = texts(batch)
    if train_only:
        parts = [t for d, t in zip(batch.column(0).to_pylist(), parts, strict=True) if not held_out(d)]
    return tokens(parts)


def _train(docs: DataFrame, model: Model, part: int) -> Model:
    """One round over the training texts of one part: local steps, then the average of the workers' weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tasks = max(LEAST_TASKS, 2 * docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // PER_TASK)
    n_blocks = min(4 * tasks, len(model.w) // 16)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        mine = Model.__new__(Model)
        mine.__dict__ = dict(m.__dict__)
        mine.w = m.w.copy()
        met = np.zeros(len(m.w), dtype=np.float32)
        for batch in slices(batches):
            h, starts = _flat(batch, train_only=True)
            if not len(h):
                continue
            features = histories(h, starts)
            leaf = mine.leaf_of(h, *mine.lookup(h))
            for a in range(0, len(h), BATCH):
                b = slice(a, a + BATCH)
                train_batch(mine, [f[b] for f in features], leaf[b], met)
        if met.any():
            changed = (mine.w - m.w).astype(np.float16)
            for a in range(0, n_blocks, 64):  # some blocks at a time, to bound the size of a row batch
                blocks = range(a, min(a + 64, n_blocks))
                parts = [slice(k * len(met) // n_blocks, (k + 1) * len(met) // n_blocks) for k in blocks]
                yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array([met[x].tobytes() for x in parts], pa.binary()), pa.array([changed[x].tobytes() for x in parts], pa.binary())], names=["block", "met", "changed"])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, n, x in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = np.frombuffer(n, dtype=np.float32)
                x = np.frombuffer(x, dtype=np.float16).astype(np.float32).reshape(-1, FAN) * n[:, None]
                if k in total:
                    total[k][0] += n
                    total[k][1] += x
                else:
                    total[k] = [n.copy(), x]
        if total:
            keys = sorted(total)
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array([(total[k][1] / np.maximum(total[k][0], 1)[:, None]).astype(np.float16).tobytes() for k in keys], pa.binary())], names=["block", "changed"])

    half = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == part)
    changes = half.coalesce(tasks).mapInArrow(local, "block int, met binary, changed binary").repartition(tasks, "block").mapInArrow(averaged, "block int, changed binary")
    rows = sorted(changes.collect(), key=lambda r: r["block"])  # the weights, a fixed size
    shared.destroy()
    if rows:
        model.w += np.concatenate([np.frombuffer(r["changed"], dtype=np.float16) for r in rows]).astype(np.float32).reshape(model.w.shape)
    return model


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double, rare_logs double, tail array<long>, tail_n array<int>"


def _tails(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct h of each of n owners, how often each occurs there, and where each owner's begin."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), dtype=bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
    cut = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
    return h[first], np.diff(np.append(first, len(h))).astype(np.int32), pa.array(cut, pa.int32())


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, row = shared.value, TaskContext.get().partitionId(), 0
        log_c = np.log10(m.count + SMOOTHING)
        for batch in slices(batches):
            h, starts = _flat(batch, train_only=False)
            n = batch.num_rows
            if not n:
                continue
            owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(h))))
            at, there = m.lookup(h)
            logs = np.where(there, log_c[at] if len(log_c) else 0.0, 0.0)
            known = there & (m.count[at] > 0) if len(log_c) else there
            leaf = m.leaf_of(h, at, there)
            dealt = leaf >= m.own
            per = lambda x: np.bincount(owner, weights=x, minlength=n)
            sums = [per(known), per(logs), per(score_batch(m, histories(h, starts), leaf) - m.log_mass[leaf]), per(np.where(dealt, logs, 0.0))]
            off = np.flatnonzero(~there)
            tail, tail_n, cut = _tails(h[off].view(np.int64), owner[off], n)
            ids = batch.column(0).to_pylist()
            yield pa.record_batch(
                [
                    pa.array((part << 40) + row + np.arange(n), pa.int64()),
                    batch.column(0),
                    pa.array([held_out(d) for d in ids], pa.bool_()),
                    pa.array(np.bincount(owner, minlength=n), pa.int64()),
                    pa.array(sums[0].astype(np.int64), pa.int64()),
                    *(pa.array(x, pa.float64()) for x in sums[1:]),
                    pa.ListArray.from_arrays(cut, pa.array(tail, pa.int64())),
                    pa.ListArray.from_arrays(cut, pa.array(tail_n, pa.int32())),
                ],
                names=[x.split(" ")[0] for x in SCORED.split(", ")],
            )
            row += n

    return docs.mapInArrow(run, SCORED)


def _leaf_counts(counts: DataFrame, least: Column, own: int, leaves: int) -> pa.Table:
    """(leaf, n, v): occurrences and number of the training words that share each leaf; MOST_SHARED rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared_leaf(batch.column(0).to_numpy().view(np.uint64), own, leaves)
            yield pa.record_batch([pa.array(leaf, pa.int64()), batch.column(1)], names=["leaf", "c"])

    shared = counts.filter(~least & (F.col("c") > 0)).select("token", "c")
    return shared.mapInArrow(run, "leaf long, c long").groupBy("leaf").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(docs.mapInArrow(_counts, "token long, c long, a long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "token-counts")
    n, v, a = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("a"), F.lit(0))).first()
    least = F.col("a") * F.lit(HOT) >= F.lit(a)
    frequent = counts.filter(least).select("token", "c").toArrow()  # HOT rows at most
    hashes = frequent.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], frequent.column("c").to_numpy().astype(np.int64)[order], n, v)
    tail_counts = _leaf_counts(counts, least, model.own, len(model.mass))
    model.grow(*(tail_counts.column(k).to_numpy() for k in ("leaf", "n", "v")))
    for part in range(ROUNDS):
        model = _train(docs, model, part)

    scored = stored(_scored(docs, model), "scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("rid", F.col("x.tail").alias("token"), F.col("x.tail_n").alias("n"))
    known = tail.join(counts.select("token", "c"), "token", "left").select("rid", "n", F.coalesce("c", F.lit(0)).alias("c"))
    sums = known.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(SMOOTHING))).alias("tail_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum("n").alias("tail_all"),
    )
    whole = math.log10(n + SMOOTHING * (v + 1))
    logs = F.coalesce("tail_logs", F.lit(0.0))
    return scored.drop("tail", "tail_n").join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("model") + F.col("rare_logs") + logs).alias("score"),
    )
