"""Operator 8: SentencePiece encoding and decoding with exact N-best segmentations.

A text is segmented into pieces of a public vocabulary (its file is a parameter; nothing is trained) so
that the sum of the pieces' scores is greatest. The text gets a leading space, and what no piece covers falls
back to its UTF-8 bytes. No piece crosses from a word into the next run of spaces, so the lattice of a text is a
chain of small lattices, its links: one for each run of spaces with the word behind it; words over LONG
characters are cut further, where no piece can cross. Links repeat a lot: a batch of texts becomes
numbers of distinct links, the new ones are segmented by one forward Viterbi pass in numpy for each width, and
the ids of the texts are gathered from theirs.

N best: the forward pass gives every node the best score from the start, which is the exact
heuristic for an A-star search backward from the end: paths leave its heap in order of their total
score, and among equal ones what is nearest to the start comes first, so ties are not all expanded. For whole
texts, only the n - 1 links of the chain with the least loss to their second-best path can differ from the
best in the n best; A-star runs on those.

decode(encode(text)) == text for every text: U+2581, which the file has for spaces, is kept apart as bytes.

Defined results: a null text gives null pieces and counts as empty; an empty text has no pieces and
score 0; repeated rows get equal results; among equal scores the segmentation with fewer, then earlier
longer pieces wins; an empty table gives no rows; columns other than doc_id and text are ignored by report()
and kept by encoded() and listed(), whose new column takes the first free one of the names pieces, pieces_2, pieces_3 and so on.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.words import MIX, mixed, slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for a space in the vocabulary file; here pieces hold the space itself.
MARK = "▁"
SPACE = " "
N_BEST = 4
#: What an uncovered character costs below the least score of any piece.
UNKNOWN_PENALTY = 10.0
#: Files give reserved pieces (runs of spaces) scores below this; here they rank just below all others.
LEAST_SCORE = -1e6
#: Distinct links kept between batches, and characters in them; beyond, the table starts anew.
TABLE, TABLE_CHARS = 60_000, 4_000_000
#: Links longer than this are cut where no piece can cross, and what still is longer goes one by one.
LONG = 64
SLICE = 2 << 20  # bytes of text that are worked on at once
CELLS = 100_000  # characters of the links that are segmented at once
BITS = 20
NONE = float("-inf")
CODE = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    texts: list[str | int | None]  # by id: text, byte, or nothing (control)
    longest: int = field(init=False)
    unknown: float = field(init=False)
    pairs: set[str] = field(init=False)  # neighbours inside pieces
    raw: list[bytes] = field(init=False)  # by id: what it decodes to

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))
        least = min((s for _, s in self.pieces.values() if s > LEAST_SCORE), default=0.0)
        self.pieces = {p: (i, max(s, least - 1.0)) for p, (i, s) in self.pieces.items()}
        self.unknown = least - UNKNOWN_PENALTY
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.raw = [b"" if t is None else bytes([t]) if isinstance(t, int) else t.encode() for t in self.texts]
        for p in self.pieces:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} crosses words")
        h = np.array([_hash(p) for p in self.pieces], dtype=np.uint64)
        order = np.argsort(_place(h), kind="stable")
        self.hash = h[order]
        self.id = np.array([i for i, _ in self.pieces.values()], dtype=np.int32)[order]
        self.score = np.array([s for _, s in self.pieces.values()], dtype=np.float64)[order]
        places, first, here = np.unique(_place(self.hash), return_index=True, return_counts=True)
        self.most = int(here.max())  # pieces that share a place
        self.there = np.zeros(1 << BITS, dtype=bool)
        self.there[places] = True
        self.slot = np.zeros(1 << BITS, dtype=np.int32)
        self.slot[places] = first

    @cached_property
    def prefixes(self) -> dict[str, tuple[int, float] | None]:
        """Pieces and what pieces begin with; only links that go one by one need it."""
        return {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.pieces

    def fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes_[b] for b in c.encode("utf-8", "surrogatepass"))

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        """Read on the driver only; workers get the pieces by broadcast."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_, texts = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i).replace(MARK, SPACE)
            if model.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
                texts.append(int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(None)
            else:
                pieces[piece] = (i, model.get_score(i))
                texts.append(piece)
        return cls(pieces, bytes_, texts)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hash(piece: str) -> np.uint64:
    """Polynomial hash of the mixed code points, as forward_many() builds it up step by step."""
    h = np.uint64(0)
    for c in mixed(_codes(piece).astype(np.uint64) + CODE):
        h = h * MIX + c
    return h


def _place(h: np.ndarray) -> np.ndarray:
    return (h * CODE) >> np.uint64(64 - BITS)


@dataclass
class Lattice:
    """Arcs of one link of the chain with forward scores; node j lies after j characters."""

    size: int
    into: list[list[tuple[int, float, tuple[int, ...]]]]
    best: list[float]
    back: list[tuple[int, tuple[int, ...]]]


def lattice(link: str, v: Vocabulary) -> Lattice:
    pieces, longest, n = v.pieces, v.longest, len(link)
    into: list = [[] for _ in range(n + 1)]
    best = [0.0] + [NONE] * n
    back: list = [(0, ())] * (n + 1)
    count = [0] * (n + 1)
    for j in range(1, n + 1):
        arcs = into[j]
        for i in range(max(0, j - longest), j):
            found = pieces.get(link[i:j])
            if found is not None:
                arcs.append((i, found[1], (found[0],)))
        if not arcs or arcs[-1][0] != j - 1:
            arcs.append((j - 1, v.unknown, v.fallback(link[j - 1])))
        for i, score, ids in arcs:  # from the longest piece on
            total = best[i] + score
            if total > best[j] or (total == best[j] and count[i] + len(ids) < count[j]):
                best[j], back[j], count[j] = total, (i, ids), count[i] + len(ids)
    return Lattice(n, into, best, back)


def viterbi(x: Lattice) -> tuple[float, tuple[int, ...]]:
    parts, j = [], x.size
    while j:
        j, ids = x.back[j]
        parts.append(ids)
    return x.best[x.size], tuple(i for ids in reversed(parts) for i in ids)


def n_best(x: Lattice, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations, best first, by A-star from the end; the first is viterbi's."""
    first = viterbi(x)
    out, ties = [], 0
    heap: list = [(-x.best[x.size], x.size, 0, 0.0, None)]
    while heap and len(out) < n + 1:
        _, j, _, behind, path = heapq.heappop(heap)
        if j == 0:
            ids: list[int] = []
            while path is not None:
                ids.extend(path[0])
                path = path[1]
            out.append((behind, tuple(ids)))
            continue
        for i, score, ids in x.into[j]:
            ties += 1
            heapq.heappush(heap, (-(x.best[i] + score + behind), i, ties, score + behind, (ids, path)))
    return [first, *(p for p in out if p[1] != first[1])][:n]


def forward(link: str, v: Vocabulary) -> tuple[tuple[int, ...], float, float]:
    """The best segmentation, its score, and how much less the second best scores: one forward pass."""
    n, table = len(link), v.prefixes
    best, second, count = [NONE] * (n + 1), [NONE] * (n + 1), [0] * (n + 1)
    back: list = [None] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        b, s2, c = best[i], second[i], count[i]
        j, single = i + 1, True
        while j <= n:
            found = table.get(link[i:j], 0)
            if found == 0:
                break
            if found is not None:
                if j == i + 1:
                    single = False
                score = found[1]
                total = b + score
                if total > best[j] or (total == best[j] and c + 1 < count[j]):
                    second[j], best[j] = best[j], total
                    back[j], count[j] = (i, found[0]), c + 1
                elif total > second[j]:
                    second[j] = total
                if s2 + score > second[j]:
                    second[j] = s2 + score
            j += 1
        if single:
            j = i + 1
            ids = v.fallback(link[i])
            total = b + v.unknown
            if total > best[j] or (total == best[j] and c + len(ids) < count[j]):
                second[j], best[j] = best[j], total
                back[j], count[j] = (i, ids), c + len(ids)
            elif total > second[j]:
                second[j] = total
            if s2 + v.unknown > second[j]:
                second[j] = s2 + v.unknown
    parts, j = [], n
    while j:
        j, ids = back[j]
        parts.append((ids,) if isinstance(ids, int) else ids)
    return tuple(i for ids in reversed(parts) for i in ids), best[n], best[n] - second[n]


def forward_many(links: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """forward() of many links of similar length at once: all ids one link after the other, their number, score and loss by link."""
    k, n = len(links), max(map(len, links))
    size = np.fromiter(map(len, links), dtype=np.int64, count=k)
    codes = np.ascontiguousarray(_codes("".join(x.ljust(n, "\0") for x in links)).reshape(k, n).T)
    char = mixed(codes.astype(np.uint64) + CODE)
    arcs: list[tuple[np.ndarray, np.ndarray] | None] = [None]  # by length of the piece: scores and ids of those that start at a place
    h = np.zeros((n, k), dtype=np.uint64)
    for length in range(1, min(n, v.longest) + 1):
        m = n - length + 1
        h = h[:m] * MIX + char[length - 1 :]
        place = _place(h).ravel()
        at = np.flatnonzero(v.there[place])
        own, p = h.ravel()[at], v.slot[place[at]]
        for _ in range(v.most - 1):
            p = np.where(v.hash[p] == own, p, np.minimum(p + 1, len(v.hash) - 1))
        hit = v.hash[p] == own
        at, p = at[hit], p[hit]
        if length > 1 and not len(at):
            arcs.append(None)
            continue
        score = np.full(m * k, v.unknown if length == 1 else NONE)
        ids = np.full(m * k, -1, dtype=np.int32)
        score[at], ids[at] = v.score[p], v.id[p]
        arcs.append((score.reshape(m, k), ids.reshape(m, k)))
    wide = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)  # UTF-8 bytes of each character
    weight = np.where(arcs[1][1] < 0, wide, 1)  # pieces that an arc of one character brings
    best, second = np.full((n + 1, k), NONE), np.full((n + 1, k), NONE)
    count, back = np.zeros((n + 1, k), dtype=np.int64), np.zeros((n + 1, k), dtype=np.int64)
    best[0] = 0.0
    for j in range(1, n + 1):
        b, s, c, taken = best[j], second[j], count[j], back[j]
        for length in range(min(j, len(arcs) - 1), 0, -1):  # from the longest piece on
            if arcs[length] is None:
                continue
            i, score = j - length, arcs[length][0][j - length]
            total = best[i] + score
            new = count[i] + (weight[i] if length == 1 else 1)
            better = (total > b) | ((total == b) & (total > NONE) & (new < c))
            np.maximum(s, np.where(better, b, total), out=s)
            np.maximum(s, second[i] + score, out=s)
            np.copyto(b, total, where=better)
            np.copyto(c, new, where=better)
            np.copyto(taken, length, where=better)
    row = np.arange(k)
    number = count[size, row]
    ends = np.cumsum(number)
    ids = np.empty(int(ends[-1]), dtype=np.int32)
    at, place = size.copy(), ends.copy()
    while len(row):
        length = back[at, row]
        at = at - length
        own = np.empty(len(row), dtype=np.int32)
        for x in np.unique(length):
            of = length == x
            own[of] = arcs[x][1][at[of], row[of]]
        place = place - np.where(own < 0, wide[at, row], 1)
        ids[place] = own
        for q in np.flatnonzero(own < 0).tolist():
            bytes_ = v.fallback(chr(codes[at[q], row[q]]))
            ids[place[q] : place[q] + len(bytes_)] = bytes_
        more = at > 0
        row, at, place = row[more], at[more], place[more]
    total = best[size, np.arange(k)]
    return ids, number, total, total - second[size, np.arange(k)]


class _Numbers(dict):
    """Number of each link in order of first sight."""

    def __missing__(self, link: str | tuple[str]) -> int:
        n = self[link] = len(self)
        return n


def _link(key: str | tuple[str]) -> str:
    """The characters of a link, from what it goes by in Segmenter.chain()."""
    return key[0] if isinstance(key, tuple) else key if key[0] == SPACE else SPACE + key


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at starts, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Encoded:
    """A batch of texts: their links by number, and ids, number of ids and score by text."""

    links: np.ndarray
    first: np.ndarray  # of each text's links, and one more
    ids: np.ndarray
    start: np.ndarray  # of each text's ids, and one more
    score: np.ndarray


class Segmenter:
    """Encodes and decodes whole texts; keeps the links it has seen in a bounded table."""

    def __init__(self, v: Vocabulary, table: int = TABLE):
        self.v, self.table = v, table
        self._anew()

    def _anew(self) -> None:
        self.numbers, self.names, self.chars = _Numbers(), [], 0
        self.ids = np.empty(0, dtype=np.int32)
        self.start, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.score, self.loss = np.empty(0), np.empty(0)
        self.listed: dict[tuple[int, int], list] = {}

    def parts(self, link: str) -> list[str]:
        """A long link cut where no piece can cross."""
        pairs, a, out = self.v.pairs, 0, []
        for i in range(1, len(link)):
            if link[i - 1 : i + 1] not in pairs:
                out.append(link[a:i])
                a = i
        return [*out, link[a:]]

    def chain(self, text: str) -> list[int]:
        """Numbers of the text's links. A link goes by its word if one space is before it, by all its characters
        (which begin with a space) if more are, and parts of long ones by a tuple."""
        if not text:
            return []
        words, numbers = text.split(SPACE), self.numbers
        if "" not in words and max(map(len, words)) < LONG:
            return list(map(numbers.__getitem__, words))
        out, spaces = [], 1
        for word in words:
            if not word:
                spaces += 1
                continue
            if len(word) + spaces > LONG:
                out += [numbers[(p,)] for p in self.parts(SPACE * spaces + word)]
            else:
                out.append(numbers[word if spaces == 1 else SPACE * spaces + word])
            spaces = 1
        if spaces > LONG:
            out += [numbers[(p,)] for p in self.parts(SPACE * (spaces - 1))]
        elif spaces > 1:
            out.append(numbers[SPACE * (spaces - 1)])
        return out

    def _settle(self) -> None:
        """Segment the links seen since the last time."""
        done = len(self.names)
        keys = list(itertools.islice(self.numbers, done, None))
        if not keys:
            return
        self.names += keys
        new = list(map(_link, keys))
        self.chars += sum(map(len, new))
        groups: dict[int, list[int]] = {}
        for k, x in enumerate(new):
            n = len(x)
            groups.setdefault(n if n <= 12 else -(-n // 4) * 4 if n <= LONG else 0, []).append(k)
        start, size = np.empty(len(new), dtype=np.int64), np.empty(len(new), dtype=np.int64)
        score, loss = np.empty(len(new)), np.empty(len(new))
        flat, at = [self.ids], len(self.ids)
        for width, members in groups.items():
            step = max(1, CELLS // width) if width else 1
            for a in range(0, len(members), step):
                own = np.array(members[a : a + step])
                if width:
                    ids, number, best, less = forward_many([new[k] for k in own], self.v)
                else:
                    one = forward(new[own[0]], self.v)
                    ids, number, best, less = np.array(one[0], dtype=np.int32), np.array([len(one[0])]), one[1], one[2]
                start[own], size[own], score[own], loss[own] = at + np.cumsum(number) - number, number, best, less
                flat.append(ids)
                at += len(ids)
        self.ids = np.concatenate(flat)
        self.start, self.size = np.concatenate((self.start, start)), np.concatenate((self.size, size))
        self.score, self.loss = np.concatenate((self.score, score)), np.concatenate((self.loss, loss))

    def encode_all(self, texts: list[str]) -> Encoded:
        """The best segmentations of a batch of texts."""
        if len(self.names) > self.table or self.chars > TABLE_CHARS:
            self._anew()
        chains = list(map(self.chain, texts))
        self._settle()
        of = np.fromiter(map(len, chains), dtype=np.int64, count=len(chains))
        links = np.fromiter(itertools.chain.from_iterable(chains), dtype=np.int64, count=int(of.sum()))
        first = np.concatenate(([0], np.cumsum(of)))
        size = self.size[links]
        ids = self.ids[_gathered(self.start[links], size)]
        start = np.concatenate(([0], np.cumsum(size)))[first]
        score = np.bincount(np.repeat(np.arange(len(texts)), of), weights=self.score[links], minlength=len(texts))
        return Encoded(links, first, ids, start, score)

    def _options(self, link: int, n: int) -> list[tuple[float, np.ndarray]]:
        """Losses and ids of the n best segmentations of a link."""
        found = self.listed.get((link, n))
        if found is None:
            best = n_best(lattice(_link(self.names[link]), self.v), n)
            found = self.listed[link, n] = [(best[0][0] - s, np.array(ids, dtype=np.int32)) for s, ids in best]
        return found

    def segmentations(self, e: Encoded, k: int, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of the k-th text of a batch, best first."""
        links, ids, score = e.links[e.first[k] : e.first[k + 1]], e.ids[e.start[k] : e.start[k + 1]], float(e.score[k])
        if n <= 1 or not len(links):
            return [(score, ids)]
        loss = self.loss[links]
        among = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2]) if len(loss) >= n else np.arange(len(loss))
        among = among[np.argsort(loss[among], kind="stable")][: n - 1]
        chosen = sorted(among[loss[among] < float("inf")].tolist())
        sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for q in chosen:
            merged = [(a + b, (*pick, o)) for a, pick in sums for o, (b, _) in enumerate(self._options(int(links[q]), n))]
            sums = heapq.nsmallest(n, merged, key=lambda x: x[0])
        ends = np.cumsum(self.size[links])
        out = []
        for less, pick in sums:
            parts, a = [], 0
            for q, o in zip(chosen, pick, strict=True):
                if o:
                    parts += [ids[a : ends[q] - self.size[links[q]]], self._options(int(links[q]), n)[o][1]]
                    a = ends[q]
            out.append((score - less, np.concatenate([*parts, ids[a:]]) if parts else ids))
        return out

    def encode(self, text: str) -> tuple[list[int], float]:
        """Ids of the best segmentation and its score."""
        e = self.encode_all([text])
        return e.ids.tolist(), float(e.score[0])

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of the whole text, best first."""
        return [(s, ids.tolist()) for s, ids in self.segmentations(self.encode_all([text]), 0, n)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.v.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


_kept: list[Segmenter] = []


def _segmenter(v: Vocabulary) -> Segmenter:
    """The worker's segmenter for v, so that its table outlives a task."""
    if not _kept or _kept[0].v is not v:
        _kept[:] = [Segmenter(v)]
    return _kept[0]


def _digest(ids: np.ndarray | list[int]) -> str:
    return hashlib.sha256(np.asarray(ids, dtype="<i4").tobytes()).hexdigest()


REPORT = "doc_id long, n_chars long, n_pieces long, score double, nbest_scores array<double>, nbest_sha256 array<string>, ids_sha256 string, round_trip boolean"


def report(docs: DataFrame, path: str = DEFAULT_MODEL, n: int = N_BEST) -> DataFrame:
    """One row for each document: digest of its best pieces, scores and digests of its n best segmentations, and the round trip's result."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(shared.value)
        for batch in slices(batches, most_bytes=SLICE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            e = seg.encode_all(texts)
            rows = []
            for k, (d, t) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                best = seg.segmentations(e, k, n)
                digests = [_digest(ids) for _, ids in best]
                whole = seg.decode(best[0][1].tolist()) == t
                rows.append((d, len(t), len(best[0][1]), best[0][0], [s for s, _ in best], digests, digests[0], whole))
            kinds = [pa.int64()] * 3 + [pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in REPORT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, REPORT)


def _beside(docs: DataFrame, path: str, into: str, kind: T.DataType, column: Callable[[Segmenter, list[str | None]], pa.Array]) -> DataFrame:
    """docs with what column() makes of each batch's texts in the new column `into`, or into_2 and so on if docs have that."""
    taken = {c.lower() for c in docs.columns}
    into = next(name for name in (into, *(f"{into}_{k}" for k in range(2, len(taken) + 3))) if name.lower() not in taken)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(shared.value)
        for batch in slices(batches, most_bytes=SLICE):
            yield pa.record_batch([*batch.columns, column(seg, batch.column(at).to_pylist())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str = DEFAULT_MODEL, into: str = "pieces") -> DataFrame:
    """docs with the ids of each text's best segmentation in the new column `into`."""

    def column(seg: Segmenter, texts: list[str | None]) -> pa.Array:
        e = seg.encode_all([t or "" for t in texts])
        none = np.array([t is None for t in texts] + [False])
        return pa.ListArray.from_arrays(pa.array(e.start.astype(np.int32), pa.int32(), mask=none), pa.array(e.ids, pa.int32()))

    return _beside(docs, path, into, T.ArrayType(T.IntegerType()), column)


def listed(docs: DataFrame, path: str = DEFAULT_MODEL, into: str = "pieces", n: int = N_BEST) -> DataFrame:
    """docs with scores and ids of each text's n best segmentations, best first, in the new column `into`. Each best one is decoded again,
    and one that is not its text fails the run."""

    def column(seg: Segmenter, texts: list[str | None]) -> pa.Array:
        e = seg.encode_all([t or "" for t in texts])
        found: list[tuple[float, np.ndarray]] = []
        ends = [0]
        for k, t in enumerate(texts):
            if t is not None:
                best = seg.segmentations(e, k, n)
                if seg.decode(best[0][1].tolist()) != t:
                    raise ValueError("pieces do not decode to their text")
                found += best
            ends.append(len(found))
        starts = np.cumsum([0, *(len(ids) for _, ids in found)]).astype(np.int32)
        ids = pa.array(np.concatenate([np.empty(0, dtype=np.int32), *(ids for _, ids in found)]), pa.int32())
        lists = pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.ListArray.from_arrays(pa.array(starts), ids)], ["score", "ids"])
        none = np.array([t is None for t in texts] + [False])
        return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32), pa.int32(), mask=none), lists)

    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _beside(docs, path, into, T.ArrayType(kind), column)
