"""Words, their hashes and Arrow batches for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

#: Entries of a worker's table of word hashes; it starts anew beyond that, so memory stays bounded.
TABLE_LIMIT = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)
LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Longer words are hashed one by one.
LONG = 64
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
np.seterr(over="ignore")  # hashes wrap around


class WordHashes(dict):
    """64-bit hash of each word, worked out once while it stays in the table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


word_hashes = WordHashes()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the bytes of several texts, one behind the other; ends: where each text ends."""
    inside = ~SPACE.take(data)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]  # words do not go on in the next text
    begins[cuts], stops[cuts - 1] = inside[cuts], inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of data, eight bytes at a time; spans of up to eight bytes and one length never share one."""
    n = last - first
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))  # the eight bytes from each byte on
    h = mixed(eight[first] & LOW_BYTES.take(np.minimum(n, 8))) + n.astype(np.uint64) * LENGTH
    for k in range(8, LONG, 8):
        at = np.flatnonzero(n > k) if k == 8 else at[n.take(at) > k]
        if not len(at):
            break
        h[at] = mixed(h.take(at) * MIX + (eight[first.take(at) + k] & LOW_BYTES.take(np.minimum(n.take(at) - k, 8))))
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]].data)
    return mixed(h)


def flat_words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all parts in their order, and how many each part has."""
    data = np.frombuffer(b"".join(parts).lower(), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
    first, last = word_spans(data, ends)
    return span_hashes(data, first, last), np.diff(np.searchsorted(first, ends), prepend=0)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in h."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    factor = MIX
    for k in range(n):
        out += h[k : k + m] * factor
        factor = factor * MIX + np.uint64(2 * k + 2)
    return mixed(out)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text (one row at least), to bound memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).cast(pa.large_binary())
        sizes = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()), dtype=np.int64, count=batch.num_rows)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
