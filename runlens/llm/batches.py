"""Arrow batches of texts: slices bounded by bytes, and words of a batch as NumPy arrays.

A word is a maximal run of bytes other than blank and \\t..\\r, the expression [^\\x20\\x09-\\x0D]+ on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the vectorised functions take at once; each byte costs about 40 bytes of memory.
CHUNK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name; the last of several with the name."""
    return batch.column(max(i for i, x in enumerate(batch.schema.names) if x == name))


def by_bytes(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `most` bytes in column `name`; a longer text is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for i, base in enumerate((STEP, STEP_BACK)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; a word ends where its text ends."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word in order, and for each text the number of its first word (n + 1 numbers).

    Works through bounded pieces that end between words, so that one very long text needs little memory.
    """
    hashes, counts = [], np.zeros(len(offsets), np.int64)
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and not SPACE[data[end]] and offsets[np.searchsorted(offsets, end)] != end:
            ahead = np.flatnonzero(SPACE[data[end : end + 65536]])
            step = int(ahead[0]) if len(ahead) else min(65536, len(data) - end)
            end = min(end + max(step, 1), int(offsets[np.searchsorted(offsets, end)]))
        piece = LOWER[data[at:end]] if lower else data[at:end]
        lo, hi = np.searchsorted(offsets, at), np.searchsorted(offsets, end, "right")
        begin, stop = word_spans(piece, offsets[lo:hi] - at)
        up, back = _power_tables(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[piece] * up[: len(piece)], out=total[1:])
        hashes.append(mixed((total[stop] - total[begin]) * back[begin] + (stop - begin).astype(np.uint64)))
        counts[1:] += np.bincount(np.searchsorted(offsets, begin + at, "right") - 1, minlength=len(offsets) - 1)
        at = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one text; of the whole text if it has fewer, none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    run = min(size, n)
    total = np.full(n - run + 1, run, np.uint64)
    for k in range(run):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : n - run + 1 + k]
        total ^= total >> np.uint64(32)
    return mixed(total)
