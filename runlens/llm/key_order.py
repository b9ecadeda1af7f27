"""How common keys are, in a table of fixed size: what is rare comes first, and what very many rows have is dealt to many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import column

#: Keys gathered before they are handed on, parts by which they are dealt (2**PART_BITS), and 64-bit words of the filters over those that occur twice
#: (2**LEAST_BITS to 2**MOST_BITS: 64 MB) and often.
GATHERED, PART_BITS, LEAST_BITS, MOST_BITS, HOT_BITS = 1 << 19, 10, 18, 23, 14
#: Slots of the counts of keys (2**ORDER_BITS), and those in a piece on its way to the sum.
ORDER_BITS, PIECE = 20, 1 << 14
#: Logarithm of a slot's count from which its keys count as hot: this, and so much above the median slot.
HOT, HOT_ABOVE = 11, 3


def slots_of(keys: np.ndarray) -> np.ndarray:
    """Slot of each 64-bit key."""
    return (keys >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def hot_from(classes: np.ndarray) -> int:
    """The least class of hot keys."""
    return max(HOT, int(np.median(classes)) + HOT_ABOVE)


def key_classes(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> bytes:
    """For each slot of keys, the logarithm of how often they occur: a fixed 2**ORDER_BITS bytes.

    Counts all rows: every task adds up its own slots and hands on pieces, which a second stage adds as they stream by.
    """
    slots = 1 << ORDER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for own in keys(batches):
            total += np.bincount(slots_of(own), minlength=slots)
        total = total.reshape(-1, PIECE)
        filled = np.flatnonzero(total.any(axis=1))
        if len(filled):
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([total[i].tobytes() for i in filled], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(column(batch, "piece").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(raw, np.int64)
        if total:
            classes = [np.log2(x + 1).astype(np.uint8).tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(classes, pa.binary())], ["piece", "classes"])

    order = np.zeros((slots // PIECE, PIECE), np.uint8)
    for r in rows.mapInArrow(count, "piece int, counts binary").repartition(12, "piece").mapInArrow(add, "piece int, classes binary").collect():
        order[r["piece"]] = np.frombuffer(r["classes"], np.uint8)
    return order.tobytes()


def _masks(low: np.ndarray) -> np.ndarray:
    """Three of 64 bits for each 32-bit remainder of a key."""
    mask = np.zeros(len(low), np.uint64)
    for i in range(3):
        mask |= np.uint64(1) << ((low >> np.uint64(6 * i)) & np.uint64(63))
    return mask


class RepeatedKeys:
    """Filters over 64-bit keys that two owners or more have, and over those that `hot` or more have.

    They let some others pass. The first grows with the number of owners, from 2**LEAST_BITS numbers to 2**MOST_BITS, beyond which more pass.
    keys: batches → (keys, hashes of their owners). A key travels as 32 bits in an array with others of its part, and is told from others by
    32 + PART_BITS bits; its owner, which may come from many tasks, as 16 bits, so that of 65 536 keys of two owners alone one is missed.
    """

    def __init__(self, rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], hot: int, owners: int):
        self.bits = bits = min(max(LEAST_BITS, (owners // 4).bit_length()), MOST_BITS)

        def packed(gathered: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            own, owner = (np.concatenate(x) for x in zip(*gathered, strict=True))
            part = (own >> np.uint64(64 - PART_BITS)).astype(np.int16)
            order = np.argsort(part, kind="stable")
            part, low, owner = part[order], (own >> np.uint64(32 - PART_BITS)).astype(np.uint32)[order], owner.astype(np.uint16)[order]
            ends = np.searchsorted(part, np.arange((1 << PART_BITS) + 1))
            filled = np.flatnonzero(np.diff(ends))
            pieces = [pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in filled.tolist()], pa.binary()) for x in (low, owner)]
            return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), *pieces], ["part", "low", "owner"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gathered, n = [], 0
            for own, owner in keys(batches):
                gathered.append((own, owner))
                n += len(own)
                if n >= GATHERED:
                    yield packed(gathered)
                    gathered, n = [], 0
            if n:
                yield packed(gathered)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[int, list[tuple[bytes, bytes]]] = {}
            for batch in batches:
                for i, *raw in zip(column(batch, "part").to_pylist(), column(batch, "low").to_pylist(), column(batch, "owner").to_pylist(), strict=True):
                    met.setdefault(i, []).append(tuple(raw))
            while met:
                i, raw = met.popitem()
                low, owner = np.frombuffer(b"".join(x for x, _ in raw), np.uint32).astype(np.uint64), np.frombuffer(b"".join(x for _, x in raw), np.uint16).astype(np.uint64)
                low = np.unique(low << np.uint64(16) | owner) >> np.uint64(16)
                tables = []
                for n, size in ((2, bits), (hot, HOT_BITS)):
                    own = np.unique(low[n - 1 :][low[n - 1 :] == low[: len(low) - n + 1]]) if len(low) >= n else low[:0]
                    table = np.zeros(1 << (size - PART_BITS), np.uint64)
                    np.bitwise_or.at(table, (own >> np.uint64(32 - size + PART_BITS)).astype(np.int64), _masks(own))
                    tables.append(table.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x], pa.binary()) for x in tables]], ["part", "repeated", "hot"])

        filled = [np.zeros((1 << PART_BITS, 1 << (size - PART_BITS)), np.uint64) for size in (bits, HOT_BITS)]
        for r in rows.mapInArrow(gather, "part int, low binary, owner binary").repartition("part").mapInArrow(find, "part int, repeated binary, hot binary").toLocalIterator():
            for table, name in zip(filled, ("repeated", "hot"), strict=True):
                table[r["part"]] = np.frombuffer(r[name], np.uint64)
        self.shared = rows.sparkSession.sparkContext.broadcast([x.tobytes() for x in filled])

    def _in(self, keys: np.ndarray, which: int, bits: int) -> np.ndarray:
        table = np.frombuffer(self.shared.value[which], np.uint64)
        mask = _masks((keys >> np.uint64(32 - PART_BITS)) & np.uint64(0xFFFFFFFF))
        return (table[(keys >> np.uint64(64 - bits)).astype(np.int64)] & mask) == mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that certainly have one owner alone."""
        return self._in(keys, 0, self.bits)

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that certainly have fewer than `hot` owners."""
        return self._in(keys, 1, HOT_BITS)
