"""Frequencies of hashed tokens in a table of fixed size, so that it can be broadcast whatever the corpus.

A token's slot is the top bits of its hash; slots hold a log-scaled count in one byte. Collisions only raise a count, and
every user of the sketch needs nothing but one total order on tokens that all rows agree on, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**BITS slots of one byte: 4 MB, at every corpus size.
BITS = 22
RANGES = 32
FLUSH = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flatten(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values as uint64, lengths) of a list column without nulls inside; a null list has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return values, lengths


def grouped_order(row: np.ndarray, h: np.ndarray, q: np.ndarray | None = None) -> np.ndarray:
    """The order by row, then q (a byte), then h. One sort of packed keys; where the packing drops a difference, the full sort."""
    if not len(h):
        return np.zeros(0, np.int64)
    low = 64 - max(int(row[-1]).bit_length(), 1)
    packed = row.astype(np.uint64) << np.uint64(low)
    if q is not None:
        low -= 8
        packed |= q.astype(np.uint64) << np.uint64(low)
    packed |= h >> np.uint64(64 - low)
    order = np.argsort(packed)
    p, x = packed[order], h[order]
    if ((p[1:] == p[:-1]) & (x[1:] != x[:-1])).any():
        return np.lexsort((h, row) if q is None else (h, q, row))
    return order


def slots(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def slot_counter(tokens: Callable[[pa.RecordBatch], np.ndarray], bits: int = BITS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives partial counts: (range int, slots binary, counts binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            s = slots(tokens(b), bits)
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield partial(held, bits)
                held, size = [], 0
        if size:
            yield partial(held, bits)

    return run


def partial(held: list[np.ndarray], bits: int = BITS) -> pa.RecordBatch:
    s, c = np.unique(np.concatenate(held), return_counts=True)
    cuts = np.searchsorted(s, np.arange(0, RANGES + 1, dtype=np.uint64) << np.uint64(bits - 5))
    rows = [(r, s[i:j].tobytes(), c[i:j].astype(np.uint32).tobytes()) for r, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    return pa.RecordBatch.from_arrays(
        [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([x for _, x, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.binary())],
        names=["range", "slots", "counts"],
    )


PARTIAL_SCHEMA = "range int, slots binary, counts binary"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    s = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["slots"]])
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.float64)
    u, inv = np.unique(s, return_inverse=True)
    total = np.minimum(np.bincount(inv, weights=c), 2**32 - 1).astype(np.uint32)
    return pd.DataFrame({"range": [pdf["range"].iloc[0]], "slots": [u.tobytes()], "counts": [total.tobytes()]})


def table(partials: DataFrame, bits: int = BITS) -> np.ndarray:
    """The sketch: uint8 per slot, 0 for none, else 1 + 4 log2(count). The driver gets at most 2**bits slots."""
    few = partials.withColumn("_g", F.spark_partition_id() % 16).groupBy("range", "_g").applyInPandas(_merge_keep, PARTIAL_SCHEMA)
    merged = few.groupBy("range").applyInPandas(_merge, PARTIAL_SCHEMA)
    out = np.zeros(1 << bits, np.uint8)
    for row in merged.toLocalIterator():
        s, c = np.frombuffer(row["slots"], np.uint32), np.frombuffer(row["counts"], np.uint32)
        out[s] = level(c)
    return out


def _merge_keep(pdf: pd.DataFrame) -> pd.DataFrame:
    return _merge(pdf)


def level(count: np.ndarray) -> np.ndarray:
    return (1 + np.floor(4 * np.log2(np.maximum(count, 1)))).astype(np.uint8)
