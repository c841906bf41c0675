"""Evaluation passages inside a corpus: documents that hold at least RUN consecutive words of an item.

A prefix-filtered join on shingles of five words; items and corpus may both be of any size, and each is read once. A window
of RUN words has NEED = RUN - 4 shingles, all of which a document that holds it must have.
1. A presence sketch of fixed size (4 MB) of the items' shingles is broadcast; a document's shingles that pass it are
   written with their places. It only spares work: what passes is joined exactly.
2. The corpus frequency of every item shingle is counted from these; windows with a shingle that the corpus lacks are dropped,
   and of each other window only the rarest shingle - its necessary prefix - is joined with the documents (length bound:
   texts of fewer than RUN words have no shingles here).
3. A hit fixes how the item lies on the document (positional bound). The item's shingles are laid along it and joined with
   the document's own at exactly these places; NEED consecutive ones are RUN words, so runs are exact.
Only shingles move, never texts; a frequent shingle is the prefix of a window only if all its others are more frequent still.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import sketch as S
from tidemark.llm import words as W
from tidemark.session import drop_stored, small_side, stored

SHINGLE = 5
RUN = 12
NEED = RUN - SHINGLE + 1


def shingles(w: np.ndarray) -> np.ndarray:
    """A hash of each SHINGLE consecutive words."""
    if len(w) < SHINGLE:
        return np.zeros(0, np.uint64)
    n = len(w) - SHINGLE + 1
    x = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            x = x * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return S.mix(x)


def _places(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, rows, places in words) of the rows of at least RUN words."""
    v, n = W.hashed(W.comparables(text))
    s = shingles(v)
    row = np.repeat(np.arange(len(n)), n)[: len(s)]
    first = np.r_[0, np.cumsum(n)]
    at = np.arange(len(s))
    ok = (at + SHINGLE <= first[row + 1]) & (n[row] >= RUN)
    return s[ok], row[ok], (at - first[row])[ok]


def _placed(sketch=None):
    """A mapInArrow function: (key, text) to (s, key, at), a row per shingle that the sketch, if there is one, has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, row, at = _places(b.column("text"))
            if sketch is not None:
                ok = sketch.value[S.slots(s)] > 0
                s, row, at = s[ok], row[ok], at[ok]
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), b.column("key").take(pa.array(row)), pa.array(at.astype(np.int32))], names=["s", "key", "at"])

    return run


def _shingle_slots(b: pa.RecordBatch) -> np.ndarray:
    return b.column("s").to_numpy(zero_copy_only=False).view(np.uint64)


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_id, run, item_words): documents that hold at least RUN consecutive words of an item, with the longest run.

    Words are runs of letters and digits of the comparable form. Null and empty texts and items of fewer than RUN words
    match nothing; repeated rows of a key come out once; documents are read whole; with no items the result is empty;
    documents and items without a key are left out.
    """
    kind = dict(docs.dtypes)[key]
    i = items.select(F.col(item_key).cast("long").alias("key"), F.col(item_text).alias("text")).filter("key is not null").dropDuplicates(["key"])
    i = stored(i.mapInArrow(_placed(), "s long, key long, at int").withColumnsRenamed({"key": "item_id", "at": "i_at"}), "item_shingles")
    partials = stored(i.select("s").mapInArrow(S.slot_counter(_shingle_slots), S.PARTIAL_SCHEMA), "partials")
    sketch = docs.sparkSession.sparkContext.broadcast(S.table(partials))
    drop_stored(partials)
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull())
    d = d.mapInArrow(_placed(sketch), f"s long, key {kind}, at int")
    d = stored(d.join(small_side(stored(i.select("s").distinct(), "shingles")), "s", "left_semi").distinct(), "hits")

    # the rarest shingle of each window of the items that the corpus may hold
    n = d.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("item_id").orderBy("i_at").rowsBetween(0, NEED - 1)
    known = i.join(small_side(stored(n, "frequencies")), "s", "left")
    rarest = F.min(F.struct("n", "i_at", "s")).over(w)
    # a null, a shingle the corpus lacks, would not be counted
    prefix = known.select("item_id", rarest.alias("x"), F.count("n").over(w).alias("full")).filter(F.col("full") == NEED)
    prefix = stored(prefix.select("item_id", F.col("x.i_at").alias("i_at"), F.col("x.s").alias("s")).distinct(), "prefixes")
    lies = d.join(small_side(prefix), "s").select("key", "item_id", (F.col("at") - F.col("i_at")).alias("shift")).distinct()
    lies = stored(lies, "lies")

    # the item's shingles where the hit puts them, of which the document has how many in a row
    laid = lies.join(small_side(i), "item_id").select("key", "item_id", "shift", "s", (F.col("i_at") + F.col("shift")).alias("at"))
    own = laid.join(d, ["key", "s", "at"], "left_semi")
    along = Window.partitionBy("key", "item_id", "shift").orderBy("at")
    runs = own.withColumn("_g", F.col("at") - F.row_number().over(along)).groupBy("key", "item_id", "shift", "_g").agg(F.count(F.lit(1)).alias("n"))
    best = runs.filter(F.col("n") >= NEED).groupBy("key", "item_id").agg((F.max("n") + SHINGLE - 1).cast("int").alias("run"))
    size = i.groupBy("item_id").agg((F.max("i_at") + SHINGLE).cast("int").alias("item_words"))
    return best.join(small_side(stored(size, "sizes")), "item_id").select(F.col("key").alias(key), "item_id", "run", "item_words")
