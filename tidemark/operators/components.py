"""Connected components of an edge table, by hooking to the least neighbour and contraction.

Every node hooks to its least neighbour if that is smaller than itself, pointers are shortened until all name their roots,
and the edges are rewritten between the roots; self-loops and repeats drop out. A root whose neighbours all went elsewhere
has a smaller neighbour in the next round, so two rounds at least halve the nodes, and a shortening doubles what a pointer
spans: both loops are logarithmic and end only when nothing is left. Only minimum aggregates and equi-joins are used, so a node
with very many neighbours is pre-aggregated on the map side and never gathered. Each round works on the shrunken graph,
written to the shared folder. A small edge table, by its stored bytes, may be solved by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_stored, stored, stored_bytes


def _shortened(hook: DataFrame, rounds: int) -> DataFrame:
    """hook (u, p), p <= u, with each p replaced by its root; hook itself is deleted."""
    for _ in range(rounds):
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = stored(hook.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "jumps")
        drop_stored(hook)
        hook = jump
        if jump.filter("moved").isEmpty():
            return jump
    raise RuntimeError(f"components: pointers without their roots after {rounds} shortenings")


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same hooking and shortening over arrays, for all edges of a task."""
    uv = [b[["u", "v"]].to_numpy() for b in batches]
    if not uv:
        return
    ids, at = np.unique(np.concatenate(uv), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    p = np.arange(len(ids))
    while len(u):
        np.minimum.at(p, np.maximum(u, v), np.minimum(u, v))
        while (q := p[p]).tobytes() != p.tobytes():
            p = q
        u, v = p[u], p[v]
        left = u != v
        u, v = u[left], v[left]
    yield pd.DataFrame({"id": ids, "root": ids[p]})


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, whole: int = 0) -> DataFrame:
    """(id, root): root is the least id of id's component; ids in no edge between two different ids are left out. Nulls are dropped.

    rounds is a safety bound: an error is raised where edges are left after it. whole: bytes of stored edges between ids of
    type bigint up to which one task takes them all, instead of some ten small steps whose plans fill the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = stored(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if whole and stored_bytes(e) <= whole:
        solved = stored(e.coalesce(1).mapInPandas(_solved, "id bigint, root bigint"), "assigned")
        drop_stored(e)
        return solved
    assigned: DataFrame | None = None
    for done in count():
        if e.isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"components: edges left after {rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        jump = _shortened(stored(hook, "hooks"), rounds)
        pu = jump.select("u", F.col("p").alias("pu"))
        pv = jump.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        nxt = e.join(pu, "u").join(pv, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        nxt = stored(nxt, "edges")
        if assigned is None:
            now = jump.select(F.col("u").alias("id"), F.col("p").alias("root"))
        else:
            now = assigned.join(jump.select(F.col("u").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        now = stored(now, "assigned")
        for old in (e, assigned):
            if old is not None:
                drop_stored(old)
        if assigned is not None:
            drop_stored(jump)
        e, assigned = nxt, now
    if assigned is None:
        return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return assigned
