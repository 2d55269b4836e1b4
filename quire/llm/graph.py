"""Connected components by alternating stars (Kiveris et al., 2014), as joins and aggregates only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import cut
from quire.session import ship

#: Links that a task puts together at a time; links that are finished in one task.
PIECE, FEW = 1 << 19, 1 << 20


def rooted(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked node but the smallest of those that links connect, with that one."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    for a, b in found:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return [(x, top(x)) for x in [*root] if top(x) != x]


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rooted() of many links: the nodes, and the smallest one of each's."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]  # both are roots
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (above := label[label])).any():
            label = above
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _stars(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The links of some rows, wherever they are, as stars."""
    held: list[pa.RecordBatch] = []

    def closed():
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in roots_of(t.column(0).to_numpy(), t.column(1).to_numpy())], names=["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield closed()
            held = []
    if held:
        yield closed()


def _finished(edges: DataFrame) -> DataFrame:
    """All links as stars by one task if there are FEW at most. More are put together by fewer tasks, without a shuffle, as long as that leaves a
    quarter of them out. edges: a cut table."""
    n = edges.count()
    while n > FEW and n >= 2 * PIECE:
        fewer = cut(edges.coalesce(max(1, n // PIECE)).mapInArrow(_stars, "u long, v long"))
        edges, before = fewer, n
        n = edges.count()
        if 4 * n > 3 * before:
            break
    return edges if n > FEW else cut(edges.coalesce(1).mapInArrow(lambda batches: _stars(batches, FEW + 1), "u long, v long"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `component` (the smallest node reachable) of every node that has a link to another. Links with a null end are none.

    Links that are in a task anyway become stars there first, and one task finishes them as soon as FEW are left. Until then each
    round hangs a node's larger neighbours on its smallest one (large star), then its smaller neighbours and itself
    (small star), until all are stars: a number of rounds logarithmic in the nodes. The smallest neighbours are kept
    apart before they are looked up, so that Spark may split the lookups of a node with very many links.
    """
    ship(links.sparkSession)
    known = links.filter(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    edges = _finished(cut(known.mapInArrow(_stars, "u long, v long")))
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        large = cut(edges.join(least, "v").select("u", F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = _finished(cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionByName(roots)


def _done(edges: DataFrame) -> bool:
    """Whether all are stars: no node hangs on two, or on one that hangs on another."""
    ends = edges.select(F.col("u").alias("x"), "v").unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v")))
    return ends.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("held")).filter("low < high or held and low is not null").isEmpty()
