"""Exact top-k by inner product over a pivot-distance index.

Components become whole numbers, floor(scale * x). A vector is lifted by one coordinate so that all have the largest
norm R, and a query by a 0: then |q' - x'|^2 = |q|^2 + R^2 - 2 q.x, and the nearest lifted vectors are those of the highest score. Each is keyed by its
nearest pivot and its distance r to it; sorted by that key, the vectors of a pivot are cut into annuli, and some annuli make a
segment. By the triangle inequality no vector of an annulus [a, b] around p is nearer to q' than the distance of |q' - p|
from [a, b], so an annulus is passed over once that bound leaves no score as high as the query's k-th so far. Each query
first expands the annuli of one segment, the one with the best bound at its nearest pivot, and then goes, with the k-th
score found there, to the segments that the bounds leave, where it expands the annuli from the nearest outwards.

The pivots are fitted to a bounded sample; every vector is indexed, and results are exact whatever the pivots are. The
driver holds the pivots and a directory of DIRECTORY segments or little more, as segments of larger tables hold more vectors.
Queries travel in blocks to segments.

Vectors that are null or hold a null, NaN or infinite component take no part. Shorter vectors count as padded with
zeros. Scores are exact: where the largest squared norm reaches 2^53, products are worked out in whole numbers of any size, and a
score beyond 64 bits raises OverflowError. Ties go to the smaller id; equal ids are told apart by nothing, so a query leaves out all
rows with its own id. Null ids take no part. Only `key` and `vector` are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm._shared import cut
from quire.session import ship

K, SCALE = 5, 256
PIVOTS, PIVOT_SAMPLE = 32, 4_096
ANNULUS, SEGMENT, BLOCK = 512, 4_096, 256
#: Segments that the driver lists, and cells of a matrix of queries by segments.
DIRECTORY, CELLS = 65_536, 1 << 22


def fit_pivots(x: np.ndarray, n: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Pivots by farthest-first choice and a few rounds of means."""
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    pivots = x[chosen].astype(float)
    for _ in range(rounds):
        own = distances(x, pivots).argmin(1)
        pivots = np.array([x[own == i].mean(0) if (own == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))]


def asking(q: np.ndarray) -> np.ndarray:
    """Queries beside lifted vectors."""
    return np.c_[q, np.zeros(len(q))]


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float) * scale)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _rows(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def _pack(size: int):
    """Rows sorted by their first column, `size` of them at most, of a value, become one: that value, and each other column's values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            t = pa.Table.from_batches([x for x in (held, b) if x is not None]) if held is not None or b is not None else None
            if t is None or not t.num_rows:
                continue
            t = t.combine_chunks()
            g = t.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            ends = np.r_[cuts[1:], len(g)]
            if b is not None:  # the last group may go on
                held = t.slice(int(cuts[-1])).combine_chunks().to_batches()[0]
                cuts, ends = cuts[:-1], ends[:-1]
            spans = [(i, min(i + size, e)) for s, e in zip(cuts, ends, strict=True) for i in range(s, e, size)]
            columns = [pa.array([g[s] for s, _ in spans], pa.int64())]
            for name in t.column_names[1:]:
                v = t.column(name).combine_chunks()
                v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
                columns.append(pa.array([b"".join(v.slice(s, e - s).to_pylist()) if pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type) else v.slice(s, e - s).to_numpy().tobytes() for s, e in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=t.column_names)

    return run


def search(vectors: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """`query_id`, `rank` (from 1), `key`, `score`: the k highest inner products of each row that `queries` (a condition on `key`) holds for, with any other row."""
    spark = ship(vectors.sparkSession)
    clean = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.select(F.col(key).alias(key), F.col(vector).alias("x")).filter(clean & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform("x", lambda c: c.cast("double")).alias("x"), queries.alias("asks"))
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    dim, held = rows.agg(F.max(F.size("x")), F.count("*")).first()
    if not dim:
        return empty
    segment = max(SEGMENT, -(-held // DIRECTORY))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [float((_matrix(b.column(0), dim, scale) ** 2).sum(1).max()) for b in batches if b.num_rows]
        yield pa.RecordBatch.from_pydict({"top": pa.array([max(found, default=0.0)])})

    top = rows.select("x").mapInArrow(tops, "top double").agg(F.max("top")).first()[0]
    sample = [r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()]
    points = fit_pivots(lifted(_matrix(pa.array(sample, pa.list_(pa.float64())), dim, scale), top), pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim, scale)
            far = distances(lifted(x, top), points)
            own = far.argmin(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(far[np.arange(len(x)), own]), b.column(0), pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary()), b.column(2)], names=["cell", "r", "id", "x", "asks"])

    keyed = cut(rows.mapInArrow(assign, "cell long, r double, id long, x binary, asks boolean"))
    ordered = keyed.select("cell", "r", "id", "x").repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id")
    packed = ordered.mapInArrow(_pack(segment), "cell long, r binary, id binary, x binary")
    segments = cut(packed.withColumn("segment", F.monotonically_increasing_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [np.frombuffer(x.as_py(), "<f8") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v[0] for v in r], pa.float64()), pa.array([v[-1] for v in r], pa.float64())], names=["segment", "cell", "low", "high"])

    listed = segments.select("segment", "cell", "r").mapInArrow(ends, "segment long, cell long, low double, high double").collect()
    if not listed:
        return empty
    names, cells, low, high = (np.array([r[i] for r in listed]) for i in range(4))
    slack = 1e-6 * (1 + top)

    def bound(x: np.ndarray) -> np.ndarray:
        """Of each query, the highest score that each segment's bound leaves."""
        far = distances(asking(x), points)[:, cells]
        gap = np.maximum(np.maximum(low[None, :] - far, far - high[None, :]), 0)
        return ((x**2).sum(1)[:, None] + top - gap**2) / 2 + slack

    def first_stop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(cells)):
            x = _rows(b"".join(b.column(1).to_pylist()), dim)
            home = np.array(b.column(2).to_numpy())
            best = np.where(cells[None, :] == home[:, None], bound(x), -np.inf).argmax(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(names[best]), b.column(0), b.column(1), pa.array(np.full(len(x), -np.inf))], names=["segment", "id", "x", "least"])

    def other_stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(cells)):
            x, done, least = _rows(b"".join(b.column(1).to_pylist()), dim), b.column(2).to_numpy(), b.column(3).to_numpy()
            q, s = np.nonzero((bound(x) >= least[:, None]) & (names[None, :] != done[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(names[s]), b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(least[q])], names=["segment", "id", "x", "least"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                segment, qid, q, least, cell, r, ids, x = (c[row].as_py() for c in b.columns)
                qid, q, least = np.frombuffer(qid, "<i8"), _rows(q, dim), np.frombuffer(least, "<f8")
                r, ids, x = np.frombuffer(r, "<f8"), np.frombuffer(ids, "<i8"), _rows(x, dim)
                scores, found = expanded(q, qid, least, distances(asking(q), points[cell : cell + 1])[:, 0], r, ids, x, k, top, slack)
                real = scores != -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array([v.tobytes() for v in q.astype("<f8")], pa.binary()), pa.array(np.full(len(qid), segment)), pa.array(np.maximum(np.where(real.sum(1) == k, scores[:, -1], -np.inf).astype(float), least) if k else least), pa.array([i[m].tolist() for i, m in zip(found, real, strict=True)], pa.list_(pa.int64())), pa.array([[int(v) for v in s[m]] for s, m in zip(scores, real, strict=True)], pa.list_(pa.int64()))], names=["id", "x", "segment", "least", "found", "scores"])

    def visit(stops: DataFrame) -> DataFrame:
        blocks = stops.repartitionByRange("segment", "id").sortWithinPartitions("segment", "id").mapInArrow(_pack(BLOCK), "segment long, id binary, x binary, least binary")
        there = segments.select("segment", "cell", F.col("r").alias("r"), F.col("id").alias("ids"), F.col("x").alias("xs"))
        met = blocks.join(there, "segment").select("segment", "id", "x", "least", "cell", "r", "ids", "xs")
        return met.mapInArrow(expand, "id long, x binary, segment long, least double, found array<long>, scores array<long>")

    asked = keyed.filter("asks").select("id", "x", "cell").dropDuplicates(["id", "x"])
    stop = "segment long, id long, x binary, least double"
    near = cut(visit(asked.mapInArrow(first_stop, stop)))
    rest = visit(near.select("id", "x", "segment", "least").mapInArrow(other_stops, stop))
    pairs = near.select("id", "found", "scores").unionByName(rest.select("id", "found", "scores")).select("id", F.explode(F.arrays_zip("found", "scores")).alias("p"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    out = pairs.select(F.col("id").alias("query_id"), F.col("p.found").alias(key), F.col("p.scores").alias("score"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows that a matrix of them by `width` columns has CELLS cells at most."""
    rows = max(1, CELLS // max(width, 1))
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def expanded(q: np.ndarray, qid: np.ndarray, least: np.ndarray, far: np.ndarray, r: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, top: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a segment for each query (-inf where there are fewer): annuli from the nearest outwards, until no bound reaches the k-th score."""
    starts = np.arange(0, len(ids), ANNULUS)
    low, high = r[starts], r[np.minimum(starts + ANNULUS, len(ids)) - 1]
    gap = np.maximum(np.maximum(low[None, :] - far[:, None], far[:, None] - high[None, :]), 0)
    limit = ((q**2).sum(1)[:, None] + top - gap**2) / 2 + slack
    order = np.argsort(gap, axis=1, kind="stable")
    exact = float if top < 1 << 53 else object
    scores, found = np.full((len(q), k), -np.inf).astype(exact), np.full((len(q), k), np.iinfo(np.int64).max)
    if exact is object:  # whole numbers of any size
        q, x = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
    for turn in range(len(starts)):
        which = order[:, turn]
        live = limit[np.arange(len(q)), which] >= np.maximum(scores[:, -1], least)
        if not live.any():
            break  # later annuli are no nearer
        for a in np.unique(which[live]):
            at = np.flatnonzero(live & (which == a))
            part = slice(starts[a], starts[a] + ANNULUS)
            s = q[at] @ x[part].T
            s[ids[part][None, :] == qid[at][:, None]] = -np.inf
            both_s, both_i = np.c_[scores[at], s], np.c_[found[at], np.broadcast_to(ids[part], s.shape)]
            scores[at], found[at] = best_of(both_s, both_i, k)
    return scores, found


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k highest scores and their ids; ties to the smaller id."""
    order = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
