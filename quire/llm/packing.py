"""Best-fit packing of documents into sequences of a fixed capacity, in bulk-synchronous supersteps.

Documents become pieces (only those longer than the capacity are cut). Pieces and gaps are range-sorted by size. As sizes
are whole numbers up to the capacity, each side is a list of at most `capacity` runs of equal size, however many documents
there are. A superstep takes the longest run that is left, sweeps to its successor among the gaps (the smallest that is
large enough), and resolves conflicts by rank: piece number r of the run takes place number r of the gap's run. Gaps shrink,
move to the run of their new size, and the sweep goes on; what no gap can take opens sequences. The runs (bounded by the
capacity) are swept on the driver; ranking the pieces and placing them, all that grows with the data, is distributed:
a piece's rank is its number within (length, salt) plus what the salts before it hold, so that no length, however common,
meets in one task. A piece finds its placement, the one that holds its rank, by binary search in the list of all (one closure, of some
tens of numbers for each length). No piece is dropped and none is cut that fits.

Null and empty texts count as the end id alone. Repeated rows and keys are packed each. Only `key` and `text` are read. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm._shared import cut, picked
from quire.llm.tokens import json_encoder

CAPACITY = 4_096
#: Rows of one length that a task may have to number; a salt for each so many, and SALTS at least.
SALTED, SALTS = 50_000, 64
#: Placements that a task may hold.
PLACEMENTS = 2_000_000


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`k`, piece, start, length, ids_crc32 of each piece; the crc32 is of the ids as little-endian unsigned 32-bit numbers."""
    rows = picked(docs, key, text)
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = json_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            at, columns = [], ([], [], [], [])
            for i, t in enumerate(b.column(1)):
                ids = memoryview(encoder.encode(t.as_py()) + end)
                for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    at.append(i)
                    for c, v in zip(columns, (n, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["k", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The supersteps over runs. counts: pieces of each length. Gives the placements, (length, lo, hi, sequence, offset): pieces of
    that length with rank lo to hi - 1 go to sequences from `sequence` on, one in each, at that offset; and the number of sequences."""
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: sequences [first, last) with that much room
    sizes: list[int] = []  # those with a gap, ascending
    made = 0

    def give(gap: int, first: int, last: int) -> None:
        if gap and last > first:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, last))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect_left(sizes, size)
            if i < len(sizes):
                gap = sizes[i]
                first, last = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[i]
            else:
                gap, first = capacity, made
                last = made = made + -(-left // (capacity // size))
            each = gap // size
            full = min(last - first, left // each)
            few = left - each * full if full < last - first else 0  # for one more sequence that isn't filled
            for n, start, width in ((each, first, full), (few, first + full, 1)):
                for j in range(n if width else 0):
                    placed.append((size, rank, rank + width, start, capacity - gap + j * size))
                    rank += width
                    left -= width
            give(gap - each * size, first, first + full)
            give(gap - few * size, first + full, first + full + (few > 0))
            give(gap, first + full + (few > 0), last)
    return placed, made


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, piece, start, length, ids_crc32, sequence_id, offset, of each piece."""
    pieces = cut(pieces_of(docs, vocabulary, end_id, capacity, key, text))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = best_fit(counts, capacity)
    salts = max(SALTS, -(-max(counts.values(), default=0) // SALTED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("k", "piece", "ids_crc32"), F.lit(salts)))
    held = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = held.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(W.partitionBy("length", "salt").orderBy("k", "piece")) - 1).join(before, ["length", "salt"])
    plan = np.array(sorted(placed), np.int64).reshape(-1, 5)  # its size follows the capacity, not the documents
    if len(plan) > PLACEMENTS:
        raise ValueError(f"{len(plan)} placements, more than {PLACEMENTS}: use a smaller capacity")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = plan[:, 0] << 40 | plan[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(order, length << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(plan[at, 3] + rank - plan[at, 1]), pa.array(plan[at, 4])], names=["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["k"].dataType.simpleString()
    done = ranked.select("k", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r")).cast("long").alias("rank"))
    done = done.mapInArrow(located, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return done.withColumnRenamed("k", key)
