"""Near-duplicate documents by the Jaccard similarity of their word shingles.

1. Texts with the same set of shingles are one. Each set has a 64-bit SimHash, its fingerprint. Fingerprints that differ in `near` bits at
   most are found by the generalised pigeonhole principle, with op1's parts, thresholds and tiles (see simhash), over all sets.
2. Sets of similarity 0.8 differ in 10 bits on average and up to 24, and parts for 24 of 64 bits would have 2 or 3 bits each. So that no
   such pair is lost, sets that share one of BANDS values made of ROWS MinHashes each are candidates as well; two sets of similarity s share
   one with a chance of 1 - (1 - s^ROWS)^BANDS, which at 0.8 is above 0.9997. Fingerprints of more than `radius` bits apart are no candidates.
3. All sets that either way puts together are verified where they are together (see bands). A link stays if the similarity of the whole
   sets is at least `similarity`.
4. Components of the links come from alternating stars.

Blank texts are no copies of one another. Rows with a null key take no part. Repeated rows are copies, and have the same key. Only `key`
(whole numbers) and `text` are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bands
from quire.llm._shared import cut, picked, within
from quire.llm.graph import components
from quire.llm.simhash import allocate, bit_counts, dealt, fingerprint, linked, shingle_hashes
from quire.llm.simhash import keyed as by_part
from quire.llm.tokens import tidy

WORDS, SIMILARITY, BANDS, ROWS, RADIUS, NEAR = 5, 0.8, 16, 4, 24, 4


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, words))


def values_of(h: np.ndarray) -> np.ndarray:
    """The BANDS values of a set of hashes."""
    rng = np.random.default_rng(42)
    a, b = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 12):
        x = (h[i : i + (1 << 12), None] ^ b) * (a | np.uint64(1))
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    value = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        value = (value ^ row) * np.uint64(0xC2B2AE3D27D4EB4F)
        value ^= value >> np.uint64(31)
    return (value >> np.uint64(32)).astype("<u4")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def near_fingerprints(sets: DataFrame, near: int = NEAR) -> DataFrame:
    """`a`, `b`: links between the smallest ids of fingerprints that differ in `near` bits at most, by parts, and from every other id of a
    fingerprint to its smallest. sets: a cut table of `id`, distinct, and `fp`."""
    reps = cut(sets.groupBy("fp").agg(F.min("id").alias("id")))
    links = linked(dealt(by_part(reps, allocate(*bit_counts(reps), near))), near)
    return links.unionByName(sets.select("fp", F.col("id").alias("a")).join(reps, "fp").filter("a != id").select("a", F.col("id").alias("b")))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, near: int = NEAR) -> DataFrame:
    """`key`, distinct, of the rows that aren't their group's smallest."""
    rows = picked(docs.filter(F.col(key).isNotNull()), key, text)
    held = bands.names(BANDS)

    def drawn_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(1)]
            own = [i for i, h in enumerate(sets) if len(h)]
            sets = [sets[i] for i in own]
            ids = [xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) for h in sets]
            values = np.array([values_of(h) for h in sets], "<u4").reshape(-1, BANDS)
            fp = [fingerprint(h) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(own, pa.int64())), pa.array(ids, pa.int64()), pa.array(fp, pa.int64()), *bands.columns(values)], names=["k", "id", "fp", *held])

    drawn = cut(rows.mapInArrow(tidy(drawn_of), f"k long, id long, fp long, {', '.join(f'{v} long' for v in held)}"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(2)], pa.binary())], names=["id", "component", "line"])

    def fetch(near: DataFrame) -> DataFrame:
        one = drawn.select("k", "id").join(within(near, bands.NARROW), "id").groupBy("id", "component").agg(F.min("k").alias("k"))
        some = rows.join(within(cut(one), bands.NARROW), "k").select("id", "component", "t").mapInArrow(tidy(named), "id long, component long, line binary")
        return some.dropDuplicates(["id"])

    def made(b: bytes) -> np.ndarray:
        return np.frombuffer(b, np.uint64)

    def sketch(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([fingerprint(made(b)) for b in sets], np.int64), np.array([values_of(made(b)) for b in sets], "<u4").reshape(-1, BANDS)

    chained = components(near_fingerprints(cut(drawn.select("id", "fp").distinct()), near))
    chained = chained.select((F.xxhash64("component").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(BANDS << 32).cast("long")).alias("key"), F.col("node").alias("id"))
    keyed = cut(bands.by_value(drawn, BANDS).select("key", "id").unionByName(chained))
    group = within(bands.clusters(keyed, BANDS, fetch, sketch, made, lambda x, y: alike(x, y, similarity), RADIUS, None, near), bands.NARROW)
    placed = drawn.select("k", "id").join(group.withColumnRenamed("node", "id"), "id", "left").select("k", F.coalesce("component", "id").alias("group"))
    first = cut(placed.groupBy("group").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last"))
    return placed.join(within(first), "group").filter("k != first").select(F.col("k").cast(docs.schema[key].dataType).alias(key)).distinct()
