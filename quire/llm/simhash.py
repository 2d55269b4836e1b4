"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Each whole text gets a 64-bit fingerprint of its word shingles; equal fingerprints become one.
2. How often two bits are set together is counted over all fingerprints (64 x 64 numbers). Correlated bits are put in one
   part, as they tell less than independent ones and would otherwise weaken several parts.
3. For each part and threshold, the candidate pairs are estimated from those counts: the mean and variance of the distance of
   two random fingerprints within the part give a beta-binomial law. With m parts and radius r, thresholds that add up to
   r - m + 1 find every pair (a threshold of -1 leaves the part out); dynamic programming picks them, and the number of
   parts, for the least estimated work.
4. A fingerprint is indexed under its value in each part and probes all values within the part's threshold. Fingerprints that
   meet are verified on all 64 bits. A value that very many share is dealt out in tiles, every pair of tiles to a task of its
   own, and a task gives a spanning forest of what it links instead of all pairs: components stay the same.
5. Components of the links come from alternating stars.

Null and blank texts have fingerprint 0, which links like any other. Rows with a null key get the component of their
fingerprint's other rows, or null. Repeated rows stay. Only `key` and `text` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import cut, picked, within
from quire.llm.graph import components

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
#: Rows of one value that a tile holds.
TILE = 512
#: Estimated microseconds for a row that is indexed or probes, and for a candidate that is verified.
ROW_COST, CANDIDATE_COST = 1.0, 0.02
SMALL_RUN = 32


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text, A-Z in lower case; one of all words if there are fewer."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    flat = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(found) - words + 1)
    starts, ends = (ends - sizes)[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(flat.__getitem__, map(slice, starts, ends))), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in more than half of the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """`k`, `fp` of every row."""
    rows = picked(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["k", "fp"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: their number, and in how many bits i and j are both set (64 x 64)."""
    cells = [(i, j) for i in range(BITS) for j in range(i, BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for i in range(0, len(fp), 1 << 14):
                bits = np.unpackbits(fp[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(fp)
        if n:
            yield pa.RecordBatch.from_pydict({"cell": pa.array([*range(len(cells) + 1)], pa.int32()), "n": pa.array([int(both[c]) for c in cells] + [n], pa.int64())})

    held = {r.cell: r.n for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    both = np.zeros((BITS, BITS))
    for c, (i, j) in enumerate(cells):
        both[i, j] = both[j, i] = held.get(c, 0)
    return held.get(len(cells), 0), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of near-equal size; a group takes the bit that correlates most with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        rest = sorted(left)
        group = [max(rest, key=lambda i: (corr[i, rest].sum(), -i))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def expected_pairs(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated pairs within distance 0, 1, ... `most` of each other in a group of bits."""
    w, p = len(group), np.diag(both)[group] / max(n, 1)
    p11 = both[np.ix_(group, group)] / max(n, 1)
    p10 = p[:, None] - p11
    differ = 2 * (p11 * (1 - p[:, None] - p[None, :] + p11) + p10 * p10.T)
    np.fill_diagonal(differ, 2 * p * (1 - p))
    mean = np.trace(differ)
    var = max(differ.sum() - mean**2, 1e-9)
    q = min(max(mean / w, 1e-9), 1 - 1e-9)
    rho = min(max((var / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-6), 0.999)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    law = [math.comb(w, d) * math.exp(beta(d + a, w - d + b) - beta(a, b)) for d in range(most + 1)]
    return [n * (n - 1) / 2 * min(1, sum(law[: d + 1])) for d in range(most + 1)]


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The parts that are used, each with its threshold, for the least estimated work."""
    best = (math.inf, [])
    for m in range(2, radius + 3):
        groups, top = grouped_bits(n, both, m), min(radius, 3)
        costs = []
        for g in groups:
            pairs, probes = expected_pairs(n, both, g, top), [sum(math.comb(len(g), i) for i in range(t + 1)) for t in range(top + 1)]
            costs.append({-1: 0.0, **{t: n * (1 if t == 0 else 1 + probes[t]) * ROW_COST + pairs[t] * (1 if t == 0 else 2) * CANDIDATE_COST for t in range(top + 1)}})
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for total, (spent, chosen) in reach.items():
                for t, c in cost.items():
                    if spent + c < new.get(total + t, (math.inf,))[0]:
                        new[total + t] = (spent + c, [*chosen, t])
            reach = new
        if (found := reach.get(radius - m + 1)) and found[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def part_value(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, side by side."""
    out = np.zeros(len(fp), np.uint64)
    for i, bit in enumerate(group):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
    return out


def near_values(values: np.ndarray, width: int, threshold: int) -> Iterator[np.ndarray]:
    """All values within `threshold` bits, themselves first."""
    from itertools import combinations

    for t in range(threshold + 1):
        for bits in combinations(range(width), t):
            yield values ^ np.uint64(sum(1 << b for b in bits))


#: What a row is under a value.
INDEXED, PROBES = 1, 2


def keyed(reps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """reps: `id`, `fp`. A row for each part and value: key, id, fp, role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, signed = b.column(0), b.column(1)
            fp = signed.to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            for number, (group, t) in enumerate(parts):
                base = part_value(fp, group)
                rows = [(base, INDEXED | PROBES)] if t == 0 else [(base, INDEXED), *((x, PROBES) for x in near_values(base, len(group), t))]
                for value, role in rows:
                    key = value.astype("<i8") | np.int64(number << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key), ids, signed, pa.array(np.full(len(fp), role, np.int32))], names=["key", "id", "fp", "role"])

    return reps.select("id", "fp").mapInArrow(run, "key long, id long, fp long, role int")


def dealt(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """rows with `key` and `fp`: adds `bucket` (a number that rows to be compared share), `tile` and `whole` (false where only rows of
    different tiles are to be compared). Keys with more than `tile` rows are split; every two of their tiles share a bucket."""
    large = within(cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile)))
    tiles = F.coalesce(F.ceil(F.col("n") / tile).cast("int"), F.lit(1))
    split = rows.join(large, "key", "left").withColumn("tiles", tiles).drop("n").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    one, two = F.least("tile", "other"), F.greatest("tile", "other")
    return split.select(*rows.columns, F.xxhash64("key", one, two).alias("bucket"), "tile", (one == two).alias("whole"))


def forest(near: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches. near: a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of `rows` rows or more that don't cut a run of equal values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        values = t.column(column).to_numpy()
        end = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        if end:
            yield t.slice(0, end)
        held = t.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def linked(bucketed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links `a`, `b` between ids of a bucket whose fingerprints differ in `radius` bits at most: all of a small bucket's, a spanning forest of a large one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "bucket"):
            bucket, key, ids, tile, role = (t.column(c).to_numpy() for c in ("bucket", "key", "id", "tile", "role"))
            fp, whole = t.column("fp").to_numpy().view("<u8"), t.column("whole").to_numpy()
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, len(bucket)])
            small = np.repeat(sizes <= SMALL_RUN, sizes)
            found = []
            at = np.flatnonzero(small)
            for d in range(1, SMALL_RUN):
                at = at[at + d < len(bucket)]
                at = at[bucket[at] == bucket[at + d]]
                if not len(at):
                    break
                other = at + d
                meets = (key[at] == key[other]) & ((role[at] & (role[other] >> 1) | role[other] & (role[at] >> 1)) & 1).astype(bool) & (whole[at] | (tile[at] != tile[other]))
                near = meets & (np.bitwise_count(fp[at] ^ fp[other]) <= radius) & (ids[at] != ids[other])
                found.append((ids[at[near]], ids[other[near]]))
            for s, n in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
                part = slice(s, s + n)
                label = forest(np.bitwise_count(fp[part][:, None] ^ fp[part][None, :]) <= radius)
                own = label != np.arange(n)
                found.append((ids[part][own], ids[part][label[own]]))
            a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

    return bucketed.select("bucket", "key", "id", "fp", "role", "tile", "whole").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """`key`, `fp` (long) and `component_id` (the smallest key that chains of links reach) of every row. key: whole numbers."""
    fps = cut(fingerprints(docs, key, text, words))
    reps = cut(fps.filter(F.col("k").isNotNull()).groupBy("fp").agg(F.min("k").cast("long").alias("id")))
    parts = allocate(*bit_counts(reps), radius)
    links = linked(dealt(keyed(reps, parts)), radius)
    found = components(links)
    of_fp = reps.join(found, reps["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select(F.col("k").alias(key), "fp", "component_id")
