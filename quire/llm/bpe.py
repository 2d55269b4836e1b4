"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenated bytes.

Texts of up to `chunk` characters are encoded where they lie. A longer one is cut into chunks that overlap; chunks are
pre-tokenised in parallel, neighbours are stitched at the first place of their overlap where both have a pre-token
boundary (from a common boundary on, a pattern without look-behind matches alike) that no white space precedes (where a
pattern may look ahead, and a piece's end would show it nothing), and the stitched pieces are encoded in parallel and put
together again. Where no boundary is common, two chunks become one: exact, only less parallel.

Null and empty texts have no ids. Repeated rows and repeated keys give a row each. Only `key` and `text` are read, so
further columns, whatever their names, neither matter nor come back. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._shared import picked
from quire.llm.tokens import RankEncoder, rank_encoder
from quire.session import ship

CHUNK, OVERLAP = 32_768, 2_048


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`key`, `ids` (binary: little-endian unsigned 32-bit ids). vocabulary: a rank file's path on every executor."""
    assert 0 < overlap < chunk
    rows = picked(docs, key, text)
    kind = rows.schema["k"].dataType.simpleString()
    size = F.length("t")
    short = rows.filter(size <= chunk).mapInArrow(_whole(vocabulary, pattern), f"k {kind}, ids binary")
    long = rows.filter(size > chunk).withColumn("row", F.monotonically_increasing_id())
    chunks = long.mapInArrow(_chunks(chunk, overlap), f"row long, k {kind}, n long, at long, t string").repartition("row", "n")
    bounds = chunks.mapInArrow(_boundaries(vocabulary, pattern, chunk, overlap), f"row long, k {kind}, n long, at long, t string, head array<long>, tail array<long>")
    pieces = bounds.groupBy("row").applyInPandas(_stitched(vocabulary, pattern, chunk, overlap), f"row long, k {kind}, n long, t string").repartition("row", "n")
    encoded = pieces.mapInArrow(_whole(vocabulary, pattern), f"row long, k {kind}, n long, ids binary")
    joined = encoded.groupBy("row").applyInPandas(_joined, f"k {kind}, ids binary")
    return short.unionByName(joined).select(F.col("k").alias(key), "ids")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows of `encoded` with column `to` (binary): the bytes of all ids, one after the other; null ids give null. A column named `to` is replaced."""
    ship(encoded.sparkSession)
    rows = encoded.drop(to) if to != ids else encoded.withColumnRenamed(ids, "_ids")
    source = ids if to != ids else "_ids"
    out = T.StructType([*rows.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        raw = rank_encoder(vocabulary, pattern).raw()
        for b in batches:
            values = b.column(b.schema.get_field_index(source))
            done = [None if v is None else b"".join(map(raw.__getitem__, np.frombuffer(v, "<u4").tolist())) for v in (x.as_py() for x in values)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.binary())], names=[*b.schema.names, to])

    return rows.mapInArrow(run, out)


def _whole(vocabulary: str, pattern: str):
    """The text in the last column becomes its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(vocabulary, pattern)
        for b in batches:
            for part in _parts(b):
                ids = pa.array([encoder.encode(t) for t in part.column(part.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    return run


def _parts(b: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "k", "n", "at", "t"]
        for b in batches:
            for k, t, row in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t = t.as_py()
                starts = range(0, len(t), chunk)
                columns = [[row.as_py()] * len(starts), pa.array([k.as_py()] * len(starts), k.type), [*range(len(starts))], [*starts], [t[i : i + chunk + overlap] for i in starts]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return run


def cut_points(encoder: RankEncoder, text: str, at: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The pre-token boundaries of a chunk that starts at `at`: those in the overlap with the chunk before, and those in the overlap with the next.
    The last match may go on beyond the chunk, so the chunk's own end isn't among them."""
    ends = [at, *(at + e for e in encoder.ends(text) if e < len(text))]
    return [e for e in ends if e < at + overlap], [e for e in ends if e >= at + chunk]


def _boundaries(vocabulary: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(vocabulary, pattern)
        for b in batches:
            found = [cut_points(encoder, t, at, chunk, overlap) for at, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1))], names=[*b.schema.names, "head", "tail"])

    return run


def stitch(encoder: RankEncoder, chunks: list[tuple[int, str, list[int], list[int]]], chunk: int, overlap: int) -> list[str]:
    """The pieces of one text, from its chunks in order: (at, text, head, tail)."""
    pieces, (at, text, _, tail) = [], chunks[0]
    for start, more, head, its_tail in chunks[1:]:
        ends = set(tail)
        meet = next((p for p in head if p in ends and not text[p - at - 1].isspace()), None)
        if meet is None:  # nothing in common: the two become one, and its boundaries are looked for again
            text += more[at + len(text) - start :]
            tail = [at + e for e in encoder.ends(text) if start + chunk <= at + e < at + len(text)]
        else:
            pieces.append(text[: meet - at])
            at, text, tail = meet, more[meet - start :], its_tail
    return [*pieces, text]


def _stitched(vocabulary: str, pattern: str, chunk: int, overlap: int):
    def run(pdf):
        pdf = pdf.sort_values("n")
        pieces = stitch(rank_encoder(vocabulary, pattern), [*zip(pdf["at"], pdf["t"], map(list, pdf["head"]), map(list, pdf["tail"]), strict=True)], chunk, overlap)
        return pdf.iloc[[0] * len(pieces)].assign(n=range(len(pieces)), t=pieces)[["row", "k", "n", "t"]]

    return run


def _joined(pdf):
    pdf = pdf.sort_values("n")
    return pdf.iloc[:1].assign(ids=[b"".join(pdf["ids"])])[["k", "ids"]]
