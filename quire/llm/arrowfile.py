"""Token ids as Arrow stream files of fixed-size lists: equal-length sequences with masks, read in place by memory mapping.

encode_to_files() range-sorts the documents by key, appends an end id to each, and writes one shard per partition: a
stream of record batches whose two columns are fixed-size lists, `ids` (uint16 where that holds every id of the vocabulary,
else uint32) and `mask` (a bit for each id, eight to a uint8 from the lowest on, 0 where the last sequence is padded; Arrow's own
booleans couldn't be read in place). Beside it lies the shard's index (key, start in the shard, length). A shard's ids follow those of the
shard before it, so a document's place among all ids is its shard's base plus its start; the bases are a running sum over
one number per shard. Files are moved into place when complete, so a task that is run again replaces the same file.

Null and empty texts have the end id alone. Repeated keys and rows are kept, in the order of (key, hash of the text), and dealt
to shards by both, so that a key that many rows have, or a null one, doesn't fill one; a null key sorts first. Only `key` and `text` are read, so other columns don't matter. An empty table gives shards without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import Store, picked
from quire.llm.tokens import json_encoder

SEQUENCE, BATCH = 2_048, 64
#: Chunks of text whose ids a worker remembers; a miss costs some ten times as much as a chunk that is known.
KNOWN = 400_000


def sequence_schema(length: int, ids: int) -> pa.Schema:
    """ids: the number of ids that may occur."""
    return pa.schema([("ids", pa.list_(pa.uint16() if ids <= 1 << 16 else pa.uint32(), length)), ("mask", pa.list_(pa.uint8(), length // 8))])


class ShardWriter:
    """Collects ids and writes full batches of `batch` sequences; close() pads and writes the rest."""

    def __init__(self, sink, ids: int, length: int = SEQUENCE, batch: int = BATCH):
        if length % 8:
            raise ValueError("a sequence's length has to be a multiple of eight")
        self.length, self.unit, self.held, self.size, self.total = length, length * batch, [], 0, 0
        self.schema = sequence_schema(length, ids)
        self.kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.out = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.unit:
            self._write(self.size - self.size % self.unit)

    def _write(self, n: int) -> None:
        all_ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        now, rest = all_ids[:n], all_ids[n:]
        for i in range(0, len(now), self.unit):
            part = now[i : i + self.unit]
            full = -(-len(part) // self.length) * self.length
            ids = np.zeros(full, self.kind)
            ids[: len(part)] = part
            mask = np.packbits(np.arange(full) < len(part), bitorder="little")
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((ids, self.length), (mask, self.length // 8))]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held, self.size = [rest], len(rest)

    def close(self) -> int:
        self._write(self.size)
        self.out.close()
        return self.total


class Shard:
    """A shard read in place: every batch but the last has the same number of sequences, so a place in the stream is found by division.
    source: an Arrow file, memory-mapped where the store is a local file system."""

    def __init__(self, source):
        with pa.ipc.open_stream(source) as stream:
            self.batches = [*stream]
        self.length = stream.schema.field("ids").type.list_size
        self.unit = self.length * self.batches[0].num_rows if self.batches else 0

    def flat(self, i: int, column: str = "ids") -> np.ndarray:
        return self.batches[i].column(column).flatten().to_numpy(zero_copy_only=True)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start`; without a copy if they lie in one batch."""
        parts = []
        while n > 0:
            i, at = divmod(start, self.unit)
            part = self.flat(i)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, "<u4")])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i and its mask, eight ids to a byte: both in place."""
        b, row = divmod(i, self.unit // self.length)
        return tuple(self.flat(b, c)[row * n : (row + 1) * n] for c, n in (("ids", self.length), ("mask", self.length // 8)))


def open_shard(store: Store, name: str) -> Shard:
    from pyarrow import fs

    system, top = store.fs()
    path = f"{top}/{name}.arrow"
    return Shard(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))


def encode_to_files(docs: DataFrame, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, batch: int = BATCH) -> tuple[Store, list[dict]]:
    """Writes the shards; returns where they are and, in order, each shard's name, base, n_tokens and n_docs (one entry per partition, never per document)."""
    spark = docs.sparkSession
    store = Store(spark, "tokens")
    rows = picked(docs, key, text)
    kind = rows.schema["k"].dataType.simpleString()
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = json_encoder(vocabulary, KNOWN), np.array([end_id], "<u4").tobytes()
        name = f"{TaskContext.get().partitionId():08d}"
        keys, lengths = [], []
        with store.writer(f"{name}.arrow") as sink:
            out = ShardWriter(sink, max(encoder.lib.get_vocab_size(), end_id + 1), length, batch)
            for b in batches:
                keys.append(b.column(0))
                for t in b.column(1):
                    ids = np.frombuffer(encoder.encode(t.as_py()) + end, "<u4")
                    lengths.append(len(ids))
                    out.add(ids)
            total = out.close()
        if keys:
            n = np.array(lengths, "<i8")
            index = pa.table({"key": pa.chunked_array(keys), "start": np.cumsum(n) - n, "n_tokens": n})
            with store.writer(f"{name}.index") as sink, pa.ipc.new_stream(sink, index.schema) as to:
                to.write_table(index)
        yield pa.RecordBatch.from_pydict({"shard": [name], "n_tokens": [total], "n_docs": [len(lengths)]})

    shards = sorted(ordered.mapInArrow(run, "shard string, n_tokens long, n_docs long").collect())
    found, base = [], 0
    for s in shards:
        if s.n_docs:
            found.append({"shard": s.shard, "base": base, "n_tokens": s.n_tokens, "n_docs": s.n_docs, "kind": kind})
        base += s.n_tokens
    return store, found


def read_documents(docs: DataFrame, store: Store, shards: list[dict], key: str = "doc_id") -> DataFrame:
    """The documents as the files have them: `key`, start, n_tokens, ids (binary: little-endian unsigned 32-bit ids)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    plan = spark.createDataFrame(spark.sparkContext.parallelize([(s["shard"], s["base"]) for s in shards], max(1, len(shards))), "shard string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = open_shard(store, name)
                index = pa.ipc.open_stream(store.get(f"{name}.index")).read_all().combine_chunks()
                for i in range(0, index.num_rows, 1000):
                    part = index.slice(i, 1000)
                    starts, sizes = (part.column(c).to_numpy() for c in ("start", "n_tokens"))
                    ids = [shard.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks() if part.num_rows else pa.array([], part.schema.field("key").type), pa.array(starts + base), pa.array(sizes), pa.array(ids, pa.binary())], names=["k", "start", "n_tokens", "ids"])

    return plan.mapInArrow(run, f"k {kind}, start long, n_tokens long, ids binary").withColumnRenamed("k", key)
