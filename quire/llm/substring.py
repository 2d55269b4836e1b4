"""Substring dedup by level-wise doubling: windows of words that repeat at one length are extended to twice that length.

A level starts from the windows that survived the one before (at first all of `window` / 2^k words): a window of twice the
length survives if both of its halves did. Its hash is that of the two halves; whether it occurs again is found out by
sending each hash to the task that owns its range. Texts aren't sent: a chunk (some megabytes of whole documents of a
partition) sends each distinct hash once, packed, and gets back one bit for each, which it keeps in a file of the shared
folder and applies when the next level reads the texts again. So a window that a third of all rows hold costs its owner one
entry a chunk. The last level compares 96 bits and keeps, of each window, the occurrence with the smallest (key, start); the
words that any other occurrence covers are removed. Windows are judged on the input, not on what is left.

There are so many owners that each has some megabytes of hashes, however large the input is. A window that all chunks hold is
one entry for each of them. The input is read once per level, in the same order: Parquet files are, anything else is written to the
shared folder first. A chunk is known by what it holds and by where its rows are (file and row number), so that repeated rows and
files of the same content have chunks of their own.
Null, empty and short texts have no window and stay as they are. Rows with equal keys count as one document's: of two
occurrences with equal (key, start), as repeated rows have, neither is the earlier one. Rows with a null key come before all others.
Only `key` (whole numbers), `text` and the columns `keep` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm._shared import Store, distinct_names, placed, rest_of
from quire.llm.tokens import Memory, tidy

WINDOW, LEVELS = 20, 2
#: Bytes of text in a chunk; bytes of a hash that the levels before the last send (a chance match only costs the next level an entry).
CHUNK, SENT = 4 << 20, 6
#: Bytes of the input, as Spark estimates them, for each owner of hashes.
OWNED = 8 << 20
_SPACED = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _new_memory() -> Memory:
    import xxhash

    return Memory(xxhash.xxh64_intdigest, 200_000)


_words = None


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, and the number of words of each text."""
    global _words
    if _words is None:
        _words = _new_memory()
    words = [t.encode().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def paired(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of two hashes, in order."""
    one, two, three = np.roll(_MULTIPLY, lane)
    x = a * one + (b ^ (b >> np.uint64(31))) * two
    x ^= x >> np.uint64(32)
    x *= three
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of the window of `length` words that starts at each place; windows that run past the end are left out."""
    if length == 1:
        return words
    half = length // 2
    short = window_hashes(words, half)
    n = max(0, len(words) - length + 1)
    rest = short[half : half + n] if length % 2 == 0 else paired(short[half : half + n], words[length - 1 :])
    return paired(short[:n], rest)


class Chunk:
    """Whole documents of a partition, by key, and their windows level by level."""

    def __init__(self, keys: pa.Array, texts: list[str], spots: list[int], rest: list, window: int, levels: int):
        import xxhash

        number = np.array([np.iinfo(np.int64).min if k is None else k for k in keys.to_pylist()], np.int64)
        self.order = np.argsort(number, kind="stable")
        self.keys, self.texts, self.rest = keys, texts, rest
        sign = xxhash.xxh64(np.array(spots, "<i8").tobytes() + number.tobytes())
        for t in texts:
            sign.update(xxhash.xxh64_digest(t.encode()))
        self.name = f"{sign.intdigest():016x}"
        self.words, counts = word_hashes([texts[i] for i in self.order])
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.doc = np.repeat(number[self.order], counts)
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, counts)
        self.left = np.repeat(self.ends, counts) - np.arange(len(self.words))
        self.length = window >> levels - 1
        self.hash = window_hashes(self.words, self.length)
        self.at = np.flatnonzero(self.left[: len(self.hash)] >= self.length)
        self.hash = self.hash[self.at]

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of this level, shortened, and which occur twice or more here."""
        values = np.sort(self.hash >> np.uint64(64 - 8 * SENT))
        first = np.r_[True, values[1:] != values[:-1]][: len(values)]
        at = np.flatnonzero(first)
        return values[at], np.diff(np.r_[at, len(values)]) > 1

    def extend(self, repeated: np.ndarray) -> None:
        """To windows of twice the length, of which both halves are among the repeated hashes."""
        short = self.hash >> np.uint64(64 - 8 * SENT)
        found = np.searchsorted(repeated, short)
        hit = np.zeros(len(short), bool) if not len(repeated) else repeated[np.minimum(found, len(repeated) - 1)] == short
        at, hashes = self.at[hit], self.hash[hit]
        held = np.zeros(len(self.words) + self.length, bool)
        held[at] = True
        whole = np.zeros(len(self.words) + self.length, np.uint64)
        whole[at] = hashes
        keep = held[at + self.length] & (self.left[at] >= 2 * self.length)
        self.at, a = at[keep], hashes[keep]
        b = whole[self.at + self.length]
        self.hash, self.more = paired(a, b), paired(a, b, 1) >> np.uint64(32)
        self.length *= 2

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The surviving windows in the order of their hashes, each group's first one (smallest key and start) first; where groups start."""
        order = np.lexsort((self.more, self.hash))
        h, m = self.hash[order], self.more[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])][: len(h)]
        return order, np.flatnonzero(first)

    def removed(self, later: np.ndarray) -> np.ndarray:
        """Which words are covered by a window that also starts earlier. later: of each group, whether another chunk has an earlier occurrence."""
        order, starts = self.groups()
        sizes = np.diff(np.r_[starts, len(order)])
        first = np.repeat(order[starts], sizes)
        at = self.at
        own = (self.doc[at[order]] != self.doc[at[first]]) | (self.place[at[order]] != self.place[at[first]])
        gone = at[order[own | np.repeat(later, sizes)]]
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + self.length, -1)
        return np.cumsum(change)[:-1] > 0


def chunks_of(batches: Iterator[pa.RecordBatch], window: int, levels: int) -> Iterator[Chunk]:
    global _words
    _words = None  # a worker doesn't carry the words of one task to the next
    keys, texts, spots, rest, size = [], [], [], [], 0
    for b in batches:
        for i, (k, t, spot) in enumerate(zip(*b.columns[:3], strict=True)):
            keys.append(k.as_py())
            texts.append(t.as_py())
            spots.append(spot.as_py())
            size += len(texts[-1])
            if b.num_columns > 3:
                rest.append(b.column(3)[i].as_py())
            if size >= CHUNK:
                yield Chunk(pa.array(keys, pa.int64()), texts, spots, rest, window, levels)
                keys, texts, spots, rest, size = [], [], [], [], 0
    if texts:
        yield Chunk(pa.array(keys, pa.int64()), texts, spots, rest, window, levels)
    _words = None


def bits(store: Store, name: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, bool)
    data = store.get(name)
    if data is None or len(data) != -(-n // 8):
        raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes: those of small numbers are mostly zeros, which shuffles compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _short(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(b, np.uint8).reshape(-1, SENT)
    return out.reshape(-1).view("<u8")


def _level(chunk: Chunk, store: Store, levels: int) -> None:
    """Applies the answers of all levels before `levels`."""
    for level in range(levels):
        values, _ = chunk.sent()
        chunk.extend(values[bits(store, f"{chunk.name}.{level}", len(values))])


def owner_of(values: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Who owns a hash: ranges of its upper 32 bits, so that sorted hashes stay together."""
    return ((values >> np.uint64(bits - 32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def spans(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    for a, b in zip(at, np.r_[at[1:], len(owner)][: len(at)], strict=True):
        yield int(owner[a]), slice(a, b)


def answered(asked: DataFrame, answer, store: Store, suffix: str) -> None:
    """Each owner answers what chunks ask; a chunk's answers are put into its file."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("owner")
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(pdf["bits"], pdf["n"], strict=True)])
        store.put(f"{pdf['chunk'].iloc[0]}.{suffix}", np.packbits(bits).tobytes())
        return pd.DataFrame({"n": [len(bits)]})

    told = asked.groupBy("owner").applyInPandas(answer, "owner long, chunk string, n long, bits binary")
    told.groupBy("chunk").applyInPandas(keep, "n long").agg(F.sum("n")).collect()


def _told(pdf: pd.DataFrame, bits: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"owner": pdf["owner"], "chunk": pdf["chunk"], "n": [len(b) for b in bits], "bits": [np.packbits(b).tobytes() for b in bits]})


def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which hashes another chunk has too, or the same chunk twice."""
    values = [_short(b) for b in pdf["hashes"]]
    twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)).astype(bool) for b, v in zip(pdf["twice"], values, strict=True)]
    all_values = np.sort(np.concatenate(values))
    common = np.unique(all_values[1:][all_values[1:] == all_values[:-1]])
    found = []
    for v, t in zip(values, twice, strict=True):
        at = np.minimum(np.searchsorted(common, v), max(len(common) - 1, 0))
        found.append(t | (common[at] == v if len(common) else False))
    return _told(pdf, found)


def _later(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each window that a chunk asks for, whether another chunk has it at a smaller (key, start)."""
    columns = [[_unplanes(b, kind) for b in pdf[c]] for c, kind in (("hashes", "<u8"), ("more", "<u4"), ("docs", "<i8"), ("places", "<u4"))]
    sizes = [len(x) for x in columns[0]]
    h, m, doc, place = map(np.concatenate, columns)
    order = np.lexsort((place, doc, m, h))
    h, m = h[order], m[order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
    first = np.repeat(order[starts], np.diff(np.r_[starts, len(order)]))
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[first]) | (place[order] != place[first])
    return _told(pdf, np.split(later, np.cumsum(sizes)[:-1]))


def without_repeats(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS, key: str = "doc_id", text: str = "text", spacing: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """`key`, n_words, n_removed, `text` (and the columns `keep`, which may not have one of these names): of each row, without the words that are covered by a repeated window's later occurrences.
    spacing: what joins the kept words; None keeps each word's own white space before it, and untouched texts as they are."""
    assert levels >= 1 and window % (1 << levels - 1) == 0
    distinct_names(key, text, "n_words", "n_removed", *(c for c in keep if c not in (key, text)))
    rows, kind = placed(docs, key, text, rest_of(keep, key, text)), docs.schema[key].dataType.simpleString()
    store = Store(docs.sparkSession, "repeats")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known
        size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // OWNED)

    def ask(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks_of(batches, window, levels):
                _level(chunk, store, level)
                values, twice = chunk.sent()
                asked = [(o, chunk.name, values[s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes(), np.packbits(twice[s]).tobytes()) for o, s in spans(owner_of(values, 8 * SENT, owners))]
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*asked, strict=True)], names=["owner", "chunk", "hashes", "twice"])

        return run

    def ask_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches, window, levels):
            _level(chunk, store, levels - 1)
            order, starts = chunk.groups()
            first = order[starts]
            h, m, doc, place = chunk.hash[first], chunk.more[first].astype("<u4"), chunk.doc[chunk.at[first]], chunk.place[chunk.at[first]].astype("<u4")
            asked = [(o, chunk.name, *(_planes(x[s]) for x in (h, m, doc, place))) for o, s in spans(owner_of(h, 64, owners))]
            if asked:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*asked, strict=True)], names=["owner", "chunk", "hashes", "more", "docs", "places"])

    read = rows.select("k", "t", "spot")
    for level in range(levels - 1):
        answered(read.mapInArrow(tidy(ask(level)), "owner long, chunk string, hashes binary, twice binary"), repeated, store, str(level))
    if levels == 1:
        raise ValueError("the last level follows one that it can double")
    answered(read.mapInArrow(tidy(ask_last), "owner long, chunk string, hashes binary, more binary, docs binary, places binary"), _later, store, "last")

    pa_rest = to_arrow_type(rows.schema["rest"].dataType)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches, window, levels):
            _level(chunk, store, levels - 1)
            _, starts = chunk.groups()
            gone = chunk.removed(bits(store, f"{chunk.name}.last", len(starts)))
            total = np.r_[0, np.cumsum(gone)]
            n_words, n_removed = chunk.ends - chunk.starts, total[chunk.ends] - total[chunk.starts]
            texts = [cleaned(chunk.texts[i], gone[a:b] if r else None, spacing) for i, a, b, r in zip(chunk.order, chunk.starts, chunk.ends, n_removed, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.keys.take(pa.array(chunk.order)), pa.array(n_words), pa.array(n_removed), pa.array(texts, pa.string()), pa.array([chunk.rest[i] for i in chunk.order], pa_rest)], names=["k", "n_words", "n_removed", "t", "rest"])

    out = rows.mapInArrow(tidy(kept), f"k long, n_words long, n_removed long, t string, rest {rows.schema['rest'].dataType.simpleString()}")
    return out.select(F.col("k").cast(kind).alias(key), "n_words", "n_removed", F.col("t").alias(text), *(F.col(f"rest.{c}") for c in keep if c not in (key, text)))


def cleaned(text: str, gone: np.ndarray | None, spacing: str | None) -> str:
    """A text without the words marked in `gone`."""
    if gone is None:
        return text if spacing is None else spacing.join(w.decode() for w in text.encode().split())
    if spacing is None:
        return b"".join(w for w, g in zip(_SPACED.findall(text.encode()), gone, strict=True) if not g).lstrip().decode()
    return spacing.join(w.decode() for w, g in zip(text.encode().split(), gone, strict=True) if not g)
