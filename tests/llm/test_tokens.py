import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quire.llm import arrowfile, bpe, packing
from quire.llm.tokens import JsonEncoder, Memory, RankEncoder

RANKS = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_json_encoder_is_the_library(path):
    e, rng = JsonEncoder(path), random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", " \n", "\n ", "'s", ".", ",", "12", "\t", "\xa0", "日本", "é", "İ", "ΑΣ", "ß", "!!", "<|endoftext|>", "\r\n", "x"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.lib.encode(t, add_special_tokens=False).ids, t


def test_rank_encoder_is_the_library():
    e, rng = RankEncoder(*RANKS), random.Random(4)
    parts = ["a", "B", "é", " ", "  ", "\n", " \n", "\n ", "'ll", ".", "12", "\t", "\xa0", "日本", "🙂", "\x85", "\x1c"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.lib.encode_ordinary(t), t


def test_stitching_finds_the_same_pre_tokens():
    e, rng = RankEncoder(*RANKS), random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["ab", "abcdefghij" * 4, " ", "   ", "\n", "1", "!", "é"]) for _ in range(80))
        chunk, overlap = 40, 12
        chunks = [(i, t[i : i + chunk + overlap], *bpe.cut_points(e, t[i : i + chunk + overlap], i, chunk, overlap)) for i in range(0, len(t), chunk)]
        pieces = bpe.stitch(e, chunks, chunk, overlap)
        assert "".join(pieces) == t
        assert [m for p in pieces for m in e.pattern.findall(p)] == e.pattern.findall(t)


def test_encode_and_decode(docs, texts, none):
    e = RankEncoder(*RANKS)
    coded = bpe.encode(docs, *RANKS, chunk=500, overlap=60)
    got = bpe.decode(coded, *RANKS).collect()
    want = sorted((repr(k), np.array(e.lib.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in texts)
    assert sorted((repr(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(none, *RANKS).count() == 0


def test_token_files(spark, docs, texts, none):
    e = JsonEncoder(BYTES)
    store, shards = arrowfile.encode_to_files(docs, BYTES, length=64, batch=4)
    got = arrowfile.read_documents(docs, store, shards).collect()
    start = 0
    by = {r.doc_id: r for r in got}
    for k, t in sorted(texts, key=lambda x: -1 if x[0] is None else x[0]):
        ids = e.lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (by[k].start, by[k].n_tokens, np.frombuffer(by[k].ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    shard = arrowfile.open_shard(store, shards[0]["shard"])
    ids, mask = shard.sequence(0)
    assert len(ids) == 64 and ids.dtype == np.uint16 and len(mask) == 8 and (mask == 255).all()
    assert shard.flat(0).base is not None and shard.flat(0, "mask").base is not None  # views of the mapped file
    assert np.shares_memory(ids, shard.flat(0)) and np.shares_memory(mask, shard.flat(0, "mask"))
    assert sum(int(np.bitwise_count(shard.flat(i, "mask")).sum()) for i in range(len(shard.batches))) == shards[0]["n_tokens"]
    assert arrowfile.read_documents(none, *arrowfile.encode_to_files(none, BYTES)).count() == 0


def test_packing(docs, texts, none):
    e = JsonEncoder(WORDS)
    got = packing.pack(docs, WORDS, capacity=128).collect()
    want, total = [], 0
    for k, t in texts:
        ids = e.lib.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        want += [(repr(k), i, s, len(ids[s : s + 128]), zlib.crc32(np.array(ids[s : s + 128], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 128))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 128
    assert len(held) <= -(-total // 128) * 1.05 + 1 and len(held) == brute_best_fit([r.length for r in got], 128)
    assert packing.pack(none, WORDS).count() == 0


def brute_best_fit(sizes, capacity):
    """The number of sequences of best fit, size by size from the largest."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - size)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_uses_as_few_sequences_as_document_by_document(seed):
    rng = random.Random(seed)
    capacity = rng.choice((50, 100, 128))
    sizes = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, capacity // 4) for _ in range(600)]
    assert packing.best_fit(dict(Counter(sizes)), capacity)[1] == brute_best_fit(sizes, capacity)


def test_long_pieces_are_not_remembered():
    made = []
    memory = Memory(lambda x: made.append(x) or x, 10)
    for x in ("a", "a", "b" * 100, "b" * 100):
        assert memory[x] == x
    assert made == ["a", "b" * 100, "b" * 100] and [*memory] == ["a"]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_places_each_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    placed, made = packing.best_fit(counts, 100)
    room, done = {}, {}
    for size, lo, hi, first, offset in placed:
        for i in range(lo, hi):
            done.setdefault(size, set()).add(i)
            room.setdefault(first + i - lo, []).append((offset, size))
    assert {s: len(r) for s, r in done.items()} == counts and len(room) == made
    for places in room.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= 100
