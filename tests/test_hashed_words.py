import hashlib

from quire.functions import vectors as V
from quire.operators import search


def test_hashed_words_in_any_script_and_beyond_what_is_remembered(monkeypatch):
    monkeypatch.setattr(V, "REMEMBERED", 20)
    texts = ["", " ", "ab", "日本語の文字列 テスト", "İi ß ſ x\x1cy", "".join(map(chr, range(0x400, 0x500))), "x" * 50, *(f"word{i} {i}word the the" for i in range(60))]

    def plain(text):
        term, total = lambda x: int.from_bytes(hashlib.md5(x.encode()).digest()) % V.DIM, [0] * V.DIM
        for w in text.lower().split():
            total[term(w)] += 2
            for j in range(len(w) - 2):
                total[term(w[j : j + 3])] += 1
        return total

    assert V._hashed(V.DIM)(texts).tolist() == [*map(plain, texts)]  # rows of many texts at once


def test_a_search_hashes_chunks_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(search, "settled", lambda df, real=search.settled: made.append(df.columns) or real(df))
    chunks = spark.createDataFrame([(i, f"the nation {i}") for i in range(30)], "doc_id long, text string")
    assert search.hybrid(chunks, "the nation", 5).count() == 5
    assert ["doc_id", "bp"] in made[:2]
