import math
import re

from quire.operators import search


def test_bm25_reads_a_text_once_and_makes_no_row_for_each_token(spark):
    texts = ["The nation of the élan_2", "of reason, of Reason; OF no other", None, "", "nothing here ٣ 三", "the the the"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = search.bm25(docs, "The nation of reason ٣")
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = {i: re.findall(r"\w+", t.lower()) for i, t in enumerate(texts) if t is not None}
    mean, want = sum(map(len, words.values())) / len(words), {}
    for q in ("the", "nation", "of", "reason", "٣"):
        n = sum(q in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(q):
                part = max(math.log((len(texts) - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                want[i] = want.get(i, 0) + part
    got = {r.doc_id: r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
