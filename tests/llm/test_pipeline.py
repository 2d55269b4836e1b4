import random

import numpy as np

import corpus_pipeline
from quire.llm import bands, graph, shingles


def test_stages_keep_columns_and_clean_documents(spark, docs, tmp_path):
    top = str(tmp_path)
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    now, counts = spark.read.parquet(f"{top}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, top).write.parquet(f"{top}/{name}")
        now = spark.read.parquet(f"{top}/{name}")
        counts.append(now.count())
        if name != "best_fit_packing":
            assert now.columns == [*corpus_pipeline.COLUMNS]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 30
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, top).collect()}
    assert 0 in kept and 10 not in kept and {3, 4, 5, 6, 7} <= kept
    assert corpus_pipeline.run(spark, top).count() == counts[-1]


def test_edited_copies_go(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], set()
    for i in range(80):
        base = rng.choices(vocabulary, k=rng.randint(100, 400))
        rows.append((2 * i, " ".join(base)))
        goal, now, best = 0.7 + 0.25 * i / 80, [*base], 1.0
        while best > goal:
            now[rng.randrange(len(now))] = rng.choice(vocabulary)
            a, b = shingles(base), shingles(now)
            best = len(a & b) / len(a | b)
        rows.append((2 * i + 1, " ".join(now)))
        want |= {2 * i + 1} if best >= 0.8 else set()
    # a family around one document: each member is a copy of it
    base = rng.choices(vocabulary, k=300)
    rows += [(1000 + i, " ".join([*base[: 2 * i], "x", *base[2 * i + 1 :]])) for i in range(100)]
    want |= {*range(1001, 1100)}
    docs = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()}
    assert {k for k, _ in rows} - kept == want and 40 < len([k for k in want if k < 1000]) < 60


def test_near_fingerprints_are_candidates_of_their_own(spark, docs, monkeypatch):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    fps = base + [x ^ sum(1 << int(b) for b in rng.choice(62, i % 7, replace=False)) for i, x in enumerate(base)]
    sets = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    got = dict(tuple(r) for r in graph.components(shingles.near_fingerprints(sets)).collect())
    assert got == {i + j: i for i, x in enumerate(base) if (x ^ fps[i + 30]).bit_count() <= 4 for j in (0, 30)}
    # no value in common: the fingerprints alone make them candidates, up to what is verified
    keyed = spark.createDataFrame([(16 << 32, i) for i in range(60)], "key long, id long")
    lines = sets.selectExpr("id", "cast(fp as string) as line")
    sketch = lambda x: (np.array([int(v) for v in x], np.int64), np.arange(2 * len(x), dtype=np.uint32).reshape(-1, 2))
    for same, want in ((lambda x, y: True, got), (lambda x, y: False, {})):
        assert {tuple(r) for r in bands.clusters(keyed, 16, lambda near: lines.join(near, "id"), sketch, str, same, 24, None, 4).collect()} == {*want.items()}
    asked, made = [], shingles.near_fingerprints
    monkeypatch.setattr(shingles, "near_fingerprints", lambda *a: asked.append(a[1]) or made(*a))
    corpus_pipeline.near_duplicate(spark, docs, "")
    assert asked == [4]
