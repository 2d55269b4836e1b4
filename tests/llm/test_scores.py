import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import classifier, hosts, licenses, topk
from tests.llm.conftest import WORDS


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(200, 8)), np.repeat(rng.normal(size=(1, 8)), 30, 0)].astype("float32")
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(500, None, ""), (550, [1.0, None] * 4, ""), (600, [float("nan")] * 8, ""), (650, [float("inf")] * 8, "")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(v, F.col("vec_id") % 50 == 0, pivots=5).collect()}
    e, want = np.floor(256 * x.astype(float)), {}
    for q in range(0, 230, 50):
        s = (e @ e[q]).astype(int)
        order = [i for i in np.lexsort((np.arange(230), -s)) if i != q][:5]
        want |= {(q, n + 1): (int(i), int(s[i])) for n, i in enumerate(order)}
    assert got == want
    assert topk.search(v.filter("vec_id > 499"), F.lit(True)).count() == 0
    assert topk.search(v.filter("vec_id in (0, 1)"), F.lit(True)).count() == 2


def test_topk_of_widely_differing_norms(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(10_000, 4)) * 10 ** rng.uniform(-1, 0, (10_000, 1))
    x[7_000:] = [50, 0, 0, 0] + 0.1 * rng.normal(size=(3_000, 4))  # short queries' best are far from them on the sphere
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(v, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    e = np.floor(256 * x)
    for q in range(0, 10_000, 50):
        s = (e @ e[q]).astype(int)
        order = [i for i in np.lexsort((np.arange(len(s)), -s))[:6] if i != q][:5]
        assert got[q] == {n + 1: (int(i), int(s[i])) for n, i in enumerate(order)}


def test_topk_of_large_components(spark):
    # products beyond 2^53 stay exact, ties and signs included
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) * 1e6, [[1e7, 0.5, 0.0], [1e7, 0.5, 0.0], [0.5, 0.0, 0.0], [1e7, 0.25, 0.0]]]
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    e = [[int(c) for c in np.floor(256 * r)] for r in x]
    got = {}
    for r in topk.search(v, F.col("vec_id") % 2 == 0, pivots=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, len(x), 2):
        want = sorted(((-sum(a * b for a, b in zip(e[q], e[i])), i) for i in range(len(x)) if i != q))[:5]
        assert got[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(want)}
    assert got[82][1] == (80, 256 * 10**7 * 128)


def test_annuli_stop_early():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2)) * 1000
    top = float((x**2).sum(1).max())
    p = np.zeros((1, 3))
    far = topk.distances(topk.lifted(x, top), p)[:, 0]
    order = np.argsort(far)
    got, ids = topk.expanded(x[:3], np.arange(3), np.full(3, -np.inf), far[:3], far[order], order, x[order], 5, top, 1e-3)
    for q in range(3):
        s = x @ x[q]
        s[q] = -np.inf
        assert np.allclose(np.sort(s)[::-1][:5], got[q])


def test_host_rules(docs, texts, none):
    got = {r.doc_id: r for r in hosts.judged(docs).collect()}
    for k, t in texts:
        t = t or ""
        w = WORDS.findall(t)
        c, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        own = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(own) - len(set(own)), len(covered))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert hosts.judged(none).count() == 0


def test_repeated_words_of_colliding_places(docs, monkeypatch):
    from quire.llm._shared import words_of

    rows = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    want = sorted(tuple(r) for r in rows.select(F.coalesce("doc_id", F.lit(-1)), hosts.n_repeat_words(F.col("w"))).collect())
    monkeypatch.setattr(hosts, "PLACES", 3)
    assert sorted(tuple(r) for r in rows.select(F.coalesce("doc_id", F.lit(-1)), hosts.n_repeat_words(F.col("w"))).collect()) == want


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(100)] + [(2000, bad, "tiny"), (2001, good, "tiny"), (3000, good, None)] + [(4000 + i, good, f"h{i}") for i in range(30)]
    got = {r.doc_id: r for r in hosts.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and not got[1000].kept and got[1000].host_failed and not got[1000].base_failed
    assert got[2001].kept and not got[2000].kept and got[3000].kept


def test_classifier_generalises(spark, none):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    make = [lambda w: " ".join(w), lambda w: " | ".join(w), lambda w: " ".join(x.upper() + "!!" for x in w), lambda w: " ".join(x + "***" for x in w)]
    rows = [(i, make[0 if i % 4 else rng.randint(1, 3)](rng.choices(words, k=rng.randint(20, 200))), int(i % 4 > 0)) for i in range(600)] + [(700, None, None), (701, "", 1)]
    d = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in classifier.scored(d, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    held = [(q, got[k].predicted) for k, t, q in rows if t and got[k].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert classifier.scored(none, labels).count() == 0
    assert {r.score for r in classifier.scored(d, labels.filter("doc_id < 0")).collect()} == {0.5}


def test_licenses(spark, none):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i, filler(40) + "\n" + t + "\n" + filler(30)) for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(50, licenses.TEMPLATES["mit-text"].replace("free of charge", "gratis")), (51, filler(200)), (52, "Licensed under the Apache"), (53, None), (54, ""), (55, licenses.TEMPLATES["mit"].upper())]
    got = {(r.doc_id, r.license): (r.n_found, r.n_shingles) for r in licenses.matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {}
    for k, t in rows:
        for name, template in licenses.TEMPLATES.items():
            n, all_ = len(shingles(t or "") & shingles(template)), len(shingles(template))
            if n >= 0.8 * all_:
                want[k, name] = (n, all_)
    assert got == want and (50, "mit-text") in got and (55, "mit") in got
    assert licenses.matches(none).count() == 0
