import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import _shared, bands, graph, lines, simhash, substring, tokens
from tests.llm.conftest import WORDS


def brute_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = WORDS.findall(t)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, near):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min(label[j] for j in range(n) if near(i, j))
            if least < label[i]:
                label[i], changed = least, True
    return label


def test_simhash_components(docs, texts, none):
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = sorted((k, t) for k, t in texts if k is not None)
    fp = [brute_fingerprint(t) for _, t in rows]
    assert [got[k][0] for k, _ in rows] == fp
    label = roots(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    assert [got[k][1] for k, _ in rows] == [rows[i][0] for i in label]
    assert simhash.near_duplicates(none).count() == 0


def test_large_runs_are_tiled_without_losing_links(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63)
    fps = {int(centre) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 63, 50)}
    fps = sorted(fps)
    reps = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    for radius, parts in ((4, [(list(range(i, 64, 5)), 0) for i in range(5)]), (4, [(list(range(0, 32)), 1), (list(range(32, 64)), 2)])):
        links = simhash.linked(simhash.dealt(simhash.keyed(reps, parts), 64), radius)
        got = dict(tuple(r) for r in graph.components(links).collect())
        label = roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
        assert [got.get(i, i) for i in range(len(fps))] == label


def test_thresholds_follow_the_pigeonhole_principle():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (5000, 64)).astype(float)
    both = bits.T @ bits
    for n in (10**3, 10**6, 10**9):
        parts = simhash.allocate(n, both * (n / 5000), 4)
        used = sorted(b for g, _ in parts for b in g)
        assert len(used) == len(set(used)) and sum(t + 1 for _, t in parts) == 4 + 1


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (50, 51), (51, 50), (60, 60)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 50: 50, 51: 50}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window):
    seen, out = set(), {}
    for k, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            if s in seen:
                gone[i : i + window] = [True] * window
            seen.add(s)
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings(docs, texts, none, monkeypatch):
    rows = sorted(texts, key=lambda x: -1 if x[0] is None else x[0])
    for window, levels in ((20, 2), (8, 3)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.without_repeats(docs, window, levels, spacing=" ").collect()}
        assert got == brute_repeats(rows, window)
    assert sum(x[1] for x in got.values()) > 500
    kept = {r.doc_id: r for r in substring.without_repeats(docs, keep=("lang", "n_chars")).collect()}
    assert kept[3].text == dict(texts)[3] and kept[3].lang == "en" and kept[900].text == ""
    # what isn't a table in files is written first
    again = substring.without_repeats(docs.repartition(2, "lang"), spacing=" ")
    assert {r.doc_id: r.n_removed for r in again.collect()} == {k: v[1] for k, v in brute_repeats(rows, 20).items()}
    assert substring.without_repeats(none).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_lines(docs, texts, none):
    assert {r.doc_id: r.text for r in lines.without_fuzzy_lines(docs).collect()} == lines_left(texts)
    assert lines.without_fuzzy_lines(none).count() == 0


def test_numbers_of_lines_are_those_of_the_texts():
    text = "One two, three four FIVE\n\nshort line\n_six_ seven-eight nine  ten\u00df eleven\nONE two three (four) five"
    number, ids, fp, values = lines.listed(text, 5)
    assert number.tolist() == [0, 3, 4] and ids[0] == ids[2] != ids[1] and fp[0] == fp[2]
    assert [lines.normal_lines(text)[i] for i in number] == ["one two three four five", "six seven eight nine ten\u00df eleven", "one two three four five"]
    assert len(lines.listed("", 5)[0]) == 0 and lines.listed("word", 1)[0].tolist() == [0]


def test_repeated_rows_and_files_do_not_hide_lines(spark, docs, texts, tmp_path):
    # the same rows in two files, in one, and as a union: of each line one occurrence stays
    want = sorted(x for t in lines_left([(k, t) for k, t in texts if k is not None]).values() for x in t.split("\n"))
    rows = spark.createDataFrame([(k, t) for k, t in texts if k is not None], "doc_id long, text string").coalesce(1)
    for i in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "two"))
    for table in (spark.read.parquet(str(tmp_path / "two")), spark.read.parquet(str(tmp_path / "two")).coalesce(1), rows.union(rows)):
        got = [x for r in lines.without_fuzzy_lines(table).collect() for x in r.text.split("\n")]
        taken = lambda x: len(lines.normal_lines(x)[0].split()) >= 5
        assert sorted(x for x in got if taken(x)) == [x for x in want if taken(x)]
    kept = substring.without_repeats(spark.read.parquet(str(tmp_path / "two")), spacing=" ")
    brute = brute_repeats(sorted((k, t) for k, t in texts if k is not None), 20)
    n = {}
    for r in kept.collect():
        n.setdefault(r.doc_id, []).append(r.n_removed)
    # of two equal (key, start) neither is the earlier one
    assert n == {k: [v[1]] * 2 for k, v in brute.items()}


def test_kept_columns_may_not_have_names_of_made_ones(docs):
    for call in (lines.without_fuzzy_lines, substring.without_repeats):
        with pytest.raises(ValueError):
            call(docs.withColumn("n_removed", docs.doc_id), keep=("n_removed",))


def lines_left(rows, similarity=0.8):
    """What stays of the rows' texts, by edit similarity over all pairs of lines."""
    first, seen = {}, []
    order = lambda k: -1 if k is None else k
    for k, t in sorted(rows, key=lambda x: order(x[0])):
        for n, x in enumerate(lines.normal_lines(t or "")):
            if len(x.split()) >= 5:
                first.setdefault(x, (order(k), n))
                seen.append((order(k), n, x))
    known = [*first]
    links = {(i, j) for i in range(len(known)) for j in range(i) if 5 * abs(len(known[i]) - len(known[j])) <= max(len(known[i]), len(known[j])) and 5 * lines.distance(known[i], known[j]) <= max(len(known[i]), len(known[j]))}
    label = roots(len(known), lambda i, j: i == j or (max(i, j), min(i, j)) in links)
    least = {}
    for x, i in zip(known, label):
        least[i] = min(least.get(i, first[x]), first[x])
    keeps = {x: least[i] for x, i in zip(known, label)}
    gone = {(k, n) for k, n, x in seen if keeps[x] != (k, n)}
    return {k: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (order(k), n) not in gone) for k, t in rows}


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 90))) for _ in "ab")
        assert lines.distance(a, b) == edit(a, b)


def test_recall_of_fuzzy_lines_at_the_limit(spark):
    # words replaced until another one would leave the limit: the hardest pairs, of which MinHash values may miss some
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]
    rows = []
    for i in range(100):
        w = rng.choices(vocabulary, k=rng.randint(10, 50))
        rows.append((2 * i, " ".join(w)))
        for _ in range(len(w)):
            v = [*w]
            v[rng.randrange(len(w))] = rng.choice(vocabulary)
            if 5 * lines.distance(" ".join(v), rows[2 * i][1]) > max(len(" ".join(v)), len(rows[2 * i][1])):
                break
            w = v
        rows.append((2 * i + 1, " ".join(w)))
    want = {k for k, x in lines_left(rows).items() if not x}
    got = {r.doc_id for r in lines.without_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.text}
    assert len(want) >= 100 and got <= want and len(got) >= 0.9 * len(want)


def families(n=240):
    """Lines of three families that share long words, so that they have common values; only lines of a family are similar."""
    rng = random.Random(6)
    core = "the registered correspondence address remains unchanged throughout"
    endings = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(14)] for _ in range(3)]
    rows = []
    for i in range(n):
        own = [*endings[i % 3]]
        own[rng.randrange(14)] = rng.choice("0123456789") * rng.randint(1, 3)
        rows.append((i, f"{core} {' '.join(own)}"))
    return rows


def test_families_of_lines_in_large_components(spark, monkeypatch):
    rows = families()
    want = lines_left(rows)
    assert sum(1 for x in want.values() if x) == 3
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for group, tile, pilots in ((512, 256, 16), (20, 10, 4), (20, 10, 1)):
        for name, value in (("GROUP", group), ("TILE", tile), ("PILOTS", pilots)):
            monkeypatch.setattr(bands, name, value)
        assert {r.doc_id: r.text for r in lines.without_fuzzy_lines(table).collect()} == want


def test_groups_of_a_task_are_bounded_whatever_a_value_holds(spark, monkeypatch):
    # all items have one value and one fingerprint: none is alike, so that tiles have to meet pair by pair
    for name, value in (("GROUP", 40), ("TILE", 20), ("PILOTS", 2)):
        monkeypatch.setattr(bands, name, value)
    seen = spark.sparkContext.accumulator(0)
    n = 130
    keyed = spark.createDataFrame([(5, i) for i in range(n)], "key long, id long")
    texts = keyed.selectExpr("id", "cast(id as string) as line")
    sketch = lambda lines: (np.zeros(len(lines), np.int64), np.zeros((len(lines), 4), np.uint32))

    def same(x, y):
        seen.add(1)
        return {x, y} == {"3", "77"}

    got = {tuple(r) for r in bands.clusters(keyed, 4, lambda near: texts.join(near, "id"), sketch, str, same).collect()}
    assert got == {(3, 3), (77, 3)}
    assert seen.value >= n * (n - 1) // 2 - 1


def test_many_pairs_are_decided_as_single_ones():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß日", k=rng.randint(1, 9))) for _ in range(500)]
    passage, pairs = rng.choices(vocabulary, k=60), []
    for i in range(500):
        a = rng.choices(vocabulary, k=rng.randint(5, 60 if i % 50 else 400))
        b = [*a]
        for _ in range(rng.randint(0, len(a) // 2)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            b = b or [*a]
        if i % 3 == 0:  # one passage between other words
            a, b = (rng.choices(vocabulary, k=rng.randint(0, 40)) + passage + rng.choices(vocabulary, k=rng.randint(0, 9)) for _ in "ab")
        pairs.append((lines.with_words(" ".join(a)), lines.with_words(" ".join(b))))
    want = [lines.common_words(x[1], y[1]) and lines.distance(x[0], y[0]) <= int(0.2 * max(len(x[0]), len(y[0])) + 1e-9) for x, y in pairs]
    assert lines.all_similar(pairs) == want and 50 < sum(want) < 450


def test_few_rounds_and_jobs_for_components(spark, monkeypatch):
    # links of one task are stars before any round; cut into small pieces they need some
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "a long, b long")
    want, asked, done = {**{i: 0 for i in range(301)}, 500: 500, 501: 500}, [], graph._done

    def counted(edges):
        asked.append(done(edges))
        return asked[-1]

    monkeypatch.setattr(graph, "_done", counted)
    assert dict(tuple(r) for r in graph.components(links).collect()) == want and asked == [True]
    edges = [graph.rooted(part) for part in ([(1, 2), (2, 3)], [(3, 4), (5, 4)], [(7, 7)])]
    assert edges == [[(2, 1), (3, 1)], [(4, 3), (5, 3)], []]
    loose = spark.createDataFrame([(4, 1), (4, 2)], "u long, v long"), spark.createDataFrame([(4, 3), (3, 1)], "u long, v long")
    assert not any(done(x) for x in loose) and done(spark.createDataFrame([(4, 1), (3, 1)], "u long, v long"))


def test_links_of_many_tasks_are_finished_in_one(spark, monkeypatch):
    # a chain in shuffled order over many tasks: no round is left, whatever the tasks hold; beyond FEW there are rounds
    chain = [(i, i + 1) for i in range(600)]
    random.Random(2).shuffle(chain)
    links, asked, done = spark.createDataFrame(chain, "a long, b long").repartition(7), [], graph._done
    monkeypatch.setattr(graph, "_done", lambda edges: asked.append(done(edges)) or asked[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dict(tuple(r) for r in graph.components(links).collect()) == {i: 0 for i in range(601)} and asked == [True]
        monkeypatch.setattr(graph, "FEW", 10)
        assert dict(tuple(r) for r in graph.components(links).collect()) == {i: 0 for i in range(601)} and len(asked) > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_items_with_the_same_values_are_dealt_once(spark, monkeypatch):
    # all items have the same four values: their pairs are compared once, and not sent again for each value
    for name, value in (("GROUP", 40), ("TILE", 20), ("PILOTS", 2)):
        monkeypatch.setattr(bands, name, value)
    n, sent, verified = 130, [], bands.verified
    monkeypatch.setattr(bands, "verified", lambda grouped, *a: sent.append(grouped.count()) or verified(grouped, *a))
    keyed = spark.createDataFrame([((k << 32) + 5, i) for i in range(n) for k in range(4)], "key long, id long")
    texts = keyed.selectExpr("id", "cast(id as string) as line").distinct()
    sketch = lambda lines: (np.zeros(len(lines), np.int64), np.full((len(lines), 4), 5, np.uint32))
    same = lambda x, y: {x, y} in ({"3", "77"}, {"77", "120"})
    got = {tuple(r) for r in bands.clusters(keyed, 4, lambda near: texts.join(near, "id"), sketch, str, same).collect()}
    assert got == {(3, 3), (77, 3), (120, 3)} and sent[2] <= n * 7


def test_values_of_repeated_items_are_kept_once(spark, monkeypatch):
    # copies of an item alone make no value repeated; its place is that of its earliest piece of rows
    monkeypatch.setattr(bands, "PIECE", 3)
    one = [(1, 10, 1), (2, 20, 2), (3, 10, 1), (4, 30, 3), (5, 10, 1), (6, 30, 3), (7, 40, 2), (8, -5, 9)]  # row, id, what its values are made of
    rows = spark.createDataFrame([(row, i, row // 2, row, v * (2**32 + 1), v * (2**32 + 1)) for row, i, v in one], "row long, id long, chunk long, at long, v0 long, v1 long").coalesce(1)
    store = _shared.Store(spark, "test")
    rows = _shared.written(rows, store, "rows")
    got = [tuple(r) for r in bands.repeated_values(rows, 4, store).collect()]
    assert {r[1] for r in got} == {20, 40} and len(got) == len({r[:2] for r in got}) == 8
    assert sorted(r[1:] for r in got if r[2] is not None) == [(20, 1, 2), (40, 3, 7)]


def test_lines_that_share_a_passage_are_told_apart_by_pieces(monkeypatch):
    # half of the words in common: a lower bound from pieces decides, without whole distances; it is never above the distance
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(800)]
    passage = rng.choices(vocabulary, k=50)
    family = [lines.with_words(" ".join(rng.choices(vocabulary, k=30) + passage + rng.choices(vocabulary, k=15))) for _ in range(30)]
    pairs = [(a, b) for i, a in enumerate(family) for b in family[:i]]
    whole = []
    monkeypatch.setattr(lines, "_all_near", lambda left, width: whole.extend(left) or [False] * len(left))
    assert sum(lines.common_words(a[1], b[1]) for a, b in pairs) > 300 and lines.all_similar(pairs) == [False] * len(pairs) and len(whole) < 30
    pieces = [("".join(rng.choices("abc日", k=64)), "".join(rng.choices("abc日", k=rng.randint(1, 150)))) for _ in range(60)]
    for (x, y), least in zip(pieces, lines._least(pieces).tolist()):
        row = [0] * (len(y) + 1)
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        assert least == min(row)


def test_links_as_arrays_become_the_same_stars():
    rng = np.random.default_rng(7)
    for n, m in ((1, 1), (40, 25), (500, 400), (3000, 5000)):
        u, v = rng.integers(-n, n, (2, m))
        assert sorted(zip(*(x.tolist() for x in graph.roots_of(u, v)))) == sorted(graph.rooted(zip(u.tolist(), v.tolist())))


def test_lines_do_not_keep_the_encoders_of_earlier_tasks(monkeypatch):
    tokens.json_encoder.cache_clear()
    monkeypatch.setattr(tokens.JsonEncoder, "__init__", lambda self, path: None)
    tokens.json_encoder("any")
    assert tokens.json_encoder.cache_info().currsize == 1
    assert list(lines._listed(5)(iter(()))) == [] and tokens.json_encoder.cache_info().currsize == 0


def test_lines_of_all_lengths_are_compared_at_once(monkeypatch):
    # in one call, whatever the number of 64-bit words; and as whole distances say, at and beyond the edge of what is looked at
    rng, pairs, calls, near = random.Random(21), [], [], lines._all_near
    for k in range(400):
        a = "".join(rng.choices("abcdefgh ", k=rng.randint(40, 900)))
        at, n = rng.randrange(len(a)), rng.randint(0, len(a) // 4)
        b = a[:at] + a[at + n :] if k % 3 else a[n:] + "".join(rng.choices("abcdefgh ", k=n // 2))
        b = "".join(rng.choice("xyz日") if rng.random() < k % 5 / 25 else c for c in b)
        pairs.append((lines.with_words(a), lines.with_words(b)))
    monkeypatch.setattr(lines, "common_words", lambda x, y: True)
    monkeypatch.setattr(lines, "_all_near", lambda left, width: calls.append(left) or near(left, width))
    want = [lines.distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for (a, _), (b, _) in pairs]
    assert lines.all_similar(pairs) == want and 50 < sum(want) < 350 and len(calls) == 1
    far = lines._far([(*sorted((a, b), key=len, reverse=True), int(0.2 * max(len(a), len(b)) + 1e-9)) for (a, _), (b, _) in pairs])
    assert not any(x and y for x, y in zip(far, want))


def test_items_of_wide_values_are_not_joined_once_for_each_tile(spark, monkeypatch):
    # tiles are files that tasks read pair by pair: each item is sent once, however many tiles there are; links between all tiles are found
    for name, value in (("GROUP", 40), ("TILE", 20), ("PILOTS", 2)):
        monkeypatch.setattr(bands, name, value)
    n, sent, verified = 130, [], bands.verified
    monkeypatch.setattr(bands, "verified", lambda grouped, *a: sent.append(grouped.count()) or verified(grouped, *a))
    keyed = spark.createDataFrame([((k << 32) + 5, i) for i in range(n) for k in range(4)], "key long, id long")
    texts = keyed.selectExpr("id", "cast(id as string) as line").distinct()
    sketch = lambda lines: (np.zeros(len(lines), np.int64), np.full((len(lines), 4), 5, np.uint32))
    same = lambda x, y: abs(int(x) - int(y)) == 13
    got = {tuple(r) for r in bands.clusters(keyed, 4, lambda near: texts.join(near, "id"), sketch, str, same).collect()}
    assert got == {(i, i % 13) for i in range(n)} and sum(sent[2:]) <= n


def test_workers_give_memory_back_before_and_after_a_task(monkeypatch):
    tokens.json_encoder.cache_clear()
    monkeypatch.setattr(tokens.JsonEncoder, "__init__", lambda self, path: None)
    tokens.json_encoder("any")
    trimmed, trim = [], tokens.trim
    monkeypatch.setattr(tokens, "trim", lambda: trimmed.append(trim()))
    seen = [(x, len(trimmed), tokens.json_encoder.cache_info().currsize) for x in tokens.tidy(lambda batches: (2 * x for x in batches))(iter([1, 2]))]
    assert seen == [(2, 1, 0), (4, 1, 0)] and len(trimmed) == 2
