import json
from datetime import datetime

from pyspark.sql import functions as F

from quire.operators import analytics as A
from quire.operators import dedup, figures, search, state, synth
from quire.operators import questions as Q


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_number_acceptance_depends_on_what_was_accepted(spark):
    lines = spark.createDataFrame([("p", i, n) for i, n in enumerate([3, 2, 5, 40, 6, None, 1, 2])], "g string, s int, n int")
    taken = Q.accepted(lines, "g", "s", "n").first().taken
    assert [(t.seq, t.number) for t in taken] == [(0, 3), (2, 5), (4, 6), (6, 1), (7, 2)]


def page(texts, n=1):
    return (n, 600.0, 800.0, [("text", [0.0, 0.0, 1.0, 1.0], [([x, 10.0 * i, x + 100, 10.0 * i + 8], t) for i, (x, t) in enumerate(texts)])])


def test_segmentation(spark):
    papers = spark.createDataFrame([("a", [page([(50.0, "Sample Paper"), (50.0, "1. What is the sum of two numbers"), (60.0, "that are even"), (560.0, "[2]"), (50.0, "2) Name three kinds of matter"), (50.0, "3.14 is near pi"), (50.0, "Page 1 of 2")])])], Q.PAGES)
    found = sorted(Q.segmented(papers).collect(), key=lambda r: r.question_number)
    assert [(r.question_number, r.raw_text.split("\n")[0]) for r in found] == [(1, "1. What is the sum of two numbers"), (2, "2) Name three kinds of matter")]
    assert "that are even" in found[0].raw_text and found[0].bounding_box[0] == 50.0


def test_options_and_stem(spark):
    t = spark.createDataFrame([("Pick one\n(a) red ; (b) blue\n(3) green (d) black (a) again",), ("no options",)], "t string")
    got = t.select(Q.stem(F.col("t")), Q.options(F.col("t"))).collect()
    assert got[0][0] == "Pick one" and [(o.label, o.text) for o in got[0][1]] == [("A", "red"), ("B", "blue"), ("C", "green"), ("D", "black")]
    assert got[1][0] == "no options" and got[1][1] == []


def test_merged_runs(spark):
    got = spark.createDataFrame([(["x", "+", "a line here", "=", "y", "z"],), ([],)], "l array<string>").select(Q.merged_runs(F.col("l"))).collect()
    assert [r[0] for r in got] == [["x +", "a line here", "= y z"], []]


def test_one_question_is_one_chunk(spark):
    schema = "paper_id string, question_id string, question_number string, section string, subject string, school string, raw_text string, options array<string>, subparts array<string>, images array<string>, is_valid boolean"
    q = spark.createDataFrame([("p", "q1", "1", "MATHS", "science", None, "General Instructions:\nWhat is 2 + 2", ["1", "2", "3", "4"], [], [], None), ("p", "q2", "2", "X", "science", None, "bad", [], [], [], False)], schema)
    (c,) = Q.chunked(q).collect()
    assert (c.chunk_id, c.subject, c.question_type, c.difficulty) == ("p_q1", "mathematics", "mcq", "easy")
    assert c.content.startswith("What is 2 + 2") and "Options:" in c.content


def test_markdown_sections(spark):
    md = spark.createDataFrame([("p", "intro\n# Section A\n## Q1 first [3]\nbody\n## Q2 second\n# Section B\n## 3 third (2 marks)")], "k string, t string")
    assert [tuple(r)[1:5] for r in Q.sections(md, "k", "t").orderBy("question_number").collect()] == [("Section A", 1, 1, 3), ("Section A", 2, 2, 1), ("Section B", 1, 3, 2)]


def test_image_links(spark):
    images = spark.createDataFrame([("p", 1, "i1", 105.0), ("p", 1, "i2", 300.0)], "paper string, page int, image string, c double")
    questions = spark.createDataFrame([("p", 1, 0, 0.0, 100.0), ("p", 1, 1, 100.0, 200.0), ("p", 1, 2, 500.0, 600.0)], "paper string, page int, seq int, low double, high double")
    got = figures.nearest(images, questions, ["paper", "page"], "image", F.col("c"), F.col("low"), F.col("high"), "seq")
    assert [(r.image, r.seq, r.inside) for r in got.orderBy("image").collect()] == [("i1", 1, True), ("i2", 1, False)]
    top = spark.createDataFrame([("p", 2, "j", 100.0)], "paper string, page_num int, image string, y0 double")
    before = spark.createDataFrame([("p", 1, 4, 100.0), ("p", 1, 5, 600.0)], "paper string, page_num int, seq int, y0 double")
    assert rows(figures.continued(top, before, ["paper"], "image")) == [("p", 2, "j", 5)]


def test_captions(spark):
    images = spark.createDataFrame([("p", "i", 100.0, 100.0, 200.0, 200.0)], "paper string, image string, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("p", 1, "Fig", 110.0, 210.0, 130.0, 220.0), ("p", 2, "one", 135.0, 210.0, 150.0, 220.0), ("p", 3, "far", 500.0, 700.0, 520.0, 710.0)], "paper string, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    assert rows(figures.captions(images, words, ["paper"], "image")) == [("p", "i", "Fig one")]


def test_upserts_keep_tenants_apart(spark):
    old = spark.createDataFrame([("a", "x", 1, "old"), ("a", "y", 1, "same"), ("b", "x", 1, "other")], "school string, id string, seq int, v string")
    new = spark.createDataFrame([("a", "x", 2, "new"), ("a", "z", 2, "more")], old.schema)
    got = state.upserted(old, new, ["school", "id"], "seq")
    assert rows(got.select("school", "id", "v")) == [("a", "x", "new"), ("a", "y", "same"), ("a", "z", "more"), ("b", "x", "other")]
    assert rows(got.groupBy("school").count()) == [("a", 3), ("b", 1)]


def test_cache_misses_on_changed_hash_or_version(spark):
    cache = spark.createDataFrame([("h1", "v1", "answer")], "hash string, version string, answer string")
    asked = spark.createDataFrame([("h1", "v1"), ("h2", "v1"), ("h1", "v2")], "hash string, version string")
    hit, miss = state.cached(asked, cache, ["hash", "version"])
    assert rows(hit) == [("h1", "v1", "answer")] and rows(miss) == [("h1", "v2"), ("h2", "v1")]


def test_nested_patch(spark):
    s = spark.createDataFrame([([("S", [("1", "a"), ("2", "b"), ("2", "c")])],)], "sections array<struct<section_id string, questions array<struct<question_number string, text string>>>>")
    got = s.select(state.patched(F.col("sections"), "2", lambda q: q.withField("text", F.lit("new")))).first()[0]
    assert [q.text for q in got[0].questions] == ["a", "new", "c"]


def test_identical_texts_are_near_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, -1.0]), (4, [0.0, 0.0])], "k long, v array<double>")
    assert rows(dedup.near_pairs(v, "k", "v", 9900)) == [(1, 2, 10000)]


def test_fusion_and_paging(spark):
    dense = spark.createDataFrame([(1, 900, 1), (2, 800, 2), (3, 700, 3)], "doc_id int, bp int, dense_rank int")
    sparse = spark.createDataFrame([(3, 1)], "doc_id int, sparse_rank int")
    got = {r.doc_id: r.rrf for r in search.fused(dense, sparse).collect()}
    assert got == {1: round(1e6 * (1 / 61 + 1 / 160)), 2: round(1e6 * (1 / 62 + 1 / 160)), 3: round(1e6 * (1 / 63 + 1 / 61))}
    ids = spark.range(25).orderBy("id")
    assert [r.id for r in search.page(ids, 99, 10).collect()] == [20, 21, 22, 23, 24]
    assert search.page(ids, 1, -1).count() == 25
    assert search.rendered(spark.createDataFrame([], "rank int, t string"), "rank", F.col("t")).first().context == "No matching questions found."


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, "none"), (1, 2, "a Cat"), (2, 1, "dog")], "query_id int, rank int, document string")
    queries = spark.createDataFrame([(1, ["cat"]), (2, ["bird"])], "query_id int, keywords array<string>")
    assert tuple(search.evaluated(hits, queries).first()) == (0.25, 0.5)


def test_distributions(spark):
    d = spark.createDataFrame([("x", None), ("x", "b"), (" ", "b")], "p string, q string")
    assert rows(A.distributions(d, "p", "q")) == [("p", "unknown", 1), ("p", "x", 2), ("q", "b", 2), ("q", "unknown", 1)]


def test_synthesizer_is_deterministic_and_right(spark):
    a, b = synth.questions(spark, 50, seed=3).collect(), synth.questions(spark, 50, seed=3).collect()
    assert a == b and len(a) == 50 and all(r.answer is not None for r in a)
    p = next(r for r in a if r.topic == "progression")
    n, first, step = (int(x) for x in __import__("re").findall(r"\d+", p.text))
    assert p.answer == sum(first + i * step for i in range(n))


def test_streaming_windows_and_sink(spark, tmp_path):
    from quire import streaming

    e = spark.createDataFrame([(i, datetime(2024, 1, 1, i // 2), i % 2, "view") for i in range(8)], "event_id long, ts timestamp, user_id long, event_type string")
    e.write.parquet(str(tmp_path / "in"))
    source = streaming.events(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string")
    q = streaming.tumbling(source, "ts", "10 minutes", "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert rows(spark.table("hours").select("n")) == [(2,)] * 4
    q = source.writeStream.foreachBatch(streaming.upsert_into(str(tmp_path / "out"), ["user_id"], "event_id")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert rows(streaming.current(spark, str(tmp_path / "out"), ["user_id"], "event_id").select("user_id", "event_id")) == [(0, 6), (1, 7)]


def test_papers(spark):
    from quire.operators import papers as P

    o = [("A", "x"), ("B", "y")]
    draft = spark.createDataFrame([("p", [("S", [("1", 2, "stem", [("a", "part", o, [("a", "one", []), ("b", "two", o)])]), ("2", 1, "whole", [("", " ", o, [])]), ("3", 1, "bare", [])])])], P.DRAFT)
    assert rows(P.draft_questions(draft).select("question_number", "raw_text")) == [("1_a", "one"), ("1_b", "two"), ("2", "whole"), ("3", "bare")]
    blocks = spark.createDataFrame([("p", 1, "b", 90.0, 11.0), ("p", 1, "1. a", 10.0, 13.0), ("p", 1, "Section A", 0.0, 1.0), ("p", 2, "c", 0.0, 0.0)], "paper_id string, page_num int, text string, x0 double, y0 double")
    assert P.markdown(blocks).first().markdown == "<!-- page 1 -->\n# Section A\n## 1. a\nb\n\n<!-- page 2 -->\nc"
    spans = spark.createDataFrame([("l", 0, 10.0, 0.0, 10.0, 20.0), ("l", 1, 6.0, 11.0, 14.0, 15.0), ("l", 2, 10.0, 15.0, 20.0, 20.0)], "line string, n int, size double, x0 double, x1 double, y1 double")
    assert [r.raised for r in P.superscripts(spans, ["line"], "n").orderBy("n").collect()] == [False, True, False]
    chunks = spark.createDataFrame([("p", 1, "q", []), ("p", 2, "", ["a", "b"]), ("p", 3, "r", ["c"])], "paper string, n int, text string, options array<string>")
    assert rows(P.attached_orphans(chunks, "paper", "n", F.col("text") == "")) == [("p", 1, "q", ["a", "b"]), ("p", 3, "r", ["c"])]
    parts = spark.createDataFrame([(["short", "x" * 90 + "1", "x" * 90 + "2", "a long enough text\nPage 3 of 4"],)], "p array<string>")
    assert parts.select(P.kept_parts(F.col("p"))).first()[0] == ["x" * 90 + "1", "a long enough text"]
    lines = spark.createDataFrame([(["Assertion: a", "Reason: b", "(a) x"],)], "p array<string>")
    assert lines.select(P.folded_reasons(F.col("p"))).first()[0] == ["Assertion: a\nReason: b", "(a) x"]
    q = spark.createDataFrame([("what is the long question\nSection B more", ["a", "b"], ["x"])], "raw_text string, options array<string>, subparts array<string>")
    r = P.finalised(q).first()
    assert (r.raw_text, r.subparts, r.is_valid) == ("what is the long question", [], True)


def test_option_extract_reads_whole_turns(spark, tmp_path):
    from quire.plans import catalogue

    text = "Which of these numbers is the largest prime below thirty, if any?\n(a) 23 (b) 29 (c) 27\n(d) 31"
    spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "short")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.stem, [o["text"] for o in json.loads(r.options)]) for r in catalogue.QUERIES["option_extract"](spark, str(tmp_path)).collect()}
    assert got == {0: (text.split("\n")[0], ["23", "29", "27", "31"]), 1: ("short", ["assistant", "two", "three", "four"])}
