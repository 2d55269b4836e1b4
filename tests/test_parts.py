import json

from pyspark.sql import functions as F

from quire.functions import parts as P
from quire.operators import ingest, review, search, serving


def test_choices_are_gated():
    stacked = "1. Pick the number\n(a) 3\n/ 4\n(b) red ;\n(c) blue\n(d) -8"
    assert P.gated_choices(stacked, "Section A", "1") == ["(a) 3 / 4", "(b) red", "(c) blue", "(d) -8"]
    assert P.gated_choices(stacked, "Section B", "25") == [] and P.gated_choices(stacked, "PART 2", "25") != []
    assert P.gated_choices("Assertion (A): x\nReason (R): y", "Section E", "40")[3] == "(d) Assertion (A) is false but Reason (R) is true."
    assert P.gated_choices("Read the following passage (a) x1 (b) x2 (c) x3 (d) x4", "", "1") == []
    # labels with points: exactly four, none an instruction, none too long
    assert P.gated_choices("Pick\nA. one1\nB. two2\nC. 3\nD. four", "", "2") == ["(a) one1", "(b) two2", "(c) 3", "(d) four"]
    assert P.gated_choices("Do\nA. Find it\nB. two2\nC. 3\nD. four", "", "2") == []
    assert P.gated_choices(None) == [] and P.gated_choices("(a) only one") == []
    # a heading ends a value, and what stands on it is no choice's
    assert P.gated_choices("(a) p1\n(b) p2\n(c) p3\n(d) p4\nSection B\nmore", "", "3")[3] == "(d) p4"


def test_stem_and_parts():
    stem, parts = P.stem_and_parts("Q16. A body moves.\n(i) Find its speed [2]\n[2]\nor\n(ii)\nits mass\n3 Marks")
    assert stem == "A body moves." and parts == ["(i) Find its speed [2]", "OR", "(ii) its mass"]
    assert P.stem_and_parts("Pick one\n(A) red\n(B) blue", ["red", "blue"]) == ("Pick one", [])
    assert P.stem_and_parts("Look\n[IMAGE_PLACEHOLDER_3]\n[Embedded Diagram Reference: a.png]\nPage 3 | 4\nOptions:") == ("Look\nPage 3 | 4\nOptions:" if not P.PAGE_FOOT.search("Page 3 | 4") else "Look", [])
    assert P.stem_and_parts("plain", [], ["(a) kept\n[1]", " "]) == ("plain", ["(a) kept"])
    assert P.stem_and_parts(None) == ("", []) and P.stem_and_parts("") == ("", [])


def test_blocks_are_split_on_labels():
    assert P.split_block("3.\nChoose the correct option\nfirst question here\n(a)\nsecond question here\n(b)\nno\n(iii)\nhttps://a.b\nthird question here") == ["first question here", "second question here", "third question here"]
    assert P.split_block("one question alone") == ["one question alone"] and P.split_block(None) == []


def test_sub_questions_of_both_layouts():
    got = P.sub_questions("Answer these\n(a) What is water? [1]\nA. liquid\nB. solid\n(b) State its formula")
    assert [(s["label"], s["text"], s["question_type"], len(s["options"])) for s in got] == [("(a)", "Answer these\nWhat is water?", "single_choice_mcq", 2), ("(b)", "Answer these\nState its formula", "short_answer", 0)]
    # stems before their labels: each part has the one that was left over
    got = P.sub_questions("Fill in the blank\nthe first stem\n[1]\n(a)\nA. x\nB. y\nthe second stem\n[1]\n(b)\nA. z\nB. w")
    assert [s["text"].split("\n")[1] for s in got] == ["the first stem", "the second stem"] and {s["question_type"] for s in got} == {"fill_in_the_blank"}
    assert [s["label"] for s in P.sub_questions("Think\ni. one thing\nii. another")] == ["(i)", "(ii)"] and P.sub_questions(None) == []


def test_items_are_cleaned_and_kept_once():
    long = "x" * 90
    assert P.kept_items([long, long + " again", "short", "a line\n2 / 4\nhttps://a.b\nand its end", None]) == [long, "a line\nand its end"]


def test_coercion(spark):
    rows = spark.createDataFrame([('["a", "b"]',), ('"one"',), ("{broken",), (None,), ("[1, 2]",)], "t string")
    assert [r[0] for r in rows.select(serving.coerced(F.col("t"))).collect()] == [["a", "b"], ["one"], [], [], ["1", "2"]]


def test_endpoint_pages_types_and_empty_results(spark):
    schema = "chunk_id string, document string, question_number string, question_type string, options array<string>, subparts array<string>, linked_images array<string>, image_urls array<string>, requires_image boolean, subject string"
    rows = [(f"c{i:02d}", f"water and heat {'in the diagram' if i % 5 == 0 else ''} number {i}", str(i), "short_answer", ["(a) x", "(b) y"] if i % 2 else [], [], [], [], None, "science") for i in range(23)]
    chunks = spark.createDataFrame(rows, schema)
    page, told = serving.endpoint(chunks, "heat water", page=9, page_size=5, type_filter="single_choice_mcq")
    assert (told["total_results"], told["total_pages"], told["page"]) == (11, 3, 3) and [r.place for r in page.orderBy("place").collect()] == [11]
    assert serving.endpoint(chunks, "heat", type_filter="diagram_based")[1]["total_results"] == 5
    got, told = serving.endpoint(chunks, "heat", subject="nothing")
    assert told["total_results"] == 0 and serving.context(got.withColumns({c: F.lit("x") for c in ("paper_id", "class_level", "year")})).first()[0] == serving.NOTHING_FOUND
    some, told = serving.endpoint(chunks, " ", page_size=-1)
    assert told["is_random"] and some.count() == 23


def test_batch_search_ranks_as_single_searches_do(spark):
    docs = spark.createDataFrame([(i, f"{'red' if i % 3 else 'blue'} word{i % 7} of text {'zeta' * (i % 4)}") for i in range(60)], "doc_id long, text string").repartition(4)
    asked = [(1, "red word3"), (2, "zeta of blue"), (3, "nothing alike")]
    got = search.batch(docs, spark.createDataFrame(asked, "query_id long, text string"), 5)
    for q, text in asked:
        mine = [(r.doc_id, r.rrf, r.bp) for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()]
        assert mine == [(r.doc_id, r.rrf, r.bp) for r in search.hybrid(docs, text, 5).collect()]


def test_orphans_give_their_options_once(spark):
    schema = "paper_id string, question_id int, content string, section string, question_number string, options array<string>, subparts array<string>, linked_images array<string>"
    rows = [("p", 0, "Options:", "S", "1", ["(a) lost", "(b) lost"], [], []), ("p", 1, "What is water made of", "S", "30", [], [], []), ("p", 2, "Options:", "S", "1", ["(a) h", "(b) o"], [], []), ("p", 3, "or", "S", "1", ["(a) late", "(b) later"], [], []), ("p", 4, "Look at the graph", "S", "30", [], [], [])]
    got = review.refined(spark.createDataFrame(rows, schema), spark.createDataFrame([("p", "[IMAGE_PLACEHOLDER_1]")], "paper_id string, placeholder string"))
    assert [(r.question_id, r.question_type, [o.text for o in r.options], r.linked_images) for r in got.orderBy("question_id").collect()] == [(1, "mcq", ["h", "o"], []), (4, "short_answer", [], ["[IMAGE_PLACEHOLDER_1]"])]


def test_reconciliation_repairs_from_the_source(spark):
    schema = "question_number string, text string, options array<struct<label:string,text:string>>, placeholders array<string>, span string"
    rows = [("1", "a full stem of text", [], [], "stem (a ) one (b ) two [IMAGE_PLACEHOLDER_2]"), ("2", "x", [], [], "a source of more than thirty characters"), ("3", "a full stem of text", [], [], None)]
    got = {r.question_number: r for r in review.reconciled(spark.createDataFrame(rows, schema)).collect()}
    assert [o.text for o in got["1"].options] == ["one", "two [IMAGE_PLACEHOLDER_2]"] and got["1"].placeholders == ["[IMAGE_PLACEHOLDER_2]"] and got["1"].corrected
    assert got["2"].needs_manual_review and "truncated" in got["2"].review_reason and not got["3"].corrected and got["3"].correction_note is None


def test_tenants_are_written_apart_and_read_together(spark, tmp_path):
    rows = spark.createDataFrame([("1", "kv_1"), ("2", None), ("3", "navodaya")], "id string, school_slug string")
    serving.written_to_stores(rows, str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    assert back.count() == 3 and [r.id for r in serving.of_store(back, "KV #1").collect()] == ["1"] and serving.of_store(back, "all").count() == 3 and serving.emptied(back).count() == 0


def test_whole_papers_and_requests(spark):
    done = ingest.staged(ingest.fixtures(spark).limit(3).unionByName(ingest.fixtures(spark).limit(1).withColumn("paper_id", F.lit("empty")).withColumn("pages", F.slice("pages", 1, 0))))
    assert {r.paper_id == "empty": (r.status, r.n_chunks) for r in done["status"].collect()} == {True: ("no_questions", 0), False: ("done", 10)}
    paper = ingest.paper(spark, "pat", "school", "10", "mathematics", 6, at="now").collect()
    assert [p.question_number for p in paper] == [f"Q{i}" for i in range(1, 7)] and len({p.question_hash for p in paper}) == 6 and ingest.n_examples(3) == 6
    want = json.dumps({"question_text": "é", "options": [], "subparts": [], "class_level": "10", "subject": "General Science/Maths"}, sort_keys=True)
    import hashlib

    assert ingest.request_hash("é", None, None, None, None) == hashlib.sha256(want.encode()).hexdigest()


def test_files_without_a_hook_are_not_fetched(spark):
    seeds = spark.createDataFrame([("https://a.b/c.pdf", "c.pdf")], "url string, filename string")
    assert [r.status for r in ingest.fetched(seeds).collect()] == ["not_fetched"]
