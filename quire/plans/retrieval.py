"""Queries of search, near duplicates, analytics and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions import vectors as V
from quire.operators import analytics as A
from quire.operators import dedup, search
from quire.plans.book import Book, Tables

BOOK = Book()
query = BOOK.query

ASKED = "the nation of reason and the edition"
LIMB = "CAST('0x' || substr(md5(term), {0}, 8) AS BIGINT)"
HASHED = """
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM {docs}) WHERE word <> '' GROUP BY ALL),
v AS (SELECT DISTINCT word FROM w),
terms AS (SELECT word, word AS term, 2 AS wt FROM v UNION ALL SELECT word, substr(word, CAST(i AS INTEGER), 3), 1 FROM (SELECT word, unnest(generate_series(1, length(word) - 2)) AS i FROM v WHERE length(word) >= 3)),
vb AS (SELECT word, CAST((l3 + 256 * (l0 % 384 + l1 % 384 + l2 % 384)) % 384 AS INTEGER) AS bucket, sum(wt) AS wt FROM (SELECT word, wt, L0 AS l0, L1 AS l1, L2 AS l2, L3 AS l3 FROM terms) GROUP BY ALL),
f AS (SELECT doc_id, bucket, CAST(sum(n * wt) AS BIGINT) AS weight FROM w JOIN vb USING (word) GROUP BY ALL)
""".replace("L0", LIMB.format(1)).replace("L1", LIMB.format(9)).replace("L2", LIMB.format(17)).replace("L3", LIMB.format(25))
DENSE = f"""WITH docs AS (SELECT doc_id, text FROM documents {{where}} UNION ALL SELECT -1, '{ASKED}'), {HASHED.format(docs="docs")},
q AS (SELECT bucket, weight AS qw FROM f WHERE doc_id = -1), qn AS (SELECT sum(qw * qw) AS qn FROM q),
s AS (SELECT doc_id, sum(weight * coalesce(qw, 0)) AS dot, sum(weight * weight) AS n2 FROM f LEFT JOIN q USING (bucket) WHERE doc_id >= 0 GROUP BY doc_id),
bp AS (SELECT d.doc_id, coalesce(CAST(round_even(CASE WHEN n2 > 0 AND qn > 0 THEN dot / (sqrt(CAST(n2 AS DOUBLE)) * sqrt(CAST(qn AS DOUBLE))) * 10000 ELSE 0 END, 0) AS BIGINT), 0) AS bp FROM docs d LEFT JOIN s USING (doc_id), qn WHERE d.doc_id >= 0),
dense AS (SELECT doc_id, bp, CAST(row_number() OVER (ORDER BY bp DESC, doc_id) AS INTEGER) AS dense_rank FROM bp)"""
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
SPARSE = f"""sparse AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS sparse_rank FROM (SELECT doc_id FROM documents WHERE list_has_any({TOKENS.format("text")}, {TOKENS.format(f"'{ASKED}'")}) ORDER BY doc_id LIMIT 30))"""
FUSED = """SELECT doc_id, bp, dense_rank, sparse_rank, CAST(round((1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + coalesce(sparse_rank, 100))) * 1000000) AS BIGINT) AS rrf FROM dense LEFT JOIN sparse USING (doc_id)"""
TOP = " ORDER BY rrf DESC, bp DESC, dense_rank LIMIT 10"


@query(f"WITH {HASHED.format(docs='documents')} SELECT doc_id, bucket, weight FROM f")
def hash_embed_buckets(t: Tables) -> DataFrame:
    return V.features(t.documents, "doc_id", "text")


@query(f"WITH {HASHED.format(docs='documents')} SELECT doc_id, CAST(sum(weight * weight) AS BIGINT) AS norm2 FROM f GROUP BY doc_id")
def hash_embed_norms(t: Tables) -> DataFrame:
    return V.norms(V.features(t.documents, "doc_id", "text"), "doc_id")


@query(DENSE.format(where="") + "SELECT doc_id, bp, dense_rank FROM dense WHERE dense_rank <= 20")
def dense_topk_text(t: Tables) -> DataFrame:
    return search.dense(t.documents, ASKED, cut=20).select("doc_id", "bp", "dense_rank")


@query(f"WITH {SPARSE} SELECT * FROM sparse")
def sparse_match_first30(t: Tables) -> DataFrame:
    return search.sparse(t.documents, ASKED)


@query(DENSE.format(where="") + f", {SPARSE} " + FUSED + TOP)
def hybrid_search_rrf(t: Tables) -> DataFrame:
    return search.hybrid(t.documents, ASKED, 10)


@query(DENSE.format(where="WHERE lang = 'en' AND source = 'src1'") + f", {SPARSE} " + FUSED + TOP)
def hybrid_search_filtered(t: Tables) -> DataFrame:
    return search.hybrid(t.documents, ASKED, 10, lang="en", source="src1")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents), tot AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t),
q AS (SELECT DISTINCT unnest({TOKENS.format(f"'{ASKED}'")}) AS term), tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) JOIN q USING (term) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, CAST(round(sum(greatest(ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) * 1000) AS BIGINT) AS score FROM tf JOIN df USING (term), tot GROUP BY doc_id""")
def bm25_scores(t: Tables) -> DataFrame:
    return search.bm25(t.documents, ASKED).select("doc_id", F.round(F.col("score") * 1000).cast("bigint").alias("score"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 7)
SELECT vec_id, label, CAST(list_sum(list_transform(list_zip(e, qe), lambda p: p[1] * p[2])) AS BIGINT) AS dot FROM v, q WHERE vec_id <> 7 ORDER BY dot DESC, vec_id LIMIT 10""")
def vector_topk_embeddings(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint")).alias("e"))
    asked = v.filter("vec_id = 7").select(F.col("e").alias("qe"))
    return v.filter("vec_id <> 7").join(F.broadcast(asked)).select("vec_id", "label", V.dot(F.col("e"), F.col("qe")).alias("dot")).orderBy(F.desc("dot"), "vec_id").limit(10)


@query("SELECT doc_id, lang, source FROM documents ORDER BY lang, source, doc_id LIMIT 25 OFFSET 50")
def browse_sorted_page(t: Tables) -> DataFrame:
    return search.page(search.browse(t.documents.select("doc_id", "lang", "source"), "lang", "lang", "source", "doc_id"), 3, 25)


@query()
def random_sample_seeded(t: Tables) -> DataFrame:
    return search.shuffled(t.documents.select("doc_id", "lang"), "doc_id", 11).limit(20)


@query("SELECT string_agg('[' || rn || ']' || chr(10) || item_id || chr(10) || text, chr(10) || chr(10) ORDER BY rn) AS context FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark) WHERE rn <= 5")
def rag_context_render(t: Tables) -> DataFrame:
    top = t.benchmark.orderBy("item_id").limit(5).withColumn("rank", F.row_number().over(W.orderBy("item_id")))
    return search.rendered(top, "rank", F.col("item_id").cast("string"), F.col("text"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, list_dot_product(e, e) AS n2 FROM v)
SELECT a, b, bp FROM (SELECT x.vec_id AS a, y.vec_id AS b, CAST(floor(list_dot_product(x.e, y.e) / (sqrt(x.n2) * sqrt(y.n2)) * 10000 + 0.5) AS BIGINT) AS bp FROM n x JOIN n y ON x.vec_id < y.vec_id) WHERE bp >= 4000""")
def near_dup_pairs_vectors(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("e"))
    return dedup.near_pairs(v, "vec_id", "e", 4000)


@query(f"""WITH {HASHED.format(docs='documents')}, n AS (SELECT doc_id, sum(weight * weight) AS n2 FROM f GROUP BY doc_id), d AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.weight * y.weight) AS dot FROM f x JOIN f y ON x.bucket = y.bucket AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, bp FROM (SELECT a, b, CAST(floor(dot / (sqrt(CAST(x.n2 AS DOUBLE)) * sqrt(CAST(y.n2 AS DOUBLE))) * 10000 + 0.5) AS BIGINT) AS bp FROM d JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id) WHERE bp >= 9900""")
def near_dup_pairs_text(t: Tables) -> DataFrame:
    f = V.features(t.documents, "doc_id", "text").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    full = f.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(V.DIM - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias("e"))
    return dedup.near_pairs(full, "doc_id", "e", 9900)


@query("SELECT min(doc_id) AS first, md5(text) AS digest, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_dup_groups(t: Tables) -> DataFrame:
    return dedup.exact_groups(t.documents, "doc_id", "text")


@query("SELECT doc_id, lang, substr(text, 1, 150) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dup_keep_first(t: Tables) -> DataFrame:
    return A.first_wins(t.documents.select("doc_id", "lang", dedup.snippet("text").alias("snippet"), F.md5("text").alias("digest")), ["digest"], "doc_id").drop("digest")


@query("SELECT coalesce(nullif(trim(source), ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def distribution_by_source(t: Tables) -> DataFrame:
    return A.distribution(t.documents, "source")


@query("""WITH d AS (SELECT lang, source, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS field, lang AS value, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'quality', quality, count(*) FROM d GROUP BY ALL""")
def pattern_blueprint(t: Tables) -> DataFrame:
    return A.distributions(t.documents.join(t.labels, "doc_id", "left"), "lang", "source", "quality")


@query("SELECT doc_id, text AS example FROM documents WHERE lower(lang) = 'en' ORDER BY doc_id LIMIT 12")
def pattern_examples(t: Tables) -> DataFrame:
    return A.examples(t.documents.filter(F.lower("lang") == "en").select("doc_id", F.col("text").alias("example")), "doc_id")


@query("SELECT (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents)) AS lang, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM documents)) AS source")
def dynamic_filters(t: Tables) -> DataFrame:
    return A.value_sets(t.documents, "lang", "source")


@query("SELECT coalesce(lang, 'total') AS lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang)")
def dataset_stats_rollup(t: Tables) -> DataFrame:
    return A.totals(t.documents, "lang", docs=F.count("*"), chars=F.sum("n_chars"))


PRESETS = [("src1", "First School"), ("src3", "Third School"), ("elsewhere", "Another School")]


@query("""WITH p(source, name) AS (VALUES ('src1', 'First School'), ('src3', 'Third School'), ('elsewhere', 'Another School')), d AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source)
SELECT source, coalesce(name, source) AS name, coalesce(d.n, 0) AS n_questions, coalesce(r.n, 0) AS n_papers FROM p FULL JOIN d USING (source) FULL JOIN r USING (source)""")
def tenant_rollup(t: Tables) -> DataFrame:
    presets = t.spark.createDataFrame(PRESETS, "source string, name string")
    return A.merged_catalogue(presets, t.documents.groupBy("source").agg(F.count("*").alias("n_questions")), t.documents.groupBy("source").agg(F.countDistinct("lang").alias("n_papers")), "source")


CONFIDENCE = "CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'medium' ELSE 'high' END"


@query(f"SELECT source, count(*) FILTER (c = 'high') AS n_high, count(*) FILTER (c = 'medium') AS n_medium, count(*) FILTER (c = 'low') AS n_low FROM (SELECT source, {CONFIDENCE} AS c FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def confidence_histogram(t: Tables) -> DataFrame:
    return A.histogram(t.documents.join(t.labels, "doc_id").withColumn("c", F.expr(CONFIDENCE)), "source", "c", "high", "medium", "low")


@query(f"SELECT doc_id, {CONFIDENCE} AS confidence, toxic = 1 AS flagged FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0")
def review_queue(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id").select("doc_id", F.expr(CONFIDENCE).alias("confidence"), (F.col("toxic") == 1).alias("flagged"))
    return A.review_queue(rows)


@query("""SELECT count(*) AS questions, CAST(round(count(*) FILTER (length(trim(text)) > 15) * 10000 / greatest(count(*), 1)) AS BIGINT) AS stem_ok, CAST(round(count(*) FILTER (text NOT LIKE '%|%') * 10000 / greatest(count(*), 1)) AS BIGINT) AS clean,
CAST(round(count(*) FILTER (lang = 'en' AND n_chars > 1000) * 10000 / greatest(count(*) FILTER (lang = 'en'), 1)) AS BIGINT) AS long_english FROM documents""")
def quality_audit_ratios(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("questions"), A.ratio(F.length(F.trim("text")) > 15).alias("stem_ok"), A.ratio(~F.contains("text", F.lit("|"))).alias("clean"), A.ratio(F.col("n_chars") > 1000, F.col("lang") == "en").alias("long_english"))


@query(f"""WITH docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {HASHED.format(docs="docs")},
n AS (SELECT doc_id, sum(weight * weight) AS n2 FROM f GROUP BY doc_id), q AS (SELECT -1 - doc_id AS item_id, bucket, weight AS qw FROM f WHERE doc_id < 0),
dots AS (SELECT item_id, doc_id, sum(weight * qw) AS dot FROM f JOIN q USING (bucket) WHERE doc_id >= 0 GROUP BY ALL),
bp AS (SELECT b.item_id, d.doc_id, coalesce(CAST(round_even(dot / (sqrt(CAST(n.n2 AS DOUBLE)) * sqrt(CAST(m.n2 AS DOUBLE))) * 10000, 0) AS BIGINT), 0) AS bp FROM benchmark b CROSS JOIN documents d LEFT JOIN dots USING (item_id, doc_id) LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN n m ON m.doc_id = -1 - b.item_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bp DESC, doc_id) AS dense_rank FROM bp),
tok AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents), sparse AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS sparse_rank FROM (SELECT item_id, {TOKENS.format("text")} AS t FROM benchmark) b JOIN tok ON list_has_any(tok.t, b.t)),
fused AS (SELECT item_id, doc_id, bp, dense_rank, CAST(round((1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + CASE WHEN sparse_rank <= 30 THEN sparse_rank ELSE 100 END)) * 1000000) AS BIGINT) AS rrf FROM dense LEFT JOIN sparse USING (item_id, doc_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, bp DESC, dense_rank) AS r FROM fused), best AS (SELECT item_id, min(r) AS best FROM top JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE r <= 5 AND contains(lower(d.text), lower(b.text)) GROUP BY item_id)
SELECT CAST(round(avg(coalesce(1.0::DOUBLE / best, 0)) * 1000000) AS BIGINT) AS mrr, CAST(round(avg(CASE WHEN best IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) * 1000000) AS BIGINT) AS hit_rate FROM benchmark LEFT JOIN best USING (item_id)""")
def eval_mrr_hitrate(t: Tables) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    hits = search.batch(t.documents, asked, 5).join(t.documents.select("doc_id", F.col("text").alias("document")), "doc_id")
    out = search.evaluated(hits, asked.select("query_id", F.array("text").alias("keywords")))
    return out.select(F.round(F.col("mrr") * 1_000_000).cast("bigint").alias("mrr"), F.round(F.col("hit_rate") * 1_000_000).cast("bigint").alias("hit_rate"))
