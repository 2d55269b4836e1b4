"""Queries of text rules, segmentation, classification, figures and changing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import sources
from quire.functions import text as X
from quire.operators import analytics as A
from quire.operators import figures, state, synth
from quire.operators import questions as Q
from quire.plans.book import Book, Tables

BOOK = Book()
query = BOOK.query

LINES = "(SELECT doc_id, line, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents))"


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


SCRIPTS = "CASE doc_id % 4 WHEN 0 THEN repeat(chr(2361), CAST(length(text) AS INTEGER)) WHEN 1 THEN repeat(chr(61553), CAST(length(text) AS INTEGER)) WHEN 2 THEN chr(2361) || chr(61553) ELSE '' END"


@query(f"""SELECT doc_id, v > 0 AND length(regexp_replace(s, '[^\\x{{0900}}-\\x{{0FFF}}\\x{{1000}}-\\x{{109F}}]', '', 'g')) * 1.0 / greatest(v, 1) < 0.3 AND length(regexp_replace(s, '[^\\x{{E000}}-\\x{{F8FF}}]', '', 'g')) * 1.0 / greatest(v, 1) < 0.2 AS english FROM (SELECT doc_id, s, length(regexp_replace(s, '\\s', '', 'g')) AS v FROM (SELECT doc_id, text || {SCRIPTS} AS s FROM documents))""")
def english_dominance(t: Tables) -> DataFrame:
    more = F.expr("CASE doc_id % 4 WHEN 0 THEN repeat('ह', length(text)) WHEN 1 THEN repeat('\uf071', length(text)) WHEN 2 THEN 'ह\uf071' ELSE '' END")
    return t.documents.select("doc_id", X.english_dominant(F.concat("text", more)).alias("english"))


NOISE = "chr(10) || 'P a g e 3 | 4' || chr(10) || 'see Class XII' || chr(10) || repeat(chr(2361), 5) || ' word' || chr(10) || '[2 Marks]' || chr(10) || 'a last line'"
NOISY_LINES = f"(SELECT doc_id, line, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) - 1 AS n FROM (SELECT doc_id, text || {NOISE} AS s FROM documents)))"


@query(f"""SELECT doc_id, n, line FROM {NOISY_LINES} WHERE trim(line) <> '' AND NOT (coalesce(length(regexp_replace(line, '[^\\x{{0900}}-\\x{{109F}}]', '', 'g')) * 1.0 / nullif(length(replace(line, ' ', '')), 0), 0) > 0.2 OR regexp_matches(line, '(?i)P\\s*a\\s*g\\s*e\\s*\\d+\\s*\\|\\s*\\d+') OR regexp_matches(line, '(?i)Class[\\-\\s]*X|Sample\\s+Paper|Page\\s+\\d+\\s+of\\s+\\d+') OR regexp_matches(line, '(?i)^(Page\\s*\\d+|\\d+\\s*of\\s*\\d+)$') OR regexp_matches(line, '(?i)^\\s*(\\[\\s*\\]|[()\\[\\],''"`]|\\d+\\s*Marks?|\\[\\d+(\\s*Marks?)?\\]|\\(\\d+(\\s*Marks?)?\\))\\s*$'))""")
def line_noise_filter(t: Tables) -> DataFrame:
    noisy = t.documents.withColumn("text", F.concat("text", F.lit("\nP a g e 3 | 4\nsee Class XII\n" + "ह" * 5 + " word\n[2 Marks]\na last line")))
    return noisy.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter((F.trim("line") != "") & ~X.noise_line(F.col("line"))).select("doc_id", "n", "line")


VERBS = "|".join(X.COMMANDS)
AIMS = "|".join(X.TARGETS)


TOLD = "chr(10) || CASE doc_id % 6 WHEN 0 THEN 'Answer any two of the questions' WHEN 1 THEN 'Each one will carry 2 marks' WHEN 2 THEN 'Do all questions now' WHEN 3 THEN 'Choose the option: why?' WHEN 4 THEN 'Select the following a) word' ELSE 'Find the following' END"
TOLD_LINES = f"(SELECT doc_id, line, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) - 1 AS n FROM (SELECT doc_id, text || {TOLD} AS s FROM documents)))"


@query(f"""SELECT doc_id, n FROM (SELECT *, lower(trim(line)) AS l FROM {TOLD_LINES}) WHERE l <> '' AND NOT (contains(l, '?') OR regexp_matches(l, '=\\s*[\\d?.]') OR regexp_matches(l, '\\b[a-d]\\)\\s+\\w+'))
AND ((regexp_matches(l, '^({VERBS})') AND regexp_matches(l, '{AIMS}')) OR (contains(l, 'carry') AND contains(l, 'mark')) OR contains(l, 'all questions')) AND length(l) < 160 AND NOT regexp_matches(l, '\\b(why|how|what|where|when|which|who|calculate|prove|derive|find)\\b')""")
def instruction_lines(t: Tables) -> DataFrame:
    told = t.documents.select("doc_id", F.split(F.concat("text", F.expr(TOLD.replace("chr(10)", "'\\n'"))), "\n").alias("l"))
    return told.select("doc_id", F.posexplode("l").alias("n", "line")).filter(X.instruction_line(F.col("line"))).select("doc_id", "n")


@query("""SELECT doc_id, replace(replace(replace(replace(text, 'th', 'θ'), 'er', chr(1)), 'on', '≤'), chr(1), '') || ' "#()≤≥ Ω []λμπθ{αβγ}∞ → ∫× ∈  → [ ][ ]=+-×÷' AS text FROM documents""")
def glyph_normalize(t: Tables) -> DataFrame:
    every = F.lit("".join(X.GLYPHS) + "\uf123\u0939\u200b\u25a1")
    return t.documents.select("doc_id", X.normal_glyphs(F.concat(X.replaced(F.col("text"), {"th": "\uf071", "er": "\uf0b7", "on": "\uf03c"}), every)).alias("text"))


@query("SELECT doc_id, replace(replace(text, 'th', '\\theta'), 'on', '\\rightarrow') AS text FROM documents")
def symbol_to_latex(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.latex_symbols(X.replaced(F.col("text"), {"th": "θ", "on": "→"})).alias("text"))


@query()
def latex_rules(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.latex(X.replaced(F.col("text"), {" the ": " 45° ", " of ": " H2O ", " and ": " √2 "})).alias("text"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(lower(c_name), '[^\\w\\s-]', '', 'g'), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g') AS slug FROM customer")
def slugify(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.slug(F.col("c_name")).alias("slug"))


@query()
def option_extract(t: Tables) -> DataFrame:
    asked = F.concat("text", F.lit("\n(a) "), F.col("role"), F.lit(" (b) two; (c) three\n(d) four (a) again"))
    return t.conversations.select("conv_id", "turn", Q.stem(asked).alias("stem"), F.to_json(Q.options(asked)).alias("options"))


KIND = "CASE WHEN contains(l, 'assertion') AND contains(l, 'reason') THEN 'assertion_reason' WHEN contains(l, 'read the following') OR contains(l, 'case study') OR contains(l, 'passage') OR contains(l, 'based on the above') THEN 'case_study_passage' WHEN contains(l, 'match') AND (contains(l, 'column') OR contains(l, 'list')) THEN 'match_the_following' WHEN contains(l, '_______') OR contains(l, 'fill in the blank') THEN 'fill_in_the_blank' WHEN contains(l, 'true or false') OR contains(l, 'state whether true') THEN 'true_false' WHEN n_options >= 2 THEN 'single_choice_mcq' WHEN contains(l, 'calculate the value') OR contains(l, 'find the magnitude') OR contains(l, 'numerical value') THEN 'numeric_answer' WHEN contains(l, 'prove that') OR contains(l, 'derive') OR contains(l, 'explain in detail') OR contains(l, 'describe the mechanism') THEN 'long_answer' ELSE 'short_answer' END"
# Phrases that some documents get, so that every rule is met.
PHRASED = "text || CASE doc_id % 8 WHEN 1 THEN ' Assertion and Reason' WHEN 2 THEN ' Match column' WHEN 3 THEN ' _______' WHEN 4 THEN ' true or false' WHEN 5 THEN ' prove that' WHEN 6 THEN ' in the diagram' ELSE '' END"
TYPED = f"(SELECT doc_id, text, n_options, {KIND} AS question_type, contains(l, 'the figure') OR contains(l, 'in the diagram') OR contains(l, 'shown below') OR contains(l, 'the graph') OR contains(l, 'in fig') AS named FROM (SELECT doc_id, text, lower(text) AS l, n_options FROM (SELECT doc_id, {PHRASED} AS text, CAST(n_chars % 5 AS INTEGER) AS n_options FROM documents)))"


def typed(t: Tables) -> DataFrame:
    return Q.classified(t.documents.select("doc_id", F.expr(PHRASED).alias("text"), (F.col("n_chars") % 5).cast("int").alias("n_options"), F.lit(0).alias("n_images")))


@query(f"SELECT doc_id, question_type, named AS requires_image, CASE WHEN named OR (question_type = 'assertion_reason' AND n_options <> 4) THEN 'low' WHEN question_type = 'single_choice_mcq' AND n_options < 4 THEN 'medium' ELSE 'high' END AS confidence FROM {TYPED}")
def classify_type(t: Tables) -> DataFrame:
    return typed(t).select("doc_id", "question_type", "requires_image", "confidence")


ISSUES = f"""(SELECT doc_id, 'assertion_reason question has ' || n_options || ' options, expected exactly 4' AS issue, 'critical' AS severity FROM {TYPED} WHERE question_type = 'assertion_reason' AND n_options <> 4
UNION ALL SELECT doc_id, 'question references a figure/diagram but has no image_placeholder attached', 'critical' FROM {TYPED} WHERE named
UNION ALL SELECT doc_id, 'text references a figure/diagram but no image was detected nearby in source PDF', 'critical' FROM {TYPED} WHERE named
UNION ALL SELECT doc_id, 'true_false has ' || n_options || ' options array (expected 2)', 'minor' FROM {TYPED} WHERE question_type = 'true_false' AND n_options > 0 AND n_options <> 2
UNION ALL SELECT doc_id, 'match_the_following question has no structured column table_data', 'minor' FROM {TYPED} WHERE question_type = 'match_the_following'
UNION ALL SELECT doc_id, 'stem is shorter than 15 characters', 'critical' FROM {TYPED} WHERE length(trim(text)) < 15)"""


@query(f"SELECT * FROM {ISSUES}")
def validate_issues(t: Tables) -> DataFrame:
    return Q.issues(typed(t), "doc_id")


@query(f"SELECT doc_id, CASE WHEN bool_or(severity = 'critical') THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN bool_or(severity = 'critical') THEN string_agg(issue, '; ' ORDER BY issue) FILTER (severity = 'critical') ELSE string_agg(issue, '; ' ORDER BY issue) END AS reason FROM {ISSUES} GROUP BY doc_id")
def severity_rollup(t: Tables) -> DataFrame:
    return Q.rolled_up(Q.issues(typed(t), "doc_id"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def audit_missing_items(t: Tables) -> DataFrame:
    return Q.missing(t.documents, t.labels, "doc_id")


@query("SELECT conv_id, turn, '[IMAGE_PLACEHOLDER_1],[IMAGE_PLACEHOLDER_0]' || CASE WHEN turn > 1 THEN ',[IMAGE_PLACEHOLDER_' || turn || ']' ELSE '' END AS placeholders FROM conversations")
def reconcile_sets(t: Tables) -> DataFrame:
    span = F.concat(F.lit("[IMAGE_PLACEHOLDER_1] "), "text", F.lit(" [IMAGE_PLACEHOLDER_"), F.col("turn").cast("string"), F.lit("] [IMAGE_PLACEHOLDER_1]"))
    both = Q.reconciled(span, F.array(F.lit("[IMAGE_PLACEHOLDER_1]"), F.lit("[IMAGE_PLACEHOLDER_0]")))
    return t.conversations.select("conv_id", "turn", F.array_join(both, ",").alias("placeholders"))


@query("""SELECT doc_id, CASE WHEN contains(s, 'MATH') OR (e AND q BETWEEN 41 AND 60 AND NOT contains(s, 'MENTAL')) THEN CASE WHEN contains(s, 'MENTAL') OR (e AND q BETWEEN 1 AND 40) THEN 'mental_ability' ELSE 'mathematics' END WHEN contains(s, 'MENTAL') OR (e AND q BETWEEN 1 AND 40) THEN 'mental_ability' WHEN e AND q >= 61 THEN 'english' WHEN contains(s, 'SCIENCE') THEN 'science' ELSE lang END AS subject,
CASE WHEN o > 0 THEN 'easy' WHEN n_chars > 300 THEN 'hard' ELSE 'medium' END AS difficulty
FROM (SELECT doc_id, lang, n_chars, doc_id % 90 AS q, doc_id % 3 AS o, CASE doc_id % 5 WHEN 0 THEN 'PART A' WHEN 1 THEN 'MATHS' WHEN 2 THEN 'SCIENCE' WHEN 3 THEN 'MENTAL ABILITY' ELSE 'GENERAL' END AS s, doc_id % 5 = 0 AS e FROM documents)""")
def chunk_subject_difficulty(t: Tables) -> DataFrame:
    section = F.expr("CASE doc_id % 5 WHEN 0 THEN 'PART A' WHEN 1 THEN 'MATHS' WHEN 2 THEN 'SCIENCE' WHEN 3 THEN 'MENTAL ABILITY' ELSE 'GENERAL' END")
    number = (F.col("doc_id") % 90).cast("string")
    return t.documents.select("doc_id", Q.chunk_subject(section, number, F.col("lang"), F.lit(None).cast("string")).alias("subject"), Q.difficulty(F.col("doc_id") % 3, F.col("text"), F.lit(False)).alias("difficulty"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def section_carry_forward(t: Tables) -> DataFrame:
    return Q.carried(t.conversations, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn + 1 WHEN turn % 3 = 1 AND length(after) > 5 AND NOT starts_with(after, 'Page') AND NOT starts_with(after, 'Marks') THEN turn + 1 END AS number
FROM (SELECT conv_id, turn, lead(l) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Q' || (turn + 1) || '. ' || text WHEN 1 THEN CAST(turn + 1 AS VARCHAR) ELSE CASE WHEN conv_id % 2 = 0 THEN 'Page of ' ELSE 'ZQ ' END || text END AS l FROM conversations))""")
def lookahead_lead(t: Tables) -> DataFrame:
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Q"), (F.col("turn") + 1).cast("string"), F.lit(". "), "text")).when(F.col("turn") % 3 == 1, (F.col("turn") + 1).cast("string")).otherwise(F.concat(F.when(F.col("conv_id") % 2 == 0, "Page of ").otherwise("ZQ "), "text"))
    return Q.number_of(t.conversations.withColumn("line", line), "conv_id", "turn", "line").select("conv_id", "turn", F.col("number").cast("bigint").alias("number"))


@query("SELECT user_id, block, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM events) GROUP BY ALL")
def gaps_islands_blocks(t: Tables) -> DataFrame:
    e = t.events.withColumn("at", F.struct("ts", "event_id"))
    return Q.blocks(e, "user_id", "at", F.col("event_type") == "signup").groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH RECURSIVE c AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS rn, event_id AS seq, CAST(event_id % 40 AS BIGINT) AS number FROM events),
r AS (SELECT user_id, rn, seq, number AS last, true AS ok FROM c WHERE rn = 1 UNION ALL SELECT c.user_id, c.rn, c.seq, CASE WHEN (r.last < number AND number <= r.last + 15) OR (number = 1 AND r.last > 5) THEN number ELSE r.last END, (r.last < number AND number <= r.last + 15) OR (number = 1 AND r.last > 5) FROM r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)
SELECT user_id, seq, last AS number FROM r WHERE ok""")
def monotone_accept_fold(t: Tables) -> DataFrame:
    taken = Q.accepted(t.events.withColumn("number", F.col("event_id") % 40), "user_id", "event_id", "number")
    return taken.select("user_id", F.explode("taken").alias("t")).select("user_id", "t.seq", "t.number")


def seconds():
    """ts as seconds, whatever the session's time zone: it has none itself."""
    return F.unix_date(F.to_date("ts")) * 86400.0 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.expr("extract(SECOND FROM ts)").cast("double")


@query("""SELECT event_id, seq, inside FROM (SELECT a.event_id, q.event_id AS seq, abs(epoch(a.ts) - epoch(q.ts)) <= 3600 AS inside, row_number() OVER (PARTITION BY a.event_id ORDER BY CASE WHEN abs(epoch(a.ts) - epoch(q.ts)) <= 3600 THEN 0 ELSE 1 END, CASE WHEN abs(epoch(a.ts) - epoch(q.ts)) <= 3600 THEN 0 ELSE abs(epoch(a.ts) - epoch(q.ts)) END, q.event_id) AS rn
FROM events a JOIN events q ON a.user_id = q.user_id WHERE a.event_type = 'error' AND q.event_type = 'purchase') WHERE rn = 1""")
def image_nearest_link(t: Tables) -> DataFrame:
    at = seconds()
    images = t.events.filter("event_type = 'error'").select("user_id", "event_id", at.alias("centre"))
    questions = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("seq"), (at - 3600).alias("low"), (at + 3600).alias("high"))
    found = figures.nearest(images, questions, ["user_id"], "event_id", F.col("centre"), F.col("low"), F.col("high"), "seq")
    return found.select("event_id", "seq", "inside")


@query("""WITH e AS (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS page, value * 10 AS y0 FROM events), last AS (SELECT user_id, page, max(event_id) AS seq FROM e GROUP BY ALL)
SELECT i.user_id, i.page AS page_num, i.event_id AS image, l.seq FROM e i JOIN last l ON l.user_id = i.user_id AND l.page = i.page - 1 JOIN e q ON q.event_id = l.seq WHERE i.y0 < 150 AND q.y0 > 500 AND i.page > 1""")
def cross_page_asof(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.unix_date(F.to_date("ts")).cast("bigint").alias("page_num"), F.col("event_id"), (F.col("value") * 10).alias("y0"))
    return figures.continued(e.withColumnRenamed("event_id", "image"), e.withColumnRenamed("event_id", "seq"), ["user_id"], "image")


@query("SELECT conv_id, string_agg(role || ':' || text, ' ' ORDER BY turn) AS text, min(turn) AS x0, max(turn) AS x1 FROM conversations WHERE turn % 4 NOT IN (1, 2) GROUP BY conv_id")
def ordered_line_assembly(t: Tables) -> DataFrame:
    conf = F.expr("CASE turn % 4 WHEN 0 THEN '90.5' WHEN 1 THEN '19' WHEN 2 THEN 'n/a' ELSE '20' END")
    words = t.conversations.select("conv_id", F.col("turn").alias("seq"), F.concat("role", F.lit(":"), "text").alias("text"), conf.alias("conf"), F.col("turn").alias("x0"), F.col("turn").alias("x1"), F.lit(0).alias("y0"), F.lit(0).alias("y1"))
    return Q.ocr_lines(words, "conv_id").select("conv_id", "text", "x0", "x1")


@query("SELECT user_id, min(value) AS x0, max(value) AS x1, min(event_id) AS y0, max(event_id) AS y1 FROM events GROUP BY user_id")
def bbox_union(t: Tables) -> DataFrame:
    boxes = t.events.select("user_id", F.col("value").alias("x0"), F.col("value").alias("x1"), F.col("event_id").alias("y0"), F.col("event_id").alias("y1"))
    return figures.union_box(boxes, "user_id").select("user_id", "x0", "x1", "y0", "y1")


@query("SELECT user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest_wins(t: Tables) -> DataFrame:
    old, new = t.events.filter("event_id % 2 = 0"), t.events.filter("event_id % 2 = 1")
    return state.upserted(old, new, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "props")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS created_at, max(event_id) AS updated_at FROM events GROUP BY ALL")
def upsert_keeping_created(t: Tables) -> DataFrame:
    return state.upserted_keeping(t.events, ["user_id", "event_type"], "event_id", "value")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_antijoin(t: Tables) -> DataFrame:
    return state.deleted(t.documents, t.labels.filter("toxic = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT conv_id, turn, sha256(text || '|v1') AS request_hash, EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id % 2 = 0 AND p.text = c.text) AS hit FROM conversations c")
def cache_lookup_hash(t: Tables) -> DataFrame:
    asked = t.conversations.select("conv_id", "turn", F.sha2(F.concat("text", F.lit("|v1")), 256).alias("request_hash"))
    cache = asked.filter("conv_id % 2 = 0").select("request_hash").distinct()
    hit, miss = state.cached(asked, cache, ["request_hash"])
    return hit.withColumn("hit", F.lit(True)).unionByName(miss.withColumn("hit", F.lit(False))).select("conv_id", "turn", "request_hash", "hit")


@query("SELECT doc_id, sha256(lang || '_' || source || '_2024-2025_' || doc_id) AS sha_id, md5(lang || '|' || source || '|2024-2025|' || doc_id) AS md5_id, substr(sha256(lang || '_' || source || '_2024-2025_' || doc_id), 1, 16) AS short_id FROM documents")
def paper_ids(t: Tables) -> DataFrame:
    ids = sources.paper_ids(F.col("lang"), F.col("source"), F.lit("2024-2025"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", *(c.alias(n) for n, c in ids.items()))


@query("SELECT user_id, string_agg(event_type || '=' || CAST(v AS VARCHAR), ',' ORDER BY event_type) AS status FROM (SELECT user_id, event_type, arg_max(event_id, event_id) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def status_map_update(t: Tables) -> DataFrame:
    m = state.status_map(t.events, "user_id", "event_type", "event_id", "event_id")
    entries = F.transform(F.array_sort(F.map_entries("phase_status")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("user_id", F.array_join(entries, ",").alias("status"))


@query()
def synth_questions(t: Tables) -> DataFrame:
    return synth.questions(t.spark, 50, seed=3)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT page_id, md5(url) AS url_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_text FROM pages")
def html_strip_lines(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5("url").alias("url_id"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("bigint").alias("n_text"))


@query("SELECT CAST(n AS INTEGER) AS number, CASE WHEN n BETWEEN 1 AND 15 THEN 'LOGICALREASONING' WHEN n BETWEEN 16 AND 35 THEN 'MATHEMATICALREASONING' WHEN n BETWEEN 36 AND 45 THEN 'EVERYDAYMATHEMATICS' WHEN n BETWEEN 46 AND 50 THEN 'ACHIEVERSSECTION' ELSE 'UNKNOWN' END AS section FROM (SELECT DISTINCT doc_id % 60 AS n FROM documents)")
def fixed_section_map(t: Tables) -> DataFrame:
    n = (F.col("doc_id") % 60).cast("int")
    return t.documents.select(n.alias("number")).distinct().select("number", Q.fixed_section(F.col("number")).alias("section"))


@query("SELECT c_custkey, gcd(CAST(c_custkey AS BIGINT), 360) AS g FROM customer")
def gcd_fold(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", synth.gcd(F.col("c_custkey"), F.lit(360)).alias("g"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'skipped_no_text' WHEN length(trim(text)) < 50 THEN 'needs_ocr' ELSE 'parsed' END AS status FROM documents")
def parse_gates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sources.parse_status(F.col("text")).alias("status"))


@query("SELECT source AS paper_id, CASE WHEN avg(length(trim(text))) > 200 THEN 'native' ELSE 'scanned' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents) WHERE page <= 3 GROUP BY source")
def native_or_scanned(t: Tables) -> DataFrame:
    page = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))  # only the first three of a source leave a task
    return sources.scan_kind(t.documents.select(F.col("source").alias("paper_id"), page.alias("page_num"), "text"))


@query("SELECT lang, lpad(CAST(count(*) AS VARCHAR), 6, '0') AS n FROM documents GROUP BY lang")
def count_by_class(t: Tables) -> DataFrame:
    return A.distribution(t.documents, "lang").select(F.col("value").alias("lang"), F.lpad(F.col("n").cast("string"), 6, "0").alias("n"))
