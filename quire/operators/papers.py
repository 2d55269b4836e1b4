"""Whole papers: nested drafts as questions, markdown from blocks, superscripts, orphans, final checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.questions import row_bands

#: What a draft is read as.
DRAFT = "paper_id string, sections array<struct<section_id string, questions array<struct<question_number string, marks int, stem_text string, subparts array<struct<label string, text string, options array<struct<label string, text string>>, subparts array<struct<label string, text string, options array<struct<label string, text string>>>>>>>>>>"
#: An empty paper: the usual marks and duration.
TEMPLATE = {"total_marks": 80, "duration": "3 Hours"}


def template(rows: DataFrame) -> DataFrame:
    """Adds exam_metadata with the defaults."""
    return rows.withColumn("exam_metadata", F.struct(F.lit(TEMPLATE["total_marks"]).alias("total_marks"), F.lit(TEMPLATE["duration"]).alias("duration")))


def draft_questions(drafts: DataFrame) -> DataFrame:
    """A row per question; one per nested part instead where the first part has two or more of them."""
    q = drafts.select("paper_id", F.posexplode("sections").alias("s", "section")).select("paper_id", "s", "section.section_id", F.posexplode("section.questions").alias("n", "q"))
    part = F.get(F.col("q.subparts"), F.lit(0))
    nested = F.coalesce(part["subparts"], F.array())
    many = q.filter(F.size(nested) >= 2).select("paper_id", "s", "n", "section_id", "q.question_number", F.posexplode(nested).alias("p", "x"))
    many = many.select("paper_id", "section_id", F.concat("question_number", F.lit("_"), F.coalesce("x.label", F.char(F.col("p") + 97))).alias("question_number"), F.col("x.text").alias("raw_text"), F.col("x.options").alias("options"))
    one = q.filter(F.coalesce(F.size(nested), F.lit(0)) < 2).select("paper_id", "section_id", "q.question_number", F.coalesce(F.nullif(F.trim(part["text"]), F.lit("")), "q.stem_text").alias("raw_text"), part["options"].alias("options"))
    return one.unionByName(many)


def markdown(blocks: DataFrame) -> DataFrame:
    """paper_id, markdown of blocks (paper_id, page_num, text, x0, y0): pages in order, rows in bands of twelve points, sections and questions tagged."""
    t = F.trim("text")
    tagged = F.when(t.rlike(r"(?i)^(section|part)\b"), F.concat(F.lit("# "), t)).when(t.rlike(r"(?i)^(q\.?\s*)?\d{1,3}[.)]\s"), F.concat(F.lit("## "), t)).otherwise(t)
    band, x = row_bands()
    line = F.struct(band.alias("band"), x.alias("x"), tagged.alias("text"))
    page = blocks.filter(t != "").groupBy("paper_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda b: b["text"]), "\n").alias("body"))
    marked = F.struct("page_num", F.concat(F.format_string("<!-- page %d -->\n", "page_num"), F.col("body")).alias("body"))
    return page.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(marked)), lambda p: p["body"]), "\n\n").alias("markdown"))


def superscripts(spans: DataFrame, line: list[str], order: str) -> DataFrame:
    """Adds `raised`: a span smaller than 90 % of its line's largest, close behind a span of at least 92 % of it, and more than two points higher."""
    w, whole = W.partitionBy(*line).orderBy(order), W.partitionBy(*line)
    most = F.max("size").over(whole)
    before = F.lag(F.struct("size", "x1", "y1")).over(w)
    raised = (F.col("size") < 0.90 * most) & (before["size"] >= 0.92 * most) & (F.col("x0") - before["x1"] <= 3) & (before["y1"] - F.col("y1") > 2)
    return spans.withColumn("raised", F.coalesce(raised, F.lit(False)))


def attached_orphans(chunks: DataFrame, paper: str, order: str, orphan: Column) -> DataFrame:
    """A chunk of options alone gives them to the chunk before it, if that has none, and goes."""
    after = W.partitionBy(paper).orderBy(order)
    marked = chunks.withColumn("_orphan", orphan)
    taken = F.lead(F.when(F.col("_orphan"), F.col("options"))).over(after)
    return marked.withColumn("options", F.when(F.size("options") == 0, F.coalesce(taken, "options")).otherwise(F.col("options"))).filter(~F.col("_orphan")).drop("_orphan")


def finalised(questions: DataFrame) -> DataFrame:
    """Options or parts, never both; a following section's or question's heading cut off; too short ones aren't valid."""
    clean = F.trim(F.regexp_replace("raw_text", r"(?is)\n\s*(?:section|part)\s+[A-E]\b.*$", ""))
    parts = F.when(F.size("options") >= 2, F.array().cast("array<string>")).otherwise(F.col("subparts"))
    return questions.withColumn("raw_text", clean).withColumn("subparts", parts).withColumn("has_subparts", F.size("subparts") > 0).withColumn("is_valid", F.length("raw_text") > 15)


def kept_parts(parts: Column, shortest: int = 15, same: int = 80) -> Column:
    """An array of texts without footers, without those under 15 characters, and the first of each 80-character beginning."""
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?i)\n?\s*page\s+\d+(\s+of\s+\d+)?\s*$", "")))
    long = F.filter(clean, lambda p: F.length(p) >= shortest)
    heads = F.transform(long, lambda p: F.substring(p, 1, same))
    return F.filter(long, lambda p, i: F.array_position(heads, F.substring(p, 1, same)) == i + 1)


def folded_reasons(lines: Column) -> Column:
    """Lines of an assertion and reason question: a line that opens with Reason joins the one before it."""
    step = lambda out, x: F.when(x.rlike(r"(?i)^\s*reason\b") & (F.size(out) > 0), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws("\n", F.element_at(out, -1), x)))).otherwise(F.concat(out, F.array(x)))
    return F.aggregate(lines, F.array().cast("array<string>"), step)
