"""From lines to questions: segmentation, options, classification, validation, audit and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X

NUMBERED = r"(?i)^\s*(?:<b>)?\s*(?:Q\.?\s*(\d{1,3})[.:]|Question\s+(\d{1,3})[.:])"
LISTED = r"^\s*(?:<b>)?\s*(\d{1,3})(?:[.,:](?:[a-zA-Z]\.)?\s+|\)\s+|(?=\s+[A-Z(]))"
BARE = r"^\s*(\d{1,2})\s*$"
OPTION = r"(?<![A-Za-z])(?:\(([A-Da-d1-4])\)|\b([A-Da-d1-4])[).:])\s*"
#: Pages and blocks as a layout scan gives them.
PAGES = "paper_id string, pages array<struct<page_num int, width double, height double, blocks array<struct<type string, bbox array<double>, lines array<struct<bbox array<double>, text string>>>>>>"


def contains_any(text: Column, found: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in found))


def flat_lines(papers: DataFrame) -> DataFrame:
    """One row per line of the text blocks, in order: paper_id, page_num, width, seq, text, x0, y0, x1, y1. Blank lines are left out."""
    page = papers.select("paper_id", F.posexplode("pages").alias("p", "page"))
    block = page.select("paper_id", "p", "page.page_num", "page.width", F.posexplode("page.blocks").alias("b", "block")).filter("block.type = 'text'")
    line = block.select("paper_id", "page_num", "width", "p", "b", F.posexplode("block.lines").alias("l", "line")).filter(F.trim("line.text") != "")
    at = W.partitionBy("paper_id").orderBy("p", "b", "l")
    return line.select("paper_id", "page_num", "width", F.row_number().over(at).alias("seq"), F.trim("line.text").alias("text"), *(F.get("line.bbox", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def number_of(lines: DataFrame, group: str, seq: str, text: str = "text", left: str | None = None) -> DataFrame:
    """Adds `number`: the question number that a line opens with, if any. A number alone counts if a line that is more than a label follows."""
    t = F.col(text)
    labelled = F.coalesce(*(F.nullif(F.regexp_extract(t, NUMBERED, i), F.lit("")) for i in (1, 2)))
    listed = F.when(~t.rlike(r"^[A-D]\.$") & (t.rlike(r"^\d{1,3}[.)]") | (F.col(left) < 85 if left else F.lit(True))), F.nullif(F.regexp_extract(t, LISTED, 1), F.lit("")))
    after = F.lead(text).over(W.partitionBy(group).orderBy(seq))
    alone = F.when((F.length(after) > 5) & ~after.startswith("Page") & ~after.startswith("Marks"), F.nullif(F.regexp_extract(t, BARE, 1), F.lit("")))
    return lines.withColumn("number", F.coalesce(labelled, listed, alone).try_cast("int")).withColumn("number", F.when(F.col("number").between(1, 200), F.col("number")))


def accepted(rows: DataFrame, group: str, seq: str, number: str) -> DataFrame:
    """`group`, and `taken`: the (seq, number) that open a question. A number is taken after `last` if last < n <= last + 15, or if it
    is 1 and last > 5; what counts as last are the taken ones only, so this is a fold over the group's ordered candidates."""
    found = F.array_sort(F.collect_list(F.when(F.col(number).isNotNull(), F.struct(F.col(seq).cast("bigint").alias("seq"), F.col(number).cast("bigint").alias("number")))))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<struct<seq:bigint,number:bigint>>").alias("taken"))

    def step(state: Column, x: Column) -> Column:
        last, n = state["last"], x["number"]
        ok = last.isNull() | ((last < n) & (n <= last + 15)) | ((n == 1) & (last > 5))
        return F.struct(F.when(ok, n).otherwise(last).alias("last"), F.when(ok, F.concat(state["taken"], F.array(x))).otherwise(state["taken"]).alias("taken"))

    return rows.groupBy(group).agg(F.aggregate(found, start, step)["taken"].alias("taken"))


def blocks(lines: DataFrame, group: str, seq: str, starts: Column, *, key: str = "block") -> DataFrame:
    """Adds the number of the block that a line belongs to: how many starts came up to it (gaps and islands)."""
    w = W.partitionBy(group).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn(key, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def carried(lines: DataFrame, group: str, seq: str, value: Column, to: str) -> DataFrame:
    """The last non-null value up to each line."""
    return lines.withColumn(to, F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)))


def segmented(papers: DataFrame) -> DataFrame:
    """Questions of layout pages: paper_id, question_number, page_num, raw_text, bounding_box, of at least ten characters."""
    lines = flat_lines(papers).filter(~X.noise_line(F.col("text"))).withColumn("margin", F.col("x0") > F.col("width") - 90)
    numbered = number_of(lines, "paper_id", "seq", left="x0").withColumn("number", F.when(~F.col("margin"), F.col("number")))
    taken = accepted(numbered, "paper_id", "seq", "number").select("paper_id", F.explode("taken").alias("t")).select("paper_id", F.col("t.seq").cast("int").alias("seq"), F.col("t.number").cast("int").alias("question_number"))
    marked = numbered.join(taken, ["paper_id", "seq"], "left")
    held = blocks(marked, "paper_id", "seq", F.col("question_number").isNotNull()).filter("block > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    box = F.array(F.round(F.min("x0"), 2), F.round(F.min("y0"), 2), F.round(F.max("x1"), 2), F.round(F.max("y1"), 2))
    out = held.groupBy("paper_id", "block").agg(F.max("question_number").alias("question_number"), F.min("page_num").alias("page_num"), text.alias("raw_text"), box.alias("bounding_box"))
    return out.filter(F.length("raw_text") >= 10).select("paper_id", "question_number", "page_num", "raw_text", "bounding_box")


def ocr_lines(words: DataFrame, *group: str) -> DataFrame:
    """Words of a scan (text, conf, x0, y0, x1, y1, seq) become lines: joined in order, with the box around them."""
    good = words.filter((F.trim("text") != "") & (F.col("conf").try_cast("double") >= 20))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return good.groupBy(*group).agg(text.alias("text"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")))


def reading_order(lines: DataFrame, width: str = "width") -> list[Column]:
    """Left column before right, from the top."""
    return [F.when(F.col("x0") < F.col(width) / 2, 0).otherwise(1), F.col("y0")]


def row_bands(y: str = "y0", x: str = "x0", band: int = 12) -> list[Column]:
    return [F.bround(F.col(y) / band) * band, F.col(x)]


def merged_runs(lines: Column, longest: int = 3) -> Column:
    """An array of lines in which runs of two or more lines of up to `longest` characters are one line."""
    short = lambda x: F.length(F.trim(x)) <= longest
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))

    def step(s: Column, x: Column) -> Column:
        closed = F.when(s["run"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["run"])))
        return F.when(short(x), F.struct(s["out"].alias("out"), F.concat_ws(" ", F.nullif(s["run"], F.lit("")), x).alias("run"))).otherwise(F.struct(F.concat(closed, F.array(x)).alias("out"), F.lit("").alias("run")))

    return F.aggregate(lines, start, step, lambda s: F.when(s["run"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["run"]))))


def options(text: Column) -> Column:
    """Options A to D of a text as (label, text), the first of each label; 1 to 4 count as A to D. What precedes the first label isn't an option."""
    marked = F.regexp_replace(text, OPTION, "\u0001$1$2\u0002")
    parts = F.slice(F.split(marked, "\u0001"), 2, 1000)
    made = F.transform(parts, lambda p: F.struct(F.translate(F.upper(F.substring_index(p, "\u0002", 1)), "1234", "ABCD").alias("label"), option_text(F.substring_index(p, "\u0002", -1)).alias("text")))
    return F.filter(F.filter(made, lambda o: o["text"] != ""), lambda o, i: F.array_position(F.transform(F.filter(made, lambda m: m["text"] != ""), lambda m: m["label"]), o["label"]) == i + 1)


def option_text(value: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(value, r"[\x{FFFC}\x{FFFD}\x{E000}-\x{F8FF}]", ""), r"\s+", " ")
    return F.regexp_replace(clean, r"^[ ;,]+|[ ;,]+$", "")


def stem(text: Column) -> Column:
    return F.regexp_replace(F.get(F.split(F.regexp_replace(text, OPTION, "\u0001"), "\u0001"), F.lit(0)), r"^\s+|\s+$", "")


def question_type(text: Column, n_options: Column) -> Column:
    """Nine types, the first rule that holds."""
    t = F.lower(text)
    has = lambda *x: contains_any(t, x)
    return (
        F.when(has("assertion") & has("reason"), "assertion_reason")
        .when(has("read the following", "case study", "passage", "based on the above"), "case_study_passage")
        .when(has("match") & has("column", "list"), "match_the_following")
        .when(F.contains(text, F.lit("_______")) | has("fill in the blank"), "fill_in_the_blank")
        .when(has("true or false", "state whether true"), "true_false")
        .when(n_options >= 2, "single_choice_mcq")
        .when(has("calculate the value", "find the magnitude", "numerical value"), "numeric_answer")
        .when(has("prove that", "derive", "explain in detail", "describe the mechanism"), "long_answer")
        .otherwise("short_answer")
    )


def names_image(text: Column) -> Column:
    return contains_any(F.lower(text), ("the figure", "in the diagram", "shown below", "the graph", "circuit diagram", "see figure", "refer to figure", "in fig"))


def classified(rows: DataFrame, text: str = "text", n_options: str = "n_options", n_images: str = "n_images") -> DataFrame:
    """Adds question_type, requires_image, missing_image_reference, requires_table_data and confidence."""
    kind, named = question_type(F.col(text), F.col(n_options)), names_image(F.col(text))
    rows = rows.withColumn("question_type", kind).withColumn("missing_image_reference", named & (F.col(n_images) == 0)).withColumn("requires_image", named | (F.col(n_images) > 0))
    q, n = F.col("question_type"), F.col(n_options)
    low = F.col("missing_image_reference") | ((q == "assertion_reason") & (n != 4))
    return rows.withColumn("requires_table_data", q == "match_the_following").withColumn("confidence", F.when(low, "low").when((q == "single_choice_mcq") & (n < 4), "medium").otherwise("high"))


def issues_of(text: Column, n_options: Column, n_images: Column) -> Column:
    """What the validation of a classified row finds, as an array of (issue, severity)."""
    q, n = F.col("question_type"), n_options
    made = lambda when, issue, severity: F.when(when, F.struct(issue.alias("issue"), F.lit(severity).alias("severity")))
    return F.array_compact(F.array(
        made((q == "assertion_reason") & (n != 4), F.format_string("assertion_reason question has %d options, expected exactly 4", n), "critical"),
        made((q == "assertion_reason") & ~F.contains(F.lower(text), F.lit("assertion")), F.lit("classified as assertion_reason but no 'Assertion' text found in stem"), "critical"),
        made(F.col("requires_image") & (n_images == 0), F.lit("question references a figure/diagram but has no image_placeholder attached"), "critical"),
        made(F.col("missing_image_reference"), F.lit("text references a figure/diagram but no image was detected nearby in source PDF"), "critical"),
        made((q == "single_choice_mcq") & (n < 2), F.format_string("single_choice_mcq has only %d options (expected at least 2)", n), "critical"),
        made((q == "true_false") & (n > 0) & (n != 2), F.format_string("true_false has %d options array (expected 2)", n), "minor"),
        made(q == "match_the_following", F.lit("match_the_following question has no structured column table_data"), "minor"),
    ))


def issues(rows: DataFrame, key: str, text: str = "text", n_options: str = "n_options", n_images: str = "n_images") -> DataFrame:
    """`key`, issue, severity: what the validation of classified rows finds, and stems that are too short."""
    short = F.when(F.length(F.trim(F.col(text))) < 15, F.array(F.struct(F.lit("stem is shorter than 15 characters").alias("issue"), F.lit("critical").alias("severity"))))
    found = F.concat(issues_of(F.col(text), F.col(n_options), F.col(n_images)), F.coalesce(short, F.array().cast("array<struct<issue:string,severity:string>>")))
    return rows.select(key, F.explode(found).alias("i")).select(key, "i.issue", "i.severity")


def rolled_up(found: DataFrame, key: str) -> DataFrame:
    """`key`, confidence, reason: any critical issue makes low, any other medium; the messages of that rank in order."""
    at = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col("issue")) if s else F.col("issue"))), "; ")
    critical = F.bool_or(F.col("severity") == "critical")
    return found.groupBy(key).agg(F.when(critical, "low").otherwise("medium").alias("confidence"), F.when(critical, at("critical")).otherwise(at(None)).alias("reason"))


def missing(expected: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """What should be there and isn't."""
    return expected.select(*key).distinct().join(found.select(*key).distinct(), [*key], "left_anti")


def reconciled(span: Column, assigned: Column) -> Column:
    """Placeholders: those assigned, then those of the source that weren't."""
    return F.array_union(assigned, F.array_except(X.placeholders(span), assigned))


def chunk_subject(section: Column, number: Column, subject: Column, school: Column) -> Column:
    s, q = F.upper(section), X.digits(number, 0)
    has = lambda *x: contains_any(s, x)
    entrance = F.coalesce(F.contains(F.lower(school), F.lit("navodaya")), F.lit(False)) | has("PART")
    return F.when(has("MENTAL", "REASONING") | (entrance & q.between(1, 40)), "mental_ability").when(has("ARITHMETIC", "MATH") | (entrance & q.between(41, 60)), "mathematics").when(has("LANGUAGE", "ENGLISH") | (entrance & (q >= 61)), "english").when(has("SCIENCE"), "science").otherwise(subject)


def difficulty(n_options: Column, raw: Column, has_subparts: Column) -> Column:
    return F.when(n_options > 0, "easy").when((F.length(raw) > 300) | has_subparts, "hard").otherwise("medium")


def fixed_section(number: Column) -> Column:
    return F.when(number.between(1, 15), "LOGICALREASONING").when(number.between(16, 35), "MATHEMATICALREASONING").when(number.between(36, 45), "EVERYDAYMATHEMATICS").when(number.between(46, 50), "ACHIEVERSSECTION").otherwise("UNKNOWN")


def chunked(questions: DataFrame) -> DataFrame:
    """Valid questions (paper_id, question_id, question_number, section, subject, school, raw_text, options, subparts, images) as chunks."""
    usable = questions.filter(F.coalesce("is_valid", F.lit(True)) & ((F.trim(F.coalesce("raw_text", F.lit(""))) != "") | (F.size(F.coalesce("options", F.array())) > 0)))
    n = F.size(F.coalesce("options", F.array().cast("array<string>")))
    parts = F.size(F.coalesce("subparts", F.array().cast("array<string>"))) > 0
    body = X.without_instructions(F.col("raw_text"))
    listed = F.when(n > 0, F.concat(F.lit("\nOptions:\n"), F.array_join("options", "\n")))
    rows = usable.withColumn("subject", chunk_subject(F.coalesce("section", F.lit("")), F.col("question_number"), F.col("subject"), F.col("school"))).withColumn("has_images", F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0)
    kind = F.when(F.col("has_images") & (F.col("subject") == "mental_ability"), "diagram").when(n > 0, "mcq").otherwise("short_answer")
    return rows.select(F.concat_ws("_", "paper_id", "question_id").alias("chunk_id"), "paper_id", "question_id", "subject", F.concat_ws("\n\n", body, listed).alias("content"), kind.alias("question_type"), difficulty(n, F.col("raw_text"), parts).alias("difficulty"), "has_images")


def sections(markdown: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown as `key`, section, question_number, marks, body: `#` opens sections, `##` questions; marks in [n] or (n marks), 1 by default."""
    part = markdown.select(key, F.posexplode(F.split(text, r"(?m)^# ")).alias("s", "part")).filter("s > 0")
    question = part.select(key, "s", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("section"), F.posexplode(F.split("part", r"(?m)^## ")).alias("q", "body")).filter("q > 0")
    marks = F.coalesce(F.nullif(F.regexp_extract("body", r"(?i)[\[(](\d+)(?:\s*marks?)?[\])]", 1), F.lit("")).try_cast("int"), F.lit(1))
    return question.select(key, "section", F.col("q").alias("position"), F.coalesce(F.nullif(F.regexp_extract("body", r"^[^\n\d]*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("question_number"), marks.alias("marks"), F.trim("body").alias("body"))


def alternatives(body: Column) -> Column:
    """A question and its alternatives: the parts between lines that only say OR."""
    return F.transform(F.split(body, r"(?mi)^\s*\[?or\]?\s*$"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def subparts(body: Column) -> Column:
    """The parts that open with (a) to (e) or a roman number in brackets."""
    return F.transform(F.slice(F.split(F.regexp_replace(body, r"(?m)^\s*(?=\((?:[a-e]|i{1,3}|iv|v)\)\s)", "\u0001"), "\u0001"), 2, 1000), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def block_order(number: str = "question_number", page: str = "page_num", y: str = "y0") -> list[Column]:
    """By number, page and place on it."""
    return [F.col(number), F.col(page), F.col(y)]


def all_distinct(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def by_page(questions: DataFrame, paper: str = "paper_id", page: str = "page_num", number: str = "question_number") -> DataFrame:
    """`paper`, `page` and the numbers of its questions in order."""
    return questions.groupBy(paper, page).agg(F.array_sort(F.collect_list(number)).alias("numbers"))
