"""From files to papers in the index: validity, layout, scans, whole-paper runs, generated papers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import sources
from quire.functions import parts as P
from quire.functions import text as X
from quire.operators import questions as Q
from quire.operators import serving, state, synth

PAGE_CHARS = 80


def pdf_validity(files: DataFrame) -> DataFrame:
    """path, is_valid, reason, page_count of files (path, length, content; a file that isn't there has null content). Only the file's own
    marks are read: nothing is rendered."""
    raw = F.decode("content", "ISO-8859-1")
    pages = F.regexp_count(raw, F.lit(r"/Type\s*/Page(?![A-Za-z])")).cast("int")
    reason = (
        F.when(F.col("content").isNull(), F.concat(F.lit("File does not exist: "), "path"))
        .when(F.coalesce("length", F.length("content")) == 0, F.concat(F.lit("File is zero bytes: "), "path"))
        .when(~raw.startswith("%PDF-"), "Corrupted or invalid PDF: no header")
        .when(F.contains(raw, F.lit("/Encrypt")), "PDF is password-protected/encrypted")
        .when(pages == 0, "PDF has 0 pages")
        .otherwise("OK")
    )
    rows = files.select("path", reason.alias("reason"), pages.alias("_n"))
    return rows.select("path", (F.col("reason") == "OK").alias("is_valid"), "reason", F.when(F.col("reason") == "OK", F.col("_n")).otherwise(0).alias("page_count"))


UPLOAD_SUFFIX, UNKNOWN_YEAR = ".pdf", "2024-2025"


def uploaded(files: DataFrame) -> DataFrame:
    """Uploads (filename, content, class_level, subject, year, school) as registry rows: PDF files that aren't empty, with normal names and an
    id made of the content."""
    name = F.element_at(F.split(F.regexp_replace("filename", r"\\", "/"), "/"), -1)
    good = files.filter(F.endswith(F.lower(F.col("filename")), F.lit(UPLOAD_SUFFIX)) & (F.length("content") > 0))
    subject = F.regexp_replace(F.lower(F.trim("subject")), r"\s+", "_")
    year = F.coalesce(F.nullif(F.trim("year"), F.lit("")), F.lit(UNKNOWN_YEAR))
    return good.select(F.md5("content").alias("paper_id"), F.trim("class_level").alias("class_level"), subject.alias("subject"), year.alias("year"), name.alias("filename"), serving.tenant_of(F.col("school")).alias("school_slug"), F.create_map(F.lit("parse"), F.lit("pending")).alias("phase_status"))


# ---- pages


def scan_modes(pages: DataFrame, paper: str = "paper_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """`paper`, `page`, native_chars, mode: pages with fewer than PAGE_CHARS characters go to OCR."""
    n = F.sum(F.length(F.trim(F.coalesce(text, F.lit("")))))
    return pages.groupBy(paper, page).agg(n.alias("native_chars")).withColumn("mode", F.when(F.col("native_chars") < PAGE_CHARS, "ocr").otherwise("native"))


def visible_chars(rows: DataFrame, by: str, text: str) -> DataFrame:
    """`by`, chars: characters that aren't white space."""
    return rows.groupBy(by).agg(F.coalesce(F.sum(X.visible_length(F.col(text))), F.lit(0)).alias("chars"))


GUTTER, DENSE = 20, 25


def two_columns(lines: DataFrame, paper: str = "paper_id", page: str = "page_num", width: str = "width") -> DataFrame:
    """`paper`, `page`, two_columns: whether fewer than GUTTER characters stand across the middle and more than DENSE on both sides.
    It stands in for a projection of pixels: characters count where their line lies."""
    n, middle = F.length(F.trim("text")), F.col(width) / 2
    side = F.when(F.col("x1") <= middle, "left").when(F.col("x0") >= middle, "right").otherwise("across")
    at = lambda s: F.coalesce(F.sum(F.when(side == s, n)), F.lit(0))
    return lines.groupBy(paper, page).agg(((at("across") < GUTTER) & (at("left") > DENSE) & (at("right") > DENSE)).alias("two_columns"))


def in_page_points(lines: DataFrame, scale: float = 0.5, offset: Column | None = None) -> DataFrame:
    """Boxes of a scan, read at twice the size, in points of the page; offset: what a column's left edge adds."""
    right = F.lit(0.0) if offset is None else offset
    return lines.withColumns({c: F.round(F.col(c) * scale + (right if c[0] == "x" else 0.0), 2) for c in ("x0", "y0", "x1", "y1")})


def visual_page(text: Column) -> Column:
    """Whether a page's top names a part by number or mental ability."""
    return F.coalesce(text.rlike(r"(?i)PART\s*[\-\:]*\s*\d+") | text.rlike(r"(?i)MENTAL\s+ABILITY"), F.lit(False))


VISUAL_WORDS = ("the figure", "in the diagram", "shown below", "the graph", "circuit diagram", "refer to figure", "in fig", "bar chart")


def visual_question(text: Column, section: Column) -> Column:
    """Whether a question without a picture should have its place on the page cut out."""
    s = F.upper(F.coalesce(section, F.lit("")))
    return Q.contains_any(F.lower(F.coalesce(text, F.lit(""))), VISUAL_WORDS) | F.contains(s, F.lit("MENTAL")) | F.contains(s, F.lit("PART"))


def math_text(spans: DataFrame, line: list[str], order: str) -> DataFrame:
    """`line`, text: spans joined in order, raised ones of digits and signs as ^{...}."""
    from quire.operators.papers import superscripts

    compact = F.col("text").rlike(r"^\s*[0-9+\-−–=()]+\s*$")
    shown = F.when(F.col("raised") & compact, F.concat(F.lit("^{"), F.trim("text"), F.lit("}"))).otherwise(F.col("text"))
    return superscripts(spans, line, order).groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), shown.alias("t")))), lambda x: x["t"]), "").alias("text"))


# ---- runs over whole papers


def staged(papers: DataFrame) -> dict[str, DataFrame]:
    """All stages over all papers at once: questions, chunks, index rows, and a status row per paper (`done` with its number of chunks, or
    `no_questions`). papers: paper_id, class_level, subject, year, school, and pages as a layout scan gives them."""
    of = papers.select("paper_id", "class_level", "subject", "year", "school")
    found = Q.segmented(papers).withColumn("question_id", F.concat(F.lit("Q"), F.col("question_number").cast("string")))
    found = found.withColumns({"options": P.gated(F.col("raw_text"), F.lit("SECTIONA"), F.col("question_number").cast("string")), "subparts": serving.no_texts(), "images": serving.no_texts(), "section": F.lit("GENERAL"), "is_valid": F.length("raw_text") > 15})
    questions = found.join(F.broadcast(of) if _few(of) else of, "paper_id")
    questions = questions.withColumn("question_number", F.col("question_number").cast("string"))
    chunks = Q.chunked(questions).join(questions.select("paper_id", "question_id", "question_number", "section", "class_level", "year", "school", "options", "subparts"), ["paper_id", "question_id"]).withColumn("linked_images", serving.no_texts())
    n = chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"))
    status = of.select("paper_id").join(n, "paper_id", "left").select("paper_id", F.when(F.col("n_chunks") > 0, "done").otherwise("no_questions").alias("status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return {"questions": questions, "chunks": chunks, "index": serving.index_rows(chunks), "status": status}


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    return len(rows.select(F.lit(1)).limit(most + 1).collect()) <= most


def preview(chunks: DataFrame, paper: str = "paper_id", order: str = "question_id", n: int = 10) -> DataFrame:
    """The first n questions of each paper."""
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.col(order), "content"))), 1, n)
    return chunks.groupBy(paper).agg(first.alias("_f")).select(paper, F.posexplode("_f").alias("place", "_q")).select(paper, "place", f"_q.{order}", "_q.content")


STAGES = ("download", "parse", "segment", "link", "chunk", "embed", "dedup", "evaluate")


def due(registry: DataFrame, stage: str) -> DataFrame:
    """Papers that a stage has yet to do: it isn't done, and the stage before is."""
    at = STAGES.index(stage)
    rows = registry.filter(F.coalesce(F.col("phase_status")[stage], F.lit("pending")) != "done")
    return rows.filter(F.col("phase_status")[STAGES[at - 1]] == "done") if at else rows


def fetched(seeds: DataFrame, hook: Callable | None = None) -> DataFrame:
    """Files of a list of seeds (url, filename) by a hook over Arrow batches; without one nothing is fetched and each has a status that says so."""
    return sources.hooked(seeds, "url string, filename string, content binary, status string", hook, lambda rows: rows.select("url", "filename", F.lit(None).cast("binary").alias("content"), F.lit("not_fetched").alias("status")))


FIXTURE_SUBJECTS, FIXTURE_YEARS = ("mathematics", "science", "physics", "chemistry", "biology", "english"), ("2023-2024", "2024-2025")


def fixtures(spark: SparkSession, questions: int = 10) -> DataFrame:
    """Twelve synthetic papers, a subject and year each, as layout pages of ten numbered questions."""
    rows = spark.range(len(FIXTURE_SUBJECTS) * len(FIXTURE_YEARS)).select(F.col("id").cast("int").alias("i"))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    rows = rows.select(pick(FIXTURE_SUBJECTS, F.expr("i div 2").cast("int")).alias("subject"), pick(FIXTURE_YEARS, F.col("i") % 2).alias("year"), F.when(F.col("i") % 3 == 0, "12").otherwise("10").alias("class_level"))
    line = lambda n: F.struct(F.array(F.lit(50.0), n * 60.0, F.lit(400.0), n * 60.0 + 20.0).alias("bbox"), F.concat(n.cast("string"), F.lit(". Explain topic "), n.cast("string"), F.lit(" of "), "subject", F.lit(" in your own words")).alias("text"))
    block = F.struct(F.lit("text").alias("type"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.transform(F.sequence(F.lit(1), F.lit(questions)), line).alias("lines"))
    page = F.struct(F.lit(2).alias("page_num"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.array(block).alias("blocks"))
    return rows.select(F.md5(F.concat_ws("|", "class_level", "subject", "year")).alias("paper_id"), "class_level", "subject", "year", F.lit(None).cast("string").alias("school"), F.array(page).alias("pages"))


# ---- solutions and generated papers


def request_hash(text: str | None, options: list | None, parts: list | None, class_level: str | None, subject: str | None) -> str:
    """The sha256 of a request's canonical JSON: keys in order, ASCII, `", "` and `": "` between."""
    asked = {"question_text": text, "options": [*(options or [])], "subparts": [*(parts or [])], "class_level": class_level or "10", "subject": subject or "General Science/Maths"}
    return hashlib.sha256(json.dumps(asked, sort_keys=True, ensure_ascii=True, default=str).encode()).hexdigest()


def solution_key(text: Column, options: Column, parts: Column, class_level: Column, subject: Column) -> Column:
    return P.column(request_hash, "string", text, options, parts, class_level, subject)


def solved(requests: DataFrame, cache: DataFrame, hook: Callable | None = None, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """Requests (chunk_id, question_hash) with their solutions, from the cache (chunk_id, question_hash, prompt_version, solution_text) or the
    hook (Arrow batches to chunk_id, question_hash, solution_text), and what is new in the cache. Failures (null) are never cached."""
    asked = requests.withColumn("prompt_version", F.lit(version))
    hit, miss = state.cached(asked, cache, ["chunk_id", "question_hash", "prompt_version"])
    made = sources.hooked(miss.select("chunk_id", "question_hash"), "chunk_id string, question_hash string, solution_text string", hook, lambda rows: rows.withColumn("solution_text", F.lit(None).cast("string")))
    fresh = made.withColumn("prompt_version", F.lit(version))
    both = hit.select("chunk_id", "question_hash", "prompt_version", "solution_text", F.lit(True).alias("cache_hit")).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    return both, fresh.filter("solution_text is not null")


EXAMPLES = 8


def n_examples(count: int) -> int:
    """How many examples a paper of `count` questions looks at; 1 to 50 questions are allowed."""
    if not 1 <= count <= 50:
        raise ValueError("question_count must be between 1 and 50.")
    return min(EXAMPLES, 2 * count)


def paper(spark: SparkSession, pattern_id: str, school: str, class_level: str, subject: str, count: int, topic: str = "", seed: int = 1, at: str = "") -> DataFrame:
    """A generated paper's questions: paper_id, question_number, chunk_id, question_text, question_type, answer, question_hash. at: the time that
    makes the id one of its own."""
    n_examples(count)
    paper_id = hashlib.sha256(f"{pattern_id}:{school}:{at}".encode()).hexdigest()[:16]
    rows = synth.questions(spark, count, topic, seed).withColumn("question_text", P.without_tag(F.col("text")))
    key = solution_key(F.col("question_text"), serving.no_texts(), serving.no_texts(), F.lit(class_level), F.lit(subject))
    return rows.select(F.lit(paper_id).alias("paper_id"), F.format_string("Q%d", "number").alias("question_number"), F.concat(F.lit(f"{paper_id}_q"), F.col("number").cast("string")).alias("chunk_id"), "question_text", "question_type", "answer", key.alias("question_hash"))


def pattern_id(school: Column, name: Column, class_level: Column, subject: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.coalesce(school, F.lit("general")), name, class_level, subject), 256), 1, 16)


def relative_paths(json_text: Column) -> Column:
    """JSON text in which every absolute path is cut to what follows from data/ on."""
    return F.regexp_replace(json_text, r'"(?:[A-Za-z]:)?(?:\\\\|/)(?:[^"\\]|\\\\)*?(?:\\\\|/)?data(?:\\\\|/)([^"]*)"', '"data/$1"')


# ---- models from outside, each with its rule


def divided(rows: DataFrame, key: str, text: str, hook: Callable | None = None) -> DataFrame:
    """`key`, place, text: numbered blocks as single questions, by a model's hook (Arrow batches of `key` and text to `key`, items) and the
    clean-up of its answers, else by the rule."""
    kind = rows.schema[key].dataType.simpleString()
    by_rule = lambda df: df.select(key, P.column(P.split_block, "array<string>", F.col(text)).alias("items"))
    found = by_rule(rows) if hook is None else rows.select(key, text).mapInArrow(hook, f"{key} {kind}, items array<string>").select(key, P.column(P.kept_items, "array<string>", F.col("items")).alias("items"))
    return found.select(key, F.posexplode("items").alias("place", "text"))


def enhanced(rows: DataFrame, key: str, text: str, hook: Callable | None = None) -> DataFrame:
    """`key`, text: set in TeX by a model's hook (Arrow batches to `key`, text), else by the rules."""
    kind = rows.schema[key].dataType.simpleString()
    return sources.hooked(rows.select(key, text), f"{key} {kind}, text string", hook, lambda df: df.select(key, X.latex(F.col(text)).alias("text")))


def arranged(drafts: DataFrame, hook: Callable | None = None, most: int | None = None) -> DataFrame:
    """Questions that are flagged, arranged anew by a model's hook, the first `most` by paper and number; all others, and all without a hook,
    stay. drafts: paper_id, question_number, text, flagged."""
    if hook is None:
        return drafts
    flagged = drafts.filter("flagged").orderBy("paper_id", "question_number")
    flagged = flagged if most is None else flagged.limit(most)
    made = flagged.select("paper_id", "question_number", "text").mapInArrow(hook, "paper_id string, question_number string, text string").withColumnRenamed("text", "_new")
    return drafts.join(made, ["paper_id", "question_number"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def utc_now() -> Column:
    """The time of the query in UTC, as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
