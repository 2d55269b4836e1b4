"""Where rows come from and go to: stage files, catalogues, uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X


def stage_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON object per file, below class/subject/year/paper; those four come from the path."""
    read = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("_path", F.col("_metadata.file_path"))
    parts = F.split("_path", "/")
    return read.select("*", *(F.element_at(parts, -5 + i).alias(name) for i, name in enumerate(("class_level", "subject", "year", "paper_id")))).drop("_path")


def write_stage(rows: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def uploads(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Uploaded files that aren't empty, with an id made of their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.filter(F.col("length") > 0).select("path", "length", "modificationTime", F.md5("content").alias("paper_id"))


def new_papers(seen: DataFrame, registry: DataFrame) -> DataFrame:
    """Papers that aren't registered as embedded yet."""
    done = registry.filter(F.col("phase_status")["embed"] == "done").select("paper_id")
    return seen.join(done, "paper_id", "left_anti")


def paper_ids(class_: Column, subject: Column, year: Column, name: Column) -> dict[str, Column]:
    """The ways that papers are named by: sha256 over `_`, md5 over `|`, and sha256 cut to 16."""
    under, bar = F.concat_ws("_", class_, subject, year, name), F.concat_ws("|", class_, subject, year, name)
    return {"sha_id": F.sha2(under, 256), "md5_id": F.md5(bar), "short_id": F.substring(F.sha2(under, 256), 1, 16)}


def scan_kind(pages: DataFrame, paper: str = "paper_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """native if the first three pages have more than 200 characters on average, else scanned."""
    mean = F.avg(F.length(F.trim(text)))
    return pages.filter(F.col(page) <= 3).groupBy(paper).agg(F.when(mean > 200, "native").otherwise("scanned").alias("kind"))


def spans(papers: DataFrame) -> DataFrame:
    """Flat text spans of nested pages, bold if bit 4 of the flags or the font's name says so."""
    p = papers.select("paper_id", F.explode("pages").alias("p"))
    b = p.select("paper_id", F.col("p.page_num").alias("page"), F.explode("p.blocks").alias("b"))
    s = b.select("paper_id", "page", F.explode("b.lines").alias("l")).select("paper_id", "page", F.explode("l.spans").alias("s"))
    bold = (F.col("s.flags").bitwiseAND(F.lit(16)) != 0) | F.lower("s.font").rlike("bold|heavy")
    return s.select("paper_id", "page", F.col("s.text").alias("text"), F.col("s.size").alias("size"), bold.alias("bold"))


def parse_status(text: Column) -> Column:
    """What becomes of a parsed paper: fewer than 50 characters go to OCR, other scripts are skipped."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "skipped_no_text").when(n < 50, "needs_ocr").when(~X.english_dominant(text), "skipped_non_english").otherwise("parsed")


def hooked(rows: DataFrame, schema: str, hook: Callable | None, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scans and models from outside (PDF, OCR, language models) as a function over Arrow batches; without one, the fallback."""
    return fallback(rows) if hook is None else rows.mapInArrow(hook, schema)
