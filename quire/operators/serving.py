"""From chunks to the index and back: index rows, tenants, figure links, search results as they are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import parts as P
from quire.functions import text as X
from quire.operators import search

GLOBAL = ("", "general", "none", "all", "global")
ALL_ROWS = 1000
LINK = "/static/parsed"


def no_texts() -> Column:
    return F.array().cast("array<string>")


def texts(column: Column) -> Column:
    """An array of strings, empty for null."""
    return F.coalesce(column, no_texts())


def coerced(text: Column) -> Column:
    """JSON text as an array of strings: a list as it is, another value as a list of one, what can't be read as an empty one."""
    listed = F.from_json(text, "array<string>")
    return F.when(text.rlike(r"(?s)^\s*\["), texts(listed)).when(text.rlike(r'(?s)^\s*"'), F.array(F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0)))).otherwise(no_texts())


# ---- index rows


def titled(text: Column) -> Column:
    """Every run of letters with a capital, as Python's title()."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def header_text(text: Column, options: Column, class_: Column, subject: Column, year: Column, section: Column, number: Column) -> Column:
    """What is embedded: a line of metadata, the text, and the options."""
    head = F.concat(F.lit("[Class: "), class_, F.lit(" | Subject: "), titled(subject), F.lit(" | Year: "), year, F.lit(" | Section: "), section, F.lit(" | "), number, F.lit("]"))
    listed = F.when(F.size(texts(options)) > 0, F.concat(F.lit("Options:\n"), F.array_join(options, "\n")))
    return F.concat_ws("\n\n", head, F.regexp_replace(text, r"^\s+|\s+$", ""), listed)


METADATA = {"question_type": "short_answer", "section": "GENERAL", "difficulty": "medium"}


def index_rows(chunks: DataFrame) -> DataFrame:
    """id, document, metadata of chunks: figures are named at the end of the document, metadata are text, lists are JSON; absent values have defaults."""
    linked = texts(F.col("linked_images"))
    document = F.when(F.size(linked) > 0, F.concat("content", F.lit("\n[Embedded Diagram Reference: "), F.array_join(linked, ", "), F.lit("]"))).otherwise(F.col("content"))
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(METADATA.get(c))).alias(c) for c in ("paper_id", "question_id", "question_number", "question_type", "class_level", "subject", "year", "section", "difficulty")]
    lists = [F.to_json(texts(F.col(c))).alias(c) for c in ("linked_images", "options", "subparts")]
    school = [F.col("school").cast("string").alias("school"), F.when(F.col("school").isNotNull(), X.slug(F.col("school"))).alias("school_slug")] if "school" in chunks.columns else []
    return chunks.select(F.col("chunk_id").alias("id"), document.alias("document"), F.struct(*plain, F.coalesce("has_images", F.lit(False)).alias("has_images"), *lists, *school).alias("metadata"))


def tenant_of(school: Column) -> Column:
    """The store a school's rows are in: its key, or null for the global store."""
    return F.when(F.lower(F.trim(F.coalesce(school, F.lit("")))).isin(*GLOBAL), None).otherwise(X.slug(school))


def of_store(rows: DataFrame, school: str | None, slug: str = "school_slug") -> DataFrame:
    """The rows of one tenant's store; the global store has all rows. The condition prunes partitions of a table partitioned by it."""
    name = (school or "").strip().lower()
    return rows if name in GLOBAL else rows.filter(F.col(slug) == X.slug(F.lit(school)))


def written_to_stores(rows: DataFrame, path: str, slug: str = "school_slug") -> None:
    """One write for the global store and every tenant's: rows are partitioned by tenant, those of none apart."""
    rows.withColumn(slug, F.coalesce(slug, F.lit("general"))).write.mode("append").partitionBy(slug).parquet(path)


def emptied(rows: DataFrame) -> DataFrame:
    """The table without rows, to overwrite it with."""
    return rows.limit(0)


def looked_up(levels: list[DataFrame], **keys) -> DataFrame:
    """The row of a key in the first level (tenant, then global) that has it."""
    held = None
    for i, rows in enumerate(levels):
        for name, value in keys.items():
            rows = rows.filter(F.col(name) == F.lit(value))
        rows = rows.withColumn("_level", F.lit(i))
        held = rows if held is None else held.unionByName(rows)
    return held.orderBy("_level").limit(1).drop("_level")


# ---- figure links


def file_name(reference: Column, of_manifest: Column) -> Column:
    """What the manifest names, else the last part of a path, else the reference itself; no quotes and brackets around."""
    name = F.coalesce(of_manifest, F.regexp_extract(F.trim(reference), r"([^/\\]*)$", 1))
    return F.regexp_replace(name, r"""^['"} ]+|['"} ]+$""", "")


def link(class_: Column, subject: Column, year: Column, paper: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(LINK), class_, subject, year, paper, F.lit("images"), name)


PLACE = ["class_level", "subject", "year", "paper_id"]


def figure_links(rows: DataFrame, key: str, manifest: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """`key`, image_urls of rows (`key`, class_level, subject, year, paper_id, linked_images), in the order of their references and
    each once. manifest: paper_id, placeholder, filename. files: the image files there are, by class_level, subject, year, paper_id,
    filename. registry: papers by where they were registered. A file is looked for at the row's place, at the registered one, at
    any place of its paper; failing those, the row's place is named."""
    ref = rows.select(key, *PLACE, F.posexplode(texts(F.col("linked_images"))).alias("n", "reference")).filter(F.trim("reference") != "")
    known = manifest.select("paper_id", F.col("placeholder").alias("reference"), F.col("filename").alias("listed")).dropDuplicates(["paper_id", "reference"])
    named = ref.withColumn("reference", F.trim("reference")).join(known, ["paper_id", "reference"], "left").withColumn("filename", file_name(F.col("reference"), F.col("listed")))
    there = files.select(*PLACE, "filename").distinct()
    base = registry.select("paper_id", *(F.col(c).alias(f"r_{c}") for c in PLACE[:3])).dropDuplicates(["paper_id"])
    anywhere = there.groupBy("paper_id", "filename").agg(F.min(F.struct(*PLACE[:3])).alias("any"))
    found = named.join(there.withColumn("here", F.lit(True)), [*PLACE, "filename"], "left").join(base, "paper_id", "left")
    found = found.join(there.select(*(F.col(c).alias(f"r_{c}") for c in PLACE[:3]), "paper_id", "filename", F.lit(True).alias("at_base")), [*(f"r_{c}" for c in PLACE[:3]), "paper_id", "filename"], "left").join(anywhere, ["paper_id", "filename"], "left")
    own, paper, name = link(*map(F.col, PLACE), F.col("filename")), F.col("paper_id"), F.col("filename")
    url = F.when(F.col("here"), own).when(F.col("at_base"), link(*(F.col(f"r_{c}") for c in PLACE[:3]), paper, name)).when(F.col("any").isNotNull(), link(*(F.col("any")[c] for c in PLACE[:3]), paper, name)).otherwise(own)
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", url.alias("u")))).alias("l"))
    return listed.select(key, F.array_distinct(F.transform("l", lambda x: x["u"])).alias("image_urls"))


def with_manifest_links(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows that need a picture and have none get all their paper's. A manifest is looked up once for all rows of its paper."""
    of_paper = manifest.groupBy("paper_id").agg(F.array_sort(F.collect_set("filename")).alias("_all"))
    both = rows.join(of_paper, "paper_id", "left")
    urls = F.transform(texts(F.col("_all")), lambda f: link(*map(F.col, PLACE), f))
    return both.withColumn("image_urls", F.when((F.size(texts(F.col("image_urls"))) == 0) & F.coalesce("requires_image", F.lit(False)), urls).otherwise(texts(F.col("image_urls")))).drop("_all")


# ---- search results


NO_STEM = "Refer to the linked diagram figure below to answer this question."


def served(hits: DataFrame) -> DataFrame:
    """Hits as they are shown. hits: document, question_number, question_type, options, subparts and linked_images (texts), image_urls,
    requires_image, and further columns. Adds content, stem_text, latex_stem, structured options, subparts (none beside options),
    is_diagram; a question type is assertion_reason, else single_choice_mcq where there are options, else what it was."""
    content = P.repaired(F.col("document"), F.col("question_number"))
    rows = hits.withColumn("stored_type", F.col("question_type")).withColumn("content", content).withColumn("is_ar", P.assertion(F.col("content"), F.col("stored_type")))
    given = F.size(texts(F.col("options"))) > 0
    fixed = F.array(*(F.concat(F.lit(f"({x}) "), F.lit(t)) for x, t in zip("ABCD", P.ASSERTION_CHOICES, strict=True)))
    read = F.transform(options_in(F.col("content")), lambda o: F.concat(F.lit("("), o["label"], F.lit(") "), o["text"]))
    rows = rows.withColumn("shown_options", P.structured(F.when(given, F.col("options")).when(F.col("is_ar"), fixed).otherwise(read)))
    rows = rows.withColumn("_p", P.parted(F.col("content"), F.transform("shown_options", lambda o: o["text"]), texts(F.col("subparts"))))
    named = F.array_union(texts(F.col("linked_images")), X.placeholders(F.col("content")))
    urls = texts(F.col("image_urls"))
    needs = F.coalesce("requires_image", F.lit(False))
    stem = F.col("_p.stem")
    mentions = F.contains(F.lower(stem), F.lit("figure")) | F.contains(F.lower(stem), F.lit("diagram"))
    rows = rows.withColumn("is_diagram", (F.coalesce("stored_type", F.lit("")) == "diagram_based") | needs | (F.size(urls) > 0) | (F.size(named) > 0) | mentions | F.contains("content", F.lit("[IMAGE_PLACEHOLDER")))
    rows = rows.withColumn("_s", F.when((stem == "") & ((F.size(urls) > 0) | needs), F.lit(NO_STEM)).otherwise(stem))
    rows = rows.withColumn("_f", F.when(F.col("is_ar"), P.with_reason(F.col("_s"), F.col("_p.parts"))).otherwise(F.struct(F.col("_s").alias("stem"), F.col("_p.parts").alias("parts"))))
    several = F.size("shown_options") > 0
    kind = F.when(F.col("is_ar"), "assertion_reason").when(several, "single_choice_mcq").otherwise(F.coalesce(F.nullif("stored_type", F.lit("")), F.lit("short_answer")))
    rows = rows.withColumn("question_type", kind).withColumn("stem_text", F.col("_f.stem")).withColumn("latex_stem", X.latex(F.col("_f.stem")))
    rows = rows.withColumn("subparts", F.when(several, no_texts()).otherwise(F.transform("_f.parts", X.latex))).withColumn("options", F.col("shown_options"))
    return rows.withColumn("requires_image", needs | (F.size(urls) > 0)).withColumn("image_urls", urls).drop("_p", "_s", "_f", "is_ar", "shown_options", "document")


def options_in(text: Column) -> Column:
    from quire.operators.questions import options

    return options(text)


def of_type(rows: DataFrame, kind: str | None) -> DataFrame:
    """Served rows of a type: as shown or as stored; diagrams by what makes one; None and "all" ask for nothing."""
    if not kind or kind == "all":
        return rows
    return rows.filter(F.col("is_diagram") if kind == "diagram_based" else (F.col("question_type") == kind) | (F.col("stored_type") == kind))


def page_of(rows: DataFrame, page: int = 1, page_size: int = 10, top_k: int | None = None) -> tuple[int, int, int, int]:
    """page, page_size, total and pages, as asked for: -1 or from 1000 on is all; top_k takes the place of the usual size; pages outside are clamped."""
    total = rows.count()
    size = (total or 10) if page_size == -1 or page_size >= ALL_ROWS else top_k if top_k and top_k > 0 and page_size == 10 else max(1, page_size)
    pages = -(-total // size) if total else 1
    return max(1, min(page, pages)), size, total, pages


def endpoint(chunks: DataFrame, query: str, *, key: str = "chunk_id", text: str = "document", page: int = 1, page_size: int = 10, top_k: int | None = None, type_filter: str | None = None, school: str | None = None, random: bool = False, seed: int = 0, **equal: str | None) -> tuple[DataFrame, dict]:
    """A page of search results with their place, and the numbers beside it. A blank query gives rows in a random order (by a hash with the
    seed). Types are filtered after search and before paging, so results are formatted late only where no type is asked for."""
    kept = of_store(chunks, school) if "school_slug" in chunks.columns else chunks
    query = (query or "").strip()
    if random or not query:
        place = kept.select(key, F.xxhash64(F.col(key), F.lit(seed)).alias("_place"), F.lit(10_000).cast("bigint").alias("bp"))
        order = [F.col("_place"), F.col(key)]
        found = search.where(kept, **equal).join(place, key)
    else:
        ranked = search.hybrid(kept, query, None, key, text, **equal)
        order = [F.desc("rrf"), F.desc("bp"), F.col("dense_rank")]
        found = search.where(kept, **equal).join(ranked.select(key, "bp", "rrf", "dense_rank"), key)
    rows = found.withColumnRenamed(text, "document") if text != "document" else found
    rows = of_type(served(rows), type_filter) if type_filter and type_filter != "all" else rows
    number, size, total, pages = page_of(rows, page, page_size, top_k)
    cut = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    cut = cut.withColumn("place", F.row_number().over(W.orderBy(*order)) + (number - 1) * size)  # a page
    cut = cut if type_filter and type_filter != "all" else served(cut)
    return cut.withColumn("similarity", F.bround(F.col("bp") / 10_000, 4)), {"query": query, "page": number, "page_size": size, "total_results": total, "total_pages": pages, "is_random": random or not query}


NOTHING_FOUND = "No matching questions found in vector store database."


def context(hits: DataFrame, place: str = "place") -> DataFrame:
    """One text of a page of served hits: a line of metadata, the stem and the options of each, blank lines between; a fixed text if there are none."""
    head = F.concat(F.lit("--- [Result "), F.col(place).cast("string"), F.lit("] Paper: "), "paper_id", F.lit(" | Class "), "class_level", F.lit(" "), "subject", F.lit(" ("), "year", F.lit(") | Question: "), "question_number", F.lit(" | Similarity: "), F.format_string("%.4f", F.col("similarity").cast("double")), F.lit(" ---"))
    listed = F.when(F.size("options") > 0, F.concat(F.lit("Options:\n"), F.array_join(F.transform("options", lambda o: F.concat(F.lit("("), o["label"], F.lit(") "), o["text"])), "\n")))
    block = F.concat_ws("\n", head, F.coalesce(F.nullif("stem_text", F.lit("")), "content"), listed)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n")
    return hits.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(NOTHING_FOUND)).alias("context"))
