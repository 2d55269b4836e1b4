"""Audit and review: reconciliation with the source, issues, confidence, the queue of drafts, refinement, quality of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import parts as P
from quire.functions import text as X
from quire.operators import questions as Q
from quire.operators import serving

SHORT_STEM, LONG_SOURCE = 15, 30
UNASSIGNED = "General/Unassigned"
#: An option in a source, however its label was damaged.
SOURCE_OPTION = r"(?i)(?:\(|\b)([a-d])(?:\s*\)|\s*\.)\s*([^(\n]+)"


def options_of_source(span: Column) -> Column:
    labels, values = (F.regexp_extract_all(span, F.lit(SOURCE_OPTION), F.lit(i)) for i in (1, 2))
    return F.zip_with(labels, values, lambda a, b: F.struct(F.lower(a).alias("label"), F.trim(b).alias("text")))


def reconciled(rows: DataFrame) -> DataFrame:
    """Questions (text, options of label and text, placeholders, span) held against their source span: options are taken from it if it has
    two or more and more than were found, placeholders that it names are added, a lost stem is marked. Adds corrected, correction_note,
    needs_manual_review, review_reason."""
    span = F.coalesce("span", F.lit(""))
    found, given = options_of_source(span), F.coalesce("options", F.array())
    repair = (F.size(found) >= 2) & (F.size(given) < F.size(found))
    lost = F.array_except(X.placeholders(span), F.coalesce("placeholders", serving.no_texts()))
    notes = F.concat_ws(
        "; ",
        F.when(repair, F.format_string("Reconciled %d options from raw source span (fixed label split/spacing)", F.size(found))),
        F.when(F.size(lost) > 0, F.concat(F.lit("Reconciled missing image placeholders ['"), F.array_join(lost, "', '"), F.lit("'] from raw source span"))),
    )
    truncated = (F.length(F.trim(F.coalesce("text", F.lit("")))) < SHORT_STEM) & (F.length(F.trim(span)) > LONG_SOURCE)
    reason = F.when(truncated, F.format_string("Raw source span exists (%d chars) but extracted text stem is empty/truncated", F.length(span)))
    made = rows.withColumns({"_o": F.when(repair, found).otherwise(given), "_p": F.array_union(F.coalesce("placeholders", serving.no_texts()), lost), "corrected": repair | (F.size(lost) > 0), "correction_note": F.nullif(notes, F.lit("")), "needs_manual_review": truncated, "review_reason": reason})
    return made.withColumn("options", F.col("_o")).withColumn("placeholders", F.col("_p")).drop("_o", "_p")


def attached(rows: DataFrame, manifest: DataFrame, paper: str, body: str) -> DataFrame:
    """Adds `placeholders`: those of the paper's manifest that the body names, in the manifest's order. Bodies are searched for tokens once, so
    there is no comparison of every body with every placeholder."""
    of_paper = manifest.groupBy(paper).agg(F.array_sort(F.collect_set("placeholder")).alias("_known"))
    held = rows.join(of_paper, paper, "left").withColumn("_named", X.placeholders(F.col(body)))
    return held.withColumn("placeholders", F.array_intersect(F.coalesce("_known", serving.no_texts()), "_named")).drop("_known", "_named")


def _issue(when: Column, issue: Column, severity: str) -> Column:
    return F.when(when, F.struct(issue.alias("issue"), F.lit(severity).alias("severity")))


def audited(questions: DataFrame, source_numbers: DataFrame, manifest: DataFrame, paper: str = "paper_id") -> DataFrame:
    """`paper`, question_number, issue, severity of whole papers. questions: paper, question_number, stem, text, options, placeholders, span.
    source_numbers: paper, number (as text) of the questions that the source has. manifest: paper, placeholder."""
    rows = reconciled(questions)
    bare = rows.select(paper, F.regexp_replace("question_number", r"\D", "").alias("number"))
    gone = source_numbers.select(paper, "number").distinct().join(bare, [paper, "number"], "left_anti")
    absent = gone.select(paper, F.concat(F.lit("Q"), "number").alias("question_number"), F.format_string("Question Q%s present in source markdown but missing from JSON structure", "number").alias("issue"), F.lit("critical").alias("severity"))
    used = rows.select(paper, F.explode("placeholders").alias("placeholder"))
    loose = manifest.select(paper, "placeholder").distinct().join(used, [paper, "placeholder"], "left_anti")
    pictures = loose.select(paper, F.lit(UNASSIGNED).alias("question_number"), F.format_string("Image placeholder %s extracted from PDF but not attached to any question subpart", "placeholder").alias("issue"), F.lit("minor").alias("severity"))
    typed = Q.classified(rows.withColumns({"n_options": F.size("options"), "n_images": F.size("placeholders")}))
    own = F.array_compact(F.array(
        _issue(F.col("corrected"), F.concat(F.lit("Pass B-0 Source Reconciliation: "), "correction_note"), "minor"),
        _issue(F.col("needs_manual_review"), F.concat(F.lit("Pass B-0 Manual Review Needed: "), "review_reason"), "critical"),
        _issue(F.length(F.trim("stem")) < SHORT_STEM, F.concat(F.lit("Question "), "question_number", F.lit(" has suspiciously short stem text ('"), "stem", F.lit("')")), "critical"),
    ))
    both = F.concat(own, Q.issues_of(F.col("text"), F.col("n_options"), F.col("n_images")))
    told = typed.select(paper, "question_number", F.explode(both).alias("i")).select(paper, "question_number", "i.issue", "i.severity")
    return absent.unionByName(pictures).unionByName(told)


def escalated(issues: Column) -> Column:
    """Whether an array of (issue, severity) has a critical one about an image, which asks for another look at the page."""
    return F.exists(issues, lambda i: (i["severity"] == "critical") & F.contains(F.lower(i["issue"]), F.lit("image")))


def with_confidence(questions: DataFrame, issues: DataFrame, *key: str) -> DataFrame:
    """Questions with extraction_confidence, flagged_for_review and flag_reason by their issues: any critical one makes low with the critical
    messages, any makes medium with all, none makes high."""
    at = lambda only: F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == "critical", F.col("issue")) if only else F.col("issue"))), "; ")
    critical = F.bool_or(F.col("severity") == "critical")
    told = issues.groupBy(*key).agg(F.when(critical, "low").otherwise("medium").alias("_c"), F.when(critical, at(True)).otherwise(at(False)).alias("flag_reason"), F.collect_list(F.struct("issue", "severity")).alias("_i"))
    both = questions.join(told, [*key], "left")
    return both.withColumns({"extraction_confidence": F.coalesce("_c", F.lit("high")), "flagged_for_review": F.col("_c").isNotNull(), "escalate": F.coalesce(escalated(F.col("_i")), F.lit(False))}).drop("_c", "_i")


# ---- the queue of drafts


def queue(questions: DataFrame, paper: str = "paper_id", order: str = "question_number") -> DataFrame:
    """A row per paper: how many questions have each confidence, and those that are flagged or of low or medium confidence, in order, as they are
    shown. questions: paper, order, question_type, stem_text, options (label, text), subparts, confidence, flagged, flag_reason, corrected."""
    c = F.coalesce("confidence", F.lit("high"))
    is_ar = P.assertion(F.col("stem_text"), F.col("question_type"))
    folded = F.when(is_ar, P.with_reason(F.col("stem_text"), serving.texts(F.col("subparts")))).otherwise(F.struct(F.col("stem_text").alias("stem"), serving.texts(F.col("subparts")).alias("parts")))
    fixed = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(t).alias("text")) for x, t in zip("ABCD", P.ASSERTION_CHOICES, strict=True)))
    upper = F.transform(F.coalesce("options", F.array().cast(f"array<{P.OPTION}>")), lambda o: F.struct(F.upper(F.coalesce(o["label"], F.lit(""))).alias("label"), o["text"].alias("text")))
    rows = questions.withColumns({"_c": c, "_f": folded, "_o": F.when(is_ar, fixed).otherwise(upper), "_t": F.when(is_ar, "assertion_reason").otherwise(F.coalesce("question_type", F.lit("single_choice_mcq")))})
    flagged = F.coalesce("flagged", F.lit(False)) | F.col("_c").isin("low", "medium")
    shown = F.struct(F.col(order), F.col("_t").alias("question_type"), F.col("_f.stem").alias("stem_text"), X.latex(F.col("_f.stem")).alias("latex_stem"), F.col("_o").alias("options"), F.col("_f.parts").alias("subparts"), F.col("_c").alias("confidence"), F.coalesce("flag_reason", F.lit("Low extraction confidence / Needs manual review")).alias("flag_reason"), F.coalesce("corrected", F.lit(False)).alias("corrected"))
    counts = [F.count_if(F.col("_c") == x).alias(f"n_{x}") for x in ("high", "medium", "low")]
    listed = rows.groupBy(paper).agg(*counts, F.array_sort(F.collect_list(F.when(flagged, shown)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias("flagged_questions"))
    return listed.withColumn("n_flagged", F.size("flagged_questions"))


def grand_totals(drafts: DataFrame) -> DataFrame:
    return drafts.agg(F.count("*").alias("total_drafts"), F.coalesce(F.sum("n_flagged"), F.lit(0)).alias("total_flagged_questions"))


# ---- refinement


ORPHAN = ("options:", "options", "or")
FIGURE_WORDS = ("figure", "diagram", "given below", "graph")


def refined(chunks: DataFrame, manifest: DataFrame, paper: str = "paper_id", order: str = "question_id") -> DataFrame:
    """Chunks with options, stem, parts and type worked out anew. chunks: paper, order, content, section, question_number, options, subparts and
    linked_images (texts). Figure words link the paper's pictures where none is; a chunk of options alone gives them to the one before
    that is kept, if it has none, and goes."""
    content = P.repaired(F.col("content"), F.col("question_number"))
    rows = P.with_gated(chunks.withColumns({"content": content, "_s": F.coalesce("section", F.lit("SECTIONA"))}), "content", "_s", "question_number", "_g").drop("_s")
    given = P.structured(serving.texts(F.col("options")), False)
    read = P.structured(F.transform(Q.options(F.col("content")), lambda o: F.concat(F.lit("("), o["label"], F.lit(") "), o["text"])), False)
    gate = P.structured(F.col("_g"), False)
    rows = rows.withColumns({"_given": given, "_read": read, "_gate": gate})
    chosen = F.when(F.size("_given") > 0, F.col("_given")).when(F.size("_read") > 0, F.col("_read")).otherwise(F.col("_gate"))
    rows = rows.withColumn("_o", chosen)
    labels = F.transform("_o", lambda o: F.upper(o["label"]))
    rows = rows.withColumn("_o", F.filter("_o", lambda o, i: (o["label"] != "") & (F.array_position(labels, F.upper(o["label"])) == i + 1)))
    rows = rows.withColumn("_p", P.parted_anew(F.col("content"), F.transform("_o", lambda o: o["text"]), serving.texts(F.col("subparts"))))
    rows = rows.withColumns({"stem_text": F.col("_p.stem"), "_parts": F.col("_p.parts")})
    of_paper = manifest.groupBy(paper).agg(F.array_sort(F.collect_set("placeholder")).alias("_all"))
    rows = rows.join(of_paper, paper, "left")
    linked = serving.texts(F.col("linked_images"))
    rows = rows.withColumn("linked_images", F.when((F.size(linked) == 0) & Q.contains_any(F.lower("stem_text"), FIGURE_WORDS), serving.texts(F.col("_all"))).otherwise(linked))
    orphan = F.lower(F.trim("stem_text")).isin(*ORPHAN) | (F.length(F.trim("stem_text")) < 4)
    # The first orphan with options after a kept chunk gives them to it.
    rows = rows.withColumn("_kept", F.sum(F.when(orphan, 0).otherwise(1)).over(W.partitionBy(paper).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    spare = F.first(F.when(orphan & (F.size("_o") > 0), F.col("_o")), ignorenulls=True).over(W.partitionBy(paper, "_kept").orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("_spare", spare).withColumn("_orphan", orphan).filter("not _orphan")
    options = F.when((F.size("_o") == 0) & F.col("_spare").isNotNull(), F.col("_spare")).otherwise(F.col("_o"))
    taken = (F.size("_o") == 0) & F.col("_spare").isNotNull()
    kind = F.when(taken | (F.size("_o") >= 2), "mcq").when(F.size("_parts") == 0, "short_answer").otherwise("descriptive")
    rows = rows.withColumns({"question_type": kind, "subparts": F.col("_parts"), "has_subparts": F.size("_parts") > 0, "requires_image": F.size("linked_images") > 0, "context_refined": F.lit(True), "_options": options})
    return rows.withColumn("options", P.with_latex(F.col("_options"))).drop("_g", "_given", "_read", "_gate", "_o", "_p", "_parts", "_all", "_kept", "_spare", "_orphan", "_options")


# ---- quality of an extraction


PICTURE_WORDS = ("the figure", "in the diagram", "shown below", "the graph", "circuit diagram", "refer to figure", "in fig")
UNREADABLE = r"[\x{0B00}-\x{0BFF}\x{0C00}-\x{0CFF}\x{F000}-\x{F8FF}]"


def extraction_quality(questions: DataFrame) -> DataFrame:
    """Six shares of valid questions (raw_text, question_type, n_options, n_subparts, n_images, n_part_options, is_valid) in percent, two decimals."""
    rows = questions.filter(F.coalesce("is_valid", F.lit(True)))
    stem, low = F.coalesce("raw_text", F.lit("")), F.lower(F.coalesce("raw_text", F.lit("")))
    n, parts = F.col("n_options"), F.col("n_subparts")
    mcq = F.coalesce(F.col("question_type") == "single_choice_mcq", F.lit(False)) | (n >= 2)
    pictured, reasons = Q.contains_any(low, PICTURE_WORDS), P.assertion_either_case(stem)

    def share(hit: Column, of: Column | None = None) -> Column:
        whole = F.count("*") if of is None else F.count_if(of)
        return F.bround(F.count_if(hit if of is None else hit & of) / F.greatest(whole, F.lit(1)) * 100, 2)

    return rows.agg(
        F.count("*").alias("total_questions_audited"),
        share((F.length(F.trim(stem)) >= SHORT_STEM) & ~F.contains(stem, F.lit("SECTION –")) & ~F.contains(stem, F.lit("SECTION -"))).alias("clean_stem_accuracy"),
        share(~((n > 0) & (parts > 0))).alias("mutual_exclusivity_accuracy"),
        share(~stem.rlike(UNREADABLE)).alias("zero_pua_glyph_accuracy"),
        share(n == 4, mcq).alias("mcq_4_option_accuracy"),
        share(F.col("n_images") > 0, pictured).alias("diagram_attachment_accuracy"),
        share((n == 4) | (F.col("n_part_options") == 4), reasons).alias("assertion_reason_accuracy"),
    )
