"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the documents it keeps; the last packs them.

Every stage works on all rows of the one before it, written as Parquet and read again, so a lost executor costs a stage's
tasks and not the pipeline; what only earlier stages needed is deleted then. Null, empty and blank texts: the classifier scores them
like any other, a document that loses its last word to line or substring dedup goes, one that had none stays, and packing gives it the end
id alone. Rows with a null doc_id are no near duplicates of any. Repeated rows have repeated lines, and are one another's copies: of rows with
equal ids all stay or all go. Empty tables give empty results at every stage; without labels the classifier keeps all. Only the columns of
documents are kept; others, whatever their names, are left out. ORACLE_SQL is None: tree ensembles, SimHash and tokenizers aren't for SQL; tests hold the stages
against brute-force versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import queries
from quire.llm._shared import WORD, Store, cut, shared_dir, swept, table, within
from quire.llm.classifier import kept, learn
from quire.llm.lines import without_fuzzy_lines
from quire.llm.packing import pack
from quire.llm.shingles import copies
from quire.llm.substring import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good."""
    return kept(docs, learn(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier place has too; those with no word left go."""
    swept(spark)
    return _retexted(docs, without_fuzzy_lines(docs, keep=COLUMNS))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (near SimHashes by pigeonhole parts, or common MinHash values; five-word shingles of similarity 0.8 or
    more), the document with the smallest doc_id."""
    swept(spark)
    return docs.join(within(cut(copies(docs))), "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier place has too; those with no word left go."""
    swept(spark)
    return _retexted(docs, without_repeats(docs, keep=COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their places in sequences of 4096 tokens."""
    swept(spark)
    return pack(docs, queries.vocabulary(queries.WORD_VOCABULARY))


def _retexted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """changed: the rows of docs with new texts and n_removed."""
    left = changed.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicate),
    ("substring_dedup", repeats),
    ("best_fit_packing", packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/quire-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        n = len(Store.made)
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        for path in (*(store.uri for store in Store.made[n:]), before):
            _delete(spark, path)
        before = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, path: str | None) -> None:
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
