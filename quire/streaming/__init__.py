"""Structured Streaming forms of the batch operators: incremental ingest, windows over events, dedup, latest status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.state import latest


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(rows: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour", *by: str) -> DataFrame:
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(rows: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour", step: str = "15 minutes", *by: str) -> DataFrame:
    return rows.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(rows: DataFrame, by: str, at: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), by, "n")


def without_repeats(rows: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def upsert_into(path: str, keys: list[str], seq: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the latest row of each key of a batch is appended under the batch's number, so that a batch that is run again
    replaces itself; read with current()."""

    def put(batch: DataFrame, number: int) -> None:
        latest(batch, keys, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def current(spark: SparkSession, path: str, keys: list[str], seq: str) -> DataFrame:
    return latest(spark.read.parquet(path), keys, seq).drop("batch")
