"""Settings with defaults: spark.quire.<name> of the session, else the environment's QUIRE_<NAME>, else the default."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "embedding.dim": 384, "search.top_k": 5, "search.page_size": 10, "search.rrf_k": 60, "dedup.threshold": 0.85, "dedup.report_threshold": 0.92, "dedup.report_rows": 50,
    "ocr.page_chars": 80, "ocr.paper_chars": 50, "native.mean_chars": 200, "prompt.version": "v1", "model.timeout_seconds": 3.0,
}


def setting(spark: SparkSession, name: str):
    """A setting's value, of its default's type."""
    default = DEFAULTS[name]
    found = spark.conf.get(f"spark.quire.{name}", None) or os.environ.get("QUIRE_" + name.upper().replace(".", "_"))
    return default if found is None else type(default)(found)
