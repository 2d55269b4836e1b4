"""Tables that change: upserts, deletes, status, nested patches, caches. Parquet has no MERGE, so rows are appended and read latest-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], seq: str, *tie: str) -> DataFrame:
    """Of each key the row with the highest seq; an aggregate that is worked out partly before the shuffle, so common keys don't gather."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(seq, *tie)).alias("_row")).select("_row.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return latest(old.unionByName(new, allowMissingColumns=True), keys, seq)


def upserted_keeping(rows: DataFrame, keys: list[str], at: str, *values: str) -> DataFrame:
    """The latest values, the first time as created_at and the last as updated_at."""
    return rows.groupBy(*keys).agg(*(F.max_by(v, at).alias(v) for v in values), F.min(at).alias("created_at"), F.max(at).alias("updated_at"))


def deleted(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return rows.join(gone.select(*keys), [*keys], "left_anti")


def without_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.filter(~F.startswith(F.col(key), F.lit(prefix)))


def status_map(events: DataFrame, key: str, name: str, value: str, at: str) -> DataFrame:
    """`key` and a map of each status name to its latest value."""
    last = events.groupBy(key, name).agg(F.max_by(value, at).alias("_v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("_v"))))).alias("phase_status"))


def patched(sections: Column, number: str, change) -> Column:
    """Nested sections in which change(question) takes the place of the first question of that number in each."""

    def in_section(s: Column) -> Column:
        first = F.array_position(F.transform(s["questions"], lambda q: q["question_number"]), F.lit(number))
        return s.withField("questions", F.transform(s["questions"], lambda q, i: F.when(i + 1 == first, change(q)).otherwise(q)))

    return F.transform(sections, in_section)


def approved(rows: DataFrame) -> DataFrame:
    return rows.withColumn("review", F.lit("approved")).withColumn("needs_review", F.lit(False))


def cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers, with its columns, and those it doesn't."""
    return requests.join(cache, keys), requests.join(cache.select(*keys), keys, "left_anti")


def canonical_json(**fields: Column) -> Column:
    """{"a": "...", "b": "..."} by name, for hashes of requests: keys in order, `", "` and `": "` between."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), quoted(v)) for k, v in sorted(fields.items()))), F.lit("}"))


def relative_path(path: Column) -> Column:
    """An absolute path from its `data/` on."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^.*?/(?=data/)", "")
