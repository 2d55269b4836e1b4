"""Distributions, blueprints, catalogues, review queues and quality ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit("unknown"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """value, n by falling counts, then value; null and blank values are "unknown"."""
    return rows.groupBy(known(F.col(column)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distributions(rows: DataFrame, *columns: str) -> DataFrame:
    """field, value, n: all of them over one scan, by grouping sets."""
    named = rows.select(*(known(F.col(c)).alias(c) for c in columns))
    sets = [[F.col(c)] for c in columns]
    grouped = named.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    n = len(columns)
    which = F.coalesce(*(F.when(F.col("g") == (1 << n) - 1 - (1 << n - 1 - i), F.lit(c)) for i, c in enumerate(columns)))
    return grouped.select(which.alias("field"), F.coalesce(*columns).alias("value"), "n")


def examples(rows: DataFrame, order: str, n: int = 12) -> DataFrame:
    return rows.orderBy(order).limit(n)


def value_sets(rows: DataFrame, *columns: str) -> DataFrame:
    """Of each column its distinct values, whole numbers first and in order, then text."""
    order = lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.coalesce(x.try_cast("bigint"), F.lit(0)).alias("number"), x.alias("text"))
    return rows.agg(*(F.array_join(F.transform(F.array_sort(F.transform(F.collect_set(F.col(c).cast("string")), order)), lambda s: s["text"]), ",").alias(c) for c in columns))


def totals(rows: DataFrame, by: str, **sums: Column) -> DataFrame:
    """The sums of each group, and of all as group "total"."""
    return rows.rollup(by).agg(*(v.alias(k) for k, v in sums.items()), F.grouping(by).alias("_all")).withColumn(by, F.when(F.col("_all") == 1, "total").otherwise(F.col(by))).drop("_all")


def merged_catalogue(presets: DataFrame, found: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Presets, stored counts and registered counts by tenant; the first name known, counts 0 where there is none."""
    all_ = presets.join(found, key, "full_outer").join(registered, key, "full_outer")
    return all_.select(key, F.coalesce("name", key).alias("name"), F.coalesce("n_questions", F.lit(0)).alias("n_questions"), F.coalesce("n_papers", F.lit(0)).alias("n_papers")).orderBy(F.desc("n_questions"), F.desc("n_papers"), "name")


def review_queue(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("flagged", F.lit(False)) | F.col("confidence").isin("low", "medium"))


def histogram(rows: DataFrame, by: str, column: str, *values: str) -> DataFrame:
    return rows.groupBy(by).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def ratio(part: Column, whole: Column | None = None) -> Column:
    """A share in hundredths of a percent, a whole number; 0 of nothing."""
    n = F.count("*") if whole is None else F.count_if(whole)
    hit = part if whole is None else part & whole
    return F.round(F.count_if(hit) * 10000 / F.greatest(n, F.lit(1))).cast("bigint")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that comes first."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def newest(rows: DataFrame, at: str) -> DataFrame:
    return rows.orderBy(F.desc(at))


def profile(rows_by_level: list[DataFrame], key: str) -> DataFrame:
    """The first level (tenant, global, any) that knows a key."""
    held = None
    for i, rows in enumerate(rows_by_level):
        level = rows.withColumn("_level", F.lit(i))
        held = level if held is None else held.unionByName(level)
    w = W.partitionBy(key).orderBy("_level")
    return held.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_level")


CLASSES = ("6", "7", "8", "9", "10", "11", "12")
SUBJECTS = ("mental_ability", "mathematics", "science", "physics", "chemistry", "biology", "social_science", "english")


def filter_lists(rows: DataFrame, class_: str, subject: str) -> DataFrame:
    """kind (class or subject), value, place: the usual values and those of the rows; classes by number, subjects in lower case by name."""
    usual = rows.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, vs in (("class", CLASSES), ("subject", SUBJECTS)) for v in vs))).alias("u")).select("u.*")
    found = rows.select(F.explode(F.array(F.struct(F.lit("class").alias("kind"), F.col(class_).cast("string").alias("value")), F.struct(F.lit("subject").alias("kind"), F.lower(F.col(subject)).alias("value")))).alias("u")).select("u.*").filter("value <> ''")
    order = W.partitionBy("kind").orderBy(F.when(F.col("kind") == "class", F.coalesce(F.col("value").try_cast("int"), F.lit(2**31 - 1))), "value")
    return usual.unionByName(found.distinct()).distinct().withColumn("place", F.row_number().over(order))  # some values of two kinds


def tenants(rows: DataFrame, tenant: str) -> DataFrame:
    """Of each tenant its questions, papers, and its classes and subjects in order; by falling questions and papers, then name."""
    sets = {c: F.array_sort(F.collect_set(c)) for c in ("class_level", "subject")}
    out = rows.groupBy(tenant).agg(F.count("*").alias("questions"), F.countDistinct("paper_id").alias("papers"), sets["class_level"].alias("classes"), sets["subject"].alias("subjects"))
    return out.orderBy(F.desc("questions"), F.desc("papers"), tenant)
