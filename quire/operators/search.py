"""Hybrid search: hashed vectors and full text, fused by reciprocal ranks; browsing, paging and retrieval context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.functions import vectors as V
from quire.session import bounded, settled, ship

RRF_K, NO_RANK, SPARSE_CUT = 60, 100, 30


def query_vector(spark: SparkSession, query: str) -> DataFrame:
    return V.features(spark.createDataFrame([(0, query)], "q int, text string"), "q", "text").select("bucket", F.col("weight").alias("qw"))


def where(chunks: DataFrame, **equal: str | None) -> DataFrame:
    """Rows whose columns have these values; None and "all" ask for nothing."""
    for name, value in equal.items():
        if value is not None and str(value).lower() != "all":
            chunks = chunks.filter(F.col(name) == F.lit(value))
    return chunks


def dense(chunks: DataFrame, query: str, key: str = "doc_id", text: str = "text", cut: int | None = None) -> DataFrame:
    """`key`, bp and dense_rank of every chunk, or of the first `cut`."""
    return ranked(scores(chunks, query, key, text), "bp", key, "dense_rank", cut)


def scores(chunks: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, bp (cosine in ten-thousandths) of every chunk; a query has at most `dim` buckets, so it is broadcast."""
    vectors = V.features(chunks, key, text)
    asked = query_vector(chunks.sparkSession, query)
    norm = asked.agg(F.coalesce(F.sum(F.col("qw") * F.col("qw")), F.lit(0)).alias("qn"))
    both = vectors.join(F.broadcast(asked), "bucket", "left").groupBy(key).agg(F.sum(F.col("weight") * F.coalesce("qw", F.lit(0))).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("norm2"))
    return chunks.select(key).join(both, key, "left").join(F.broadcast(norm)).select(key, F.coalesce(V.basis_points(F.col("dot"), F.col("norm2"), F.col("qn")), F.lit(0)).alias("bp"))


def ranked(rows: DataFrame, by: str, key: str, to: str, cut: int | None = None) -> DataFrame:
    """The place of each row by `by` from high to low, ties by key, without gathering all rows in one task: rows of a partition
    of the sorted whole are numbered from what the partitions before it hold. A cut keeps the first ones."""
    if cut is not None:
        top = rows.orderBy(F.desc(by), key).limit(cut)
        return top.withColumn(to, F.row_number().over(W.orderBy(F.desc(by), key)))
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))  # as many rows as values: 10,001 basis points at most
    before = counts.select(by, (F.sum("_n").over(W.orderBy(F.desc(by))) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), by).withColumn(to, (F.col("_before") + F.row_number().over(W.partitionBy(by).orderBy(key))).cast("int")).drop("_before")


def sparse(chunks: DataFrame, query: str, key: str = "doc_id", text: str = "text", cut: int = SPARSE_CUT, order: str = "insertion") -> DataFrame:
    """`key`, sparse_rank of the first `cut` chunks with any of the query's tokens, by key ("insertion") or by BM25."""
    asked = F.array_distinct(X.tokens(F.lit(query)))
    if order == "bm25":
        return ranked(bm25(chunks, query, key, text), "score", key, "sparse_rank", cut).select(key, "sparse_rank")
    hits = chunks.filter(F.arrays_overlap(X.tokens(F.col(text)), asked)).select(key).orderBy(key).limit(cut)
    return hits.withColumn("sparse_rank", F.row_number().over(W.orderBy(key)))


def bm25(chunks: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`key`, score of the chunks with any of the query's tokens; idf = ln((N - n + 0.5) / (n + 0.5)), 1e-6 at least."""
    spark = bounded(ship(chunks.sparkSession))
    terms = spark.range(1).select(F.array_distinct(X.tokens(F.lit(query)))).first()[0]
    place = {t: i for i, t in enumerate(terms)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(r"\w+").findall
        for b in batches:
            sizes, found = [], []
            for t in b.column(1):
                words = None if t.as_py() is None else find(t.as_py())
                hits = Counter(filter(place.__contains__, words or ()))
                sizes.append(None if words is None else len(words))
                found.append([{"term": x, "tf": n} for x, n in hits.items()])
            kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(found, kind)], names=["key", "len", "found"])

    hits = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
    made = T.StructType([T.StructField("key", chunks.schema[key].dataType), T.StructField("len", T.IntegerType()), T.StructField("found", hits)])
    # A row's length and its counts of the query's tokens alone, by one reading of the text; no row for each of its tokens.
    held = settled(chunks.select(F.col(key).alias("key"), F.lower(text).alias("t")).mapInArrow(counted, made))
    total = held.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    tf = held.select(F.col("key").alias(key), "len", F.inline("found")).groupBy(key, "len", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(F.broadcast(df), "term").join(F.broadcast(total)).groupBy(key).agg(F.sum(part).alias("score"))


def fused(dense_hits: DataFrame, sparse_hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reciprocal ranks: 1 / (60 + dense) + 1 / (60 + sparse), a missing sparse rank counting as 100; in millionths."""
    both = dense_hits.join(F.broadcast(sparse_hits), key, "left")  # at most SPARSE_CUT rows
    r = F.coalesce("sparse_rank", F.lit(NO_RANK))
    return both.withColumn("rrf", F.round((1.0 / (RRF_K + F.col("dense_rank")) + 1.0 / (RRF_K + r)) * 1_000_000).cast("bigint"))


def hybrid(chunks: DataFrame, query: str, k: int | None = 10, key: str = "doc_id", text: str = "text", order: str = "insertion", **equal: str | None) -> DataFrame:
    """The k best chunks (all if k is null or not positive). The sparse list is cut before the conditions, dense ranks are given after them.
    A chunk without a sparse rank can only be among the k best if it is among the k of the highest dense ranks, so those and the
    sparse list (SPARSE_CUT rows) are all that is ranked; a sparse hit's dense rank is a count of what is better."""
    listed, kept = settled(sparse(chunks, query, key, text, order=order)), where(chunks, **equal)
    best = lambda found: found.orderBy(F.desc("rrf"), F.desc("bp"), "dense_rank")
    if not k or k <= 0:
        return best(fused(dense(kept, query, key, text), listed, key))
    scored = settled(scores(kept, query, key, text))  # two numbers a row, read for the best, for the listed and for the counts
    top = scored.orderBy(F.desc("bp"), key).limit(k)
    top = top.withColumn("dense_rank", F.row_number().over(W.orderBy(F.desc("bp"), key)))
    hits = settled(scored.join(F.broadcast(listed.select(key)), key, "left_semi"))
    known = hits.collect()  # SPARSE_CUT rows at most
    if known:
        better = [F.count_if((F.col("bp") > r.bp) | ((F.col("bp") == r.bp) & (F.col(key) < F.lit(r[key])))).alias(f"n{i}") for i, r in enumerate(known)]
        counts = scored.agg(*better).select(F.posexplode(F.array(*(F.col(f"n{i}") for i in range(len(known))))).alias("i", "n"))
        ranked_hits = chunks.sparkSession.createDataFrame([(i, r[key], r.bp) for i, r in enumerate(known)], T.StructType([T.StructField("i", T.IntegerType()), scored.schema[key], T.StructField("bp", T.LongType())]))
        ranks = ranked_hits.join(F.broadcast(counts), "i").select(key, "bp", (F.col("n") + 1).cast("int").alias("dense_rank"))
        top = top.unionByName(ranks).dropDuplicates([key])
    return best(fused(top, listed, key)).limit(k)


#: Queries that are searched for together at most, as every task holds their vectors.
TOGETHER = 20_000


def batch(chunks: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "query_id") -> DataFrame:
    """`query`, `key`, rank, rrf, bp: the k best chunks of each of a counted set of queries (`query`, `text`), as hybrid() ranks them. Chunks are
    scored where they are, against all queries by one product of matrices; a task gives each query's k best and its first
    SPARSE_CUT matches. A second pass counts what is better than each of those matches."""
    asked = queries.select(F.col(query).cast("long").alias("q"), "text").collect() if queries.count() <= TOGETHER else None
    if asked is None:
        raise ValueError(f"more than {TOGETHER} queries: search for them in parts")
    spark, n = chunks.sparkSession, len(asked)
    names, words = [r.q for r in asked], [{*re.findall(r"\w+", r.text.lower())} for r in asked]
    matrix = np.zeros((V.DIM, n))
    for r in V.features(queries.select(F.col(query).cast("long").alias("q"), "text"), "q", "text").collect():
        matrix[r.bucket, names.index(r.q)] = r.weight
    lengths, of_word = np.sqrt((matrix**2).sum(axis=0)), {}
    for i, found in enumerate(words):
        for w in found:
            of_word.setdefault(w, []).append(i)
    held = settled(V.vectors(chunks, key, text))

    def scored(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(b.num_rows, V.DIM).astype(float)
        scale = np.sqrt((x * x).sum(axis=1))[:, None] * lengths[None, :]
        return b.column(0).to_numpy(), np.rint(np.divide(x @ matrix, scale, out=np.zeros(scale.shape), where=scale > 0) * 10_000).astype(np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids, bp = scored(part)
                out: list[tuple[int, int, int, bool]] = []
                for i in range(n):
                    best = np.lexsort((ids, -bp[:, i]))[:k]
                    out += [(names[i], int(ids[j]), int(bp[j, i]), False) for j in best]
                matched: dict[int, list[int]] = {}
                for j, t in enumerate(part.column(2).to_pylist()):
                    for i in {i for w in {*re.findall(r"\w+", t.lower())} & of_word.keys() for i in of_word[w]}:
                        matched.setdefault(i, []).append(j)
                for i, js in matched.items():
                    out += [(names[i], int(ids[j]), int(bp[j, i]), True) for j in sorted(js, key=lambda j: ids[j])[:SPARSE_CUT]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["q", "key", "bp", "sparse"])

    found = settled(held.mapInArrow(first, "q long, key long, bp long, sparse boolean"))
    top = found.filter("not sparse").withColumn("dense_rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("bp"), "key"))).filter(F.col("dense_rank") <= k)
    listed = settled(found.filter("sparse").withColumn("sparse_rank", F.row_number().over(W.partitionBy("q").orderBy("key"))).filter(F.col("sparse_rank") <= SPARSE_CUT).select("q", "key", "bp", "sparse_rank"))
    hits = [(names.index(r.q), r.bp, r.key) for r in listed.select("q", "bp", "key").collect()]  # SPARSE_CUT rows for each query at most

    def better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, least, place = (np.array([h[c] for h in hits], np.int64) for c in range(3))
        total = np.zeros(len(hits), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids, bp = scored(b.slice(at, 1000))
                for lo in range(0, len(hits), 512):
                    part = slice(lo, lo + 512)
                    mine = bp[:, of[part]]
                    total[part] += ((mine > least[part]) | ((mine == least[part]) & (ids[:, None] < place[part]))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in of], pa.int64()), pa.array(place), pa.array(total)], names=["q", "key", "n"])

    counts = held.select("k", "v").mapInArrow(better, "q long, key long, n long").groupBy("q", "key").agg((F.sum("n") + 1).cast("int").alias("dense_rank"))
    both = top.select("q", "key", "bp", "dense_rank").unionByName(listed.join(counts, ["q", "key"]).select("q", "key", "bp", "dense_rank")).dropDuplicates(["q", "key"])
    ranks = both.join(listed.select("q", "key", "sparse_rank"), ["q", "key"], "left")
    ranks = ranks.withColumn("rrf", F.round((1.0 / (RRF_K + F.col("dense_rank")) + 1.0 / (RRF_K + F.coalesce("sparse_rank", F.lit(NO_RANK)))) * 1_000_000).cast("bigint"))
    order = W.partitionBy("q").orderBy(F.desc("rrf"), F.desc("bp"), "dense_rank")
    return ranks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("q").alias(query), F.col("key").alias(key), "rank", "rrf", "bp")


def browse(rows: DataFrame, class_: str, *then: str) -> DataFrame:
    """By class as a number (others as 0), then by further columns."""
    number = F.when(F.col(class_).rlike("^[0-9]+$"), F.col(class_).try_cast("int")).otherwise(0)
    return rows.orderBy(F.coalesce(number, F.lit(0)), *then)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def page(rows: DataFrame, number: int, size: int, top_k: int | None = None) -> DataFrame:
    """A page of ordered rows: size -1 or from 1000 on gives all; numbers outside are clamped to the pages there are."""
    size = top_k if top_k and size == 10 else size
    if size == -1 or size >= 1000:
        return rows
    total = rows.count()
    number = max(1, min(number, max(1, -(-total // size))))
    return rows.offset((number - 1) * size).limit(size)


def rendered(hits: DataFrame, rank: str, *parts: Column) -> DataFrame:
    """One text: a numbered block per hit, blank lines between; a fixed text if there is none. hits: a cut list, so it is small."""
    block = F.concat_ws("\n", F.format_string("[%d]", F.col(rank)), *parts)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n")
    return hits.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit("No matching questions found.")).alias("context"))


def evaluated(hits: DataFrame, queries: DataFrame, query: str = "query_id") -> DataFrame:
    """hits: query, rank, document; queries: query, keywords. Mean reciprocal rank and hit rate; a query without a match counts 0."""
    good = hits.join(queries, query).filter(F.exists("keywords", lambda k: F.contains(F.lower("document"), F.lower(k))))
    best = queries.select(query).join(good.groupBy(query).agg(F.min("rank").alias("best")), query, "left")
    return best.agg(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"), F.avg(F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"))
