"""Quality rules of documents and of their hosts, by DataFrame functions alone.

Every whole text is measured, and each rule says whether the document fails it. Failures are summed by host (partly before
the shuffle), and each host's failure rates are shrunk with an empirical beta prior, fitted to all hosts by moments: a host
of few documents is judged by what is usual, one of many by its own rate. A host whose shrunk rate passes `most` for any
rule is rejected with all its documents; a document also goes if it fails a base rule itself.

Null and empty texts have no words and fail. Documents without a host (null) share one of their own. Repeated rows count
as often as they are there. Only `key`, `text` and `host` are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import SPACES, cut, words_of

SYMBOLS = "#*$%&|<>"
#: Positions below this share a number with the upper bits of a window's hash; longer texts are sorted by the words themselves.
PLACES = 20
#: Above this shrunk rate of failures, a host is rejected.
MOST = 0.5

RULES: dict[str, Column | str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE_RULES = ("short", "repeats")


def n_repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, the first occurrence included. words: a column, as it is used several times."""
    low = (1 << PLACES) - 1
    at = F.sequence(F.lit(0), F.size(words) - 3)
    word = lambda i: F.get(words, i)
    same = lambda a, b: F.coalesce(F.shiftrightunsigned(a, PLACES) == F.shiftrightunsigned(b, PLACES), F.lit(False))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    packed = F.sort_array(F.transform(at, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

    def fast(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return _with(twice, lambda r: F.when(F.size(F.filter(r, lambda x, i: same(x, F.get(r, i - 1)) & ~_equal(word, place(x), place(F.get(r, i - 1))))) > 0, exact).otherwise(_covered(F.transform(r, place))))

    rows = F.array_sort(F.transform(at, lambda i: F.struct(F.struct(word(i), word(i + 1), word(i + 2)).alias("w"), i.cast("int").alias("i"))))
    like = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    exact = _with(rows, lambda s: _covered(F.transform(F.filter(s, lambda x, i: like(x, F.get(s, i - 1)) | like(x, F.get(s, i + 1))), lambda x: x["i"])))
    return F.when(F.size(words) < 3, F.lit(0)).when(F.size(words) > low, exact).otherwise(_with(packed, fast)).cast("long")


def _with(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _equal(word, a: Column, b: Column) -> Column:
    return (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))


def _covered(places: Column) -> Column:
    """How many words the windows of three at these places cover."""
    return _with(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str | None = "source") -> DataFrame:
    """`k`, `host`, and the counts that the rules use, of every row."""
    own = F.coalesce(F.col(host).cast("string"), F.lit("")) if host is not None else F.lit("")
    rows = docs.select(F.col(key).alias("k"), own.alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("words", words_of(F.col("t")))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return rows.select(
        "k",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def prior(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Of each rule, alpha and beta of the beta law that has the mean of all documents and the spread of the hosts' rates beyond chance."""
    n = F.col("n")
    total = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *(F.sum(r).alias(r) for r in rules)).first()
    if not total["n"]:
        return {r: (1.0, 1.0) for r in rules}
    mean = {r: total[r] / total["n"] for r in rules}
    spread = hosts.agg(*(F.sum(n * (F.col(r) / n - F.lit(mean[r])) ** 2).alias(r) for r in rules)).first()
    found = {}
    for r in rules:
        m = min(max(mean[r], 1e-6), 1 - 1e-6)
        between = (spread[r] - (total["hosts"] - 1) * m * (1 - m)) / total["n"]
        strength = min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
        found[r] = (m * strength, (1 - m) * strength)
    return found


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE_RULES, most: float = MOST) -> DataFrame:
    """`key`, the counts, `base_failed`, `host_failed` and `kept` of every row."""
    failing = cut(measured(docs, key, text, host).select("*", *(F.expr(e).alias(f"fails_{r}") for r, e in rules.items())))
    hosts = cut(failing.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in rules)))
    shape = prior(hosts, [*rules])
    rates = {r: (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in shape.items()}
    verdict = hosts.select("host", F.greatest(*rates.values(), F.lit(0.0)).alias("worst_rate")).withColumn("host_failed", F.col("worst_rate") > most)
    own = F.greatest(*(F.col(f"fails_{r}") for r in base), F.lit(False))
    out = failing.join(verdict, "host", "left").withColumn("base_failed", own)
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("k").alias(key), *counts, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
