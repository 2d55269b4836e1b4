"""A sparse rule ensemble for document quality.

Statistics of whole texts are Spark column expressions. Shallow trees, grown on random halves of a labelled sample, are cut
into the conjunctive rules that lead to each of their nodes; a logistic model with an L1 penalty on rules and statistics
keeps few of them; those and their weights are compiled into one Spark column expression, so scoring is a scan.

The sample is the SAMPLE labelled documents of the smallest hash of key and text (all, if fewer); that bound is the only one,
and fitting on it needs the driver to hold SAMPLE rows of numbers. Null and empty texts have statistics of zero and get a
score like any other. Null labels aren't used, and of several labels of a key each counts. Repeated rows get a row each.
Only `key` and `text` are read. Without a label of both kinds, every score is the mean label (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import picked, words_of

SAMPLE = 20_000
TREES, DEPTH, BINS, MIN_LEAF, PENALTY = 24, 3, 32, 20, 0.0005


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`k` and the statistics of every row, as doubles; and its columns `keep`, which may not have a statistic's name."""
    rows = picked(docs, key, text, *(F.col(c) for c in keep)).withColumn("words", words_of(F.col("t"))).withColumn("lines", F.split("t", "\n"))
    words, n = F.col("words"), F.greatest(F.size("words"), F.lit(1))
    chars = F.greatest(F.length("t"), F.lit(1))
    share = lambda drop: (F.length("t") - F.length(F.translate("t", drop, ""))) / chars
    return rows.select(
        "k",
        F.log1p(F.size("words")).alias("log_words"),
        (F.length("t") / n).alias("chars_per_word"),
        (F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))) / n).alias("repeated_next"),
        ((F.log1p(F.size(F.array_distinct(words))) / F.log1p(n))).alias("distinct_words"),
        (F.size(F.array_distinct("lines")) / F.greatest(F.size("lines"), F.lit(1))).alias("distinct_lines"),
        (F.size("lines") / n).alias("lines_per_word"),
        (F.length(F.regexp_replace("t", r"\P{Lu}+", "")) / chars).alias("upper"),
        share("0123456789").alias("digits"),
        share(".,;:").alias("stops"),
        share("!?").alias("calls"),
        share("|").alias("bars"),
        share("#*$%&<>@^~=_+\\/{}[]").alias("symbols"),
        *keep,
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, above?, threshold) of each part."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[f] > t if above else x[f] <= t for f, above, t in self.parts])

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.parts:
            out = out & (F.col(f) > t if above else F.col(f) <= t)
        return out.cast("double")


@dataclass
class Ensemble:
    """score = 1 / (1 + exp(-(bias + the weights of the rules that hold + the linear terms)))."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)  # statistic, lowest, highest, weight

    def score(self) -> Column:
        out = F.lit(float(self.bias))
        for rule, w in self.rules:
            out = out + rule.column() * F.lit(float(w))
        for f, low, high, w in self.linear:
            out = out + (F.least(F.greatest(F.col(f), F.lit(low)), F.lit(high)) - low) / (high - low) * F.lit(float(w))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))


def grow(x: dict[str, np.ndarray], y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> list[Rule]:
    """The rules of one tree: the way to each of its nodes but the root. Each split looks at a random half of the statistics."""
    names, found = sorted(x), []

    def split(at: np.ndarray, parts: tuple, left: int) -> None:
        p = y[at].mean()
        if not left or len(at) < 2 * MIN_LEAF or p in (0, 1):
            return
        best = (1e-9, None, 0.0)
        for f in rng.choice(names, max(1, len(names) // 2), replace=False):
            v = x[f][at]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")):
                low = v <= t
                n = int(low.sum())
                if min(n, len(at) - n) < MIN_LEAF:
                    continue
                a, b = y[at][low].mean(), y[at][~low].mean()
                gain = p * (1 - p) - (n * a * (1 - a) + (len(at) - n) * b * (1 - b)) / len(at)
                if gain > best[0]:
                    best = (gain, str(f), float(t))
        if best[1] is None:
            return
        low = x[best[1]][at] <= best[2]
        for above, part in ((False, at[low]), (True, at[~low])):
            new = (*parts, (best[1], above, best[2]))
            found.append(Rule(new))
            split(part, new, left - 1)

    split(np.arange(len(y)) if len(y) < 200 else rng.choice(len(y), len(y) // 2, replace=False), (), depth)
    return found


def lasso(columns: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = columns.shape
    x = np.c_[columns, np.ones(n, np.float32)].astype(np.float32)
    v = np.ones(m + 1, np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(float(np.linalg.norm(x.T @ (x @ v))), 1e-9)
    w = z = np.zeros(m + 1)
    w[m] = z[m] = math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ z.astype(np.float32)).astype(np.float64)))
        new = z - step * (x.T @ (p - y).astype(np.float32)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return w[:m], float(w[m])


def fit(rows: list, names: list[str], seed: int = 7) -> Ensemble:
    """rows: statistics and `label` of labelled documents."""
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Ensemble(math.log(p / (1 - p)))
    x = {f: np.array([r[f] for r in rows], float) for f in names}
    rng = np.random.default_rng(seed)
    rules = {r.holds(x).tobytes(): r for _ in range(TREES) for r in grow(x, y, rng)}
    rules = [r for r in rules.values()]
    range_of = {f: (float(np.quantile(x[f], 0.02)), float(np.quantile(x[f], 0.98))) for f in names}
    linear = [f for f in names if range_of[f][1] > range_of[f][0]]
    columns = np.column_stack([r.holds(x).astype(np.float32) for r in rules] + [((np.clip(x[f], *range_of[f]) - range_of[f][0]) / (range_of[f][1] - range_of[f][0])).astype(np.float32) for f in linear])
    w, bias = lasso(columns, y)
    return Ensemble(bias, [(r, a) for r, a in zip(rules, w, strict=False) if abs(a) > 1e-4], [(f, *range_of[f], a) for f, a in zip(linear, w[len(rules) :], strict=True) if abs(a) > 1e-4])


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the key as text leaves 1 when divided by 3. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    given = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("k")))
    chosen = given.orderBy(F.xxhash64("k"), "k", "label").limit(sample)
    # The sample has at most `sample` rows of two numbers.
    known = docs.join(F.broadcast(chosen), docs[key] == chosen["k"], "left_semi")
    measured = statistics(known, key, text)
    names = [c for c in measured.columns if c != "k"]
    rows = measured.join(F.broadcast(chosen), "k").orderBy(F.xxhash64("k", *names), "label").limit(sample).collect()
    return fit(rows, names)


def kept(docs: DataFrame, model: Ensemble, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of the rows that the model predicts to be good."""
    rows = statistics(docs, key, text, keep).withColumn("_row", F.monotonically_increasing_id())  # keeps Spark from working the statistics out again for each rule of the filter
    return rows.filter((model.score() >= 0.5) & (F.col("_row") >= 0)).select(*keep)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """`key`, `held_out`, `score` (0 to 1, higher: good likelier), `predicted` (1 if the score is 0.5 or more) of every row."""
    model = learn(docs, labels, key, text, label, sample)
    out = statistics(docs, key, text).withColumn("score", model.score())
    return out.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
