"""Questions from templates: n rows of a topic and type, with parameters picked by a hash, so a seed gives the same paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ("quadratic", "progression", "triangle", "section", "primes", "probability", "volume", "circuit", "heat", "venn")
TYPES = ("mcq", "short_answer", "long_answer")


def pick(values: list[int], seed: int, *by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(len(values))) + 1).cast("int"))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps as a fold: 40 are enough for 31-bit numbers."""
    state = F.struct(F.greatest(a, b).cast("bigint").alias("x"), F.least(a, b).cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(45)), state, lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0)).otherwise(s["x"] % F.nullif(s["y"], F.lit(0))).cast("bigint").alias("y")))["x"]


def routed(topic: Column, i: Column) -> Column:
    """A topic by its words, else by turns."""
    t = F.lower(topic)
    has = lambda *x: t.rlike("|".join(x))
    turn = F.element_at(F.array(*map(F.lit, TOPICS)), (F.pmod(i, F.lit(len(TOPICS))) + 1).cast("int"))
    return F.when(has("quadratic"), "quadratic").when(has("arithmetic progression", r"\bap\b"), "progression").when(has("triangle", "pythag"), "triangle").when(has("probab"), "probability").when(has("volume", "surface"), "volume").when(has("electric", "current"), "circuit").when(has("heat"), "heat").when(has("hcf", "lcm", "prime"), "primes").otherwise(turn)


def questions(spark: SparkSession, n: int, topic: str = "", seed: int = 1) -> DataFrame:
    """number, topic, question_type, text, answer."""
    assert 1 <= n <= 50
    i = F.col("i")
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("i")).withColumn("topic", routed(F.lit(topic), i - 1)).withColumn("question_type", F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(i - 1, F.lit(3)) + 1).cast("int")))
    rows = rows.withColumn("a", pick([2, 3, 4, 5, 6], seed, i, F.lit("a"))).withColumn("b", pick([3, 5, 7, 8, 12], seed, i, F.lit("b"))).withColumn("n", pick([10, 12, 15, 20, 30], seed, i, F.lit("n")))
    a, b, m = F.col("a"), F.col("b"), F.col("n")
    say = F.format_string
    text = {
        "quadratic": say("Find the discriminant of %dx^2 + %dx + 1 = 0.", a, b),
        "progression": say("Find the sum of the first %d terms of the AP with first term %d and common difference %d.", m, a, b),
        "triangle": say("The legs of a right triangle are %d cm and %d cm. Find the square of its hypotenuse.", a, b),
        "section": say("Twice the x-coordinate of the midpoint of (%d, 0) and (%d, 0) is?", a, b),
        "primes": say("The HCF of %d and %d is? Their product is HCF x LCM.", m, b),
        "probability": say("A bag holds %d red and %d blue balls. How many of 1000 draws are red on average, rounded down?", a, b),
        "volume": say("Two cubes have edges in the ratio %d : %d. Find the cube of the first number.", a, b),
        "circuit": say("A current flows through %d ohm at %d volt. Find it in milliampere, rounded down.", a, m),
        "heat": say("Find the heat in joule that %d ampere make in %d ohm within %d s.", a, b, m),
        "venn": say("Of %d pupils, %d play chess and %d draw, none does both. How many do neither?", m + 30, a, b),
    }
    answer = {
        "quadratic": b * b - 4 * a,
        "progression": F.expr("n * (2 * a + (n - 1) * b) div 2"),
        "triangle": a * a + b * b,
        "section": a + b,
        "primes": gcd(m, b),
        "probability": F.expr("1000 * a div (a + b)"),
        "volume": a * a * a,
        "circuit": F.expr("1000 * n div a"),
        "heat": a * a * b * m,
        "venn": m + 30 - a - b,
    }

    def by_topic(found: dict[str, Column]) -> Column:
        out = F.lit(None)
        for k, v in found.items():
            out = F.when(F.col("topic") == k, v).otherwise(out)
        return out

    return rows.select(i.alias("number"), "topic", "question_type", by_topic(text).alias("text"), by_topic({k: v.cast("bigint") for k, v in answer.items()}).alias("answer"))


SVG = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 200 150">%s</svg>'


def figure(topic: Column, a: Column, b: Column) -> Column:
    """A drawing for the topics that have one: a right triangle with its legs, a circle with a tangent, two overlapping sets; else null."""
    text = lambda x, y, value: F.concat(F.lit(f'<text x="{x}" y="{y}">'), value.cast("string"), F.lit("</text>"))
    triangle = F.concat(F.lit('<polygon points="20,130 180,130 20,20" fill="none" stroke="black"/>'), text(100, 145, a), text(5, 80, b))
    tangent = F.concat(F.lit('<circle cx="80" cy="75" r="50" fill="none" stroke="black"/><line x1="130" y1="10" x2="130" y2="140" stroke="black"/>'), text(100, 70, a))
    venn = F.concat(F.lit('<circle cx="75" cy="75" r="45" fill="none" stroke="black"/><circle cx="125" cy="75" r="45" fill="none" stroke="black"/>'), text(50, 80, a), text(140, 80, b))
    drawn = F.when(topic == "triangle", triangle).when(topic == "section", tangent).when(topic == "venn", venn)
    return F.concat(F.lit(SVG.split("%s")[0]), drawn, F.lit(SVG.split("%s")[1]))
