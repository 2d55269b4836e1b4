import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, row string, id string, words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sample(seed=5, n=60):
    """Texts with copies, near copies, shared passages, long and empty ones, nulls, repeated rows; columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfgstéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda m: "".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + ["\n", ", ", ". "]) for _ in range(m))
    base, passage = text(120), text(40)
    rows = []
    for i in range(n):
        kind = i % 10
        t = base if kind == 0 else base.replace(" a", " b", 1 + i % 3) if kind == 1 else text(30) + passage + text(20) if kind == 2 else text(rng.randint(1, 150))
        if i == 7:
            t = text(3000)
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "same same same same"), (905, "same same same same"), (906, "  two  spaces   three "), (907, "日本語 текст <|endoftext|> 🙂"), (None, "a null key with some words in it")]
    return rows


@pytest.fixture(scope="session")
def texts():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(k, t, "en", "src", len(t or ""), "x", "y", "z", "u", "v") for k, t in texts], SCHEMA).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.filter("doc_id < -1")
