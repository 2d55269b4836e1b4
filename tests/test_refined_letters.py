import pytest

import __spark_entry__


def test_texts_without_a_letter_are_refined_as_the_sql_says(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["É éé, é.", None, "", "é", "ü 12", "options yes", "see a graph", "É.", "a", "...", "x y", "zz"]
    rows = [(i, t, "fr", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in __spark_entry__.queries()["refined_chunks"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert found == {*con.execute(__spark_entry__.oracle_sql()["refined_chunks"]).fetchall()}
