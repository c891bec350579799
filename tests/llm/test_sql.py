"""The SQL of the operators whose rows it states, against DuckDB on hand-made tables and the smallest given ones."""

import random

import duckdb
import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import queries  # noqa: E402


def texts_and_items(seed=21):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "Of", "ünd", "日本", "a#b", "$5", "x|y", "<p>", "50%"] + [f"w{r.randrange(600)}" for _ in range(30)])
    line = lambda n: " ".join(word() for _ in range(n))
    items = [line(r.choice([1, 3, 5, 8, 20, 45])) for _ in range(60)] + ["", None, "  ", "same item of the set"] + ["same item of the set"]
    texts = [None, "", " \t\n\v", "one", "#", "\n\n\n"]
    for _ in range(120):
        lines = [line(r.randrange(1, 14)) for _ in range(r.randrange(1, 9))]
        lines += r.choices(lines, k=r.randrange(4)) + [r.choice(items) or ""] * r.randrange(2)
        r.shuffle(lines)
        texts.append(r.choice(["\n", "\n\n", " \n\t", "\r\n", " "]).join(lines))
    return texts, items


@pytest.mark.parametrize("name", ["op5_quality_rules", "op8_decontamination"])
def test_sql_says_the_same(spark, tmp_path, name):
    texts, items = texts_and_items()
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        con = duckdb.connect()
        for table in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'/*.parquet' if folder == str(tmp_path) else ''}'")
        cursor = con.sql(queries.ORACLE[name])
        df = queries.QUERIES[name](spark, folder)
        assert sorted(df.columns) == sorted(cursor.columns)
        want = sorted(map(str, cursor.project(", ".join(sorted(cursor.columns))).fetchall()))
        got = sorted(str(tuple(x)) for x in df.select(*sorted(df.columns)).collect())
        assert got == want and (folder != str(tmp_path) or len(got) > 0)
