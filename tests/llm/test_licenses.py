"""Operator 10: windows, bands and containment against brute force and the query's SQL."""

import os
import random
import re

import duckdb
import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import licenses  # noqa: E402
from annalist.llm.queries import ORACLE, QUERIES  # noqa: E402


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(texts, forms):
    out = set()
    for i, text in enumerate(texts):
        g = grams(text)
        for name, form in forms:
            want = set(grams(form))
            q = licenses.size_class(len(want))
            shared = [len(want & set(g[w * q : w * q + 2 * q])) for w in range(-(-len(g) // q))]
            good = [w for w, k in enumerate(shared) if 1000 * k >= 800 * len(want)]
            if good:
                out.add((i, name, len(want), max(shared), good[0]))
    return out


def edited(r, form, edits):
    w = form.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = "edited%d" % r.randrange(10**6)
    return " ".join(w)


def test_edited_texts_between_others(spark):
    r = random.Random(11)
    noise = lambda n: " ".join("w%d" % r.randrange(3000) for _ in range(n))
    texts = [None, "", "!!", "Released under the MIT License"]
    for name, form in licenses.TEMPLATES:
        for _ in range(12):
            n = len(form.split())
            texts.append(" ".join([noise(r.randrange(3 * n)), edited(r, form, r.randrange(1 + n // 22)), noise(r.randrange(3 * n))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(x) for x in licenses.scan(docs, licenses.templates(spark)).collect()}
    want = brute(texts, licenses.TEMPLATES)
    assert got == want and len({x[0] for x in want}) > 150 and {x[1] for x in want} == {n for n, _ in licenses.TEMPLATES}


def test_miss_bound_and_shares_near_the_limit(spark):
    assert max(licenses.miss(n) for n in range(1, 5000)) < 1e-5
    r = random.Random(12)
    # the worst class: 17 shingles of which 14 are shared, in a window full of other words
    forms, texts = [], []
    for i in range(400):
        form = ["f%dx%d" % (i, j) for j in range(21)]
        forms.append((str(i), " ".join(form)))
        kept = form[:18] if i % 2 else form[3:]
        texts.append(" ".join(["a%d" % r.randrange(10**6) for _ in range(r.randrange(60))] + kept + ["b%d" % r.randrange(10**6) for _ in range(60)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(docs, licenses.templates(spark, forms)).collect()}
    assert got == {(i, n) for i, (n, _) in enumerate(forms)}


def test_hot_template_and_long_text(spark):
    mit = dict(licenses.TEMPLATES)["MIT-text"]
    long = " ".join([mit] * 600)  # 100,000 words
    docs = spark.createDataFrame([(1, long)] + [(i, mit) for i in range(2, 300)] + [(None, mit), (None, mit)], "doc_id bigint, text string")
    rows = licenses.scan(docs, licenses.templates(spark)).where("license = 'MIT-text'").collect()
    assert sorted(str(x["doc_id"]) for x in rows) == sorted(["None"] + [str(i) for i in range(1, 300)])
    assert {(x["n_shared"], x["first_window"]) for x in rows} == {(len(set(grams(mit))), 0)}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    names = ["doc_id", "license", "n_shingles", "n_shared", "first_window"]
    got = sorted(map(tuple, QUERIES["op10_licenses"](spark, d).select(*names).collect()))
    assert got == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op10_licenses']})").fetchall())
