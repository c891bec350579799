"""Exact dedup by content sort: against brute force, over many parts, with hot and odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import exact  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(seed=5):
    r = random.Random(seed)
    texts = ["A hot text of many copies", "a HOT text of many copies", None, "", "É stays", "é stays", "İstanbul", "istanbul", "straße", "STRASSE", " lead", "lead", "x" * 300_000, "X" * 299_999 + "y", "\x00퟿", "日本"]
    rows = [(i, r.choice(texts[:2]), "en") for i in range(400)] + [(1000 + i, r.choice(texts), "en") for i in range(200)]
    rows += [(2000 + i, "shared head " * 8 + str(r.randrange(40)), None) for i in range(100)] + [(2000, "A hot text of many copies", "fr"), (3, rows[3][1], "fr"), (None, None, "a"), (None, "only without an id", "a"), (None, "Only without an id", "b")]
    r.shuffle(rows)
    return rows


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(ASCII)].append(i)
    out = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = (max if largest else min)(named) if named else None
        left = 1
        for i in ids:
            out[i, keep, len(ids), i == keep and left == 1, hashlib.sha256(text.encode()).hexdigest()] += 1
            left -= i == keep
    return out


@pytest.mark.parametrize("keep,parts", [("largest", 1), ("largest", 9), ("smallest", 25), ("smallest", None)])
def test_marks_equal_brute_force(spark, keep, parts):
    rows = rows_of()
    got = exact.mark(spark.createDataFrame(rows, SCHEMA).repartition(5), keep, parts)
    assert Counter(map(tuple, got.collect())) == brute(rows, keep == "largest")


def test_a_run_is_held_in_pieces(spark, monkeypatch):
    rows = rows_of(8)
    monkeypatch.setattr(exact, "RUN", 7)
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    run = exact._runs.__code__  # the constant is read in the worker, so the generator is driven here
    assert "RUN" in run.co_names
    import pandas as pd

    monkeypatch.setattr(exact, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    part = sorted(((t or "").translate(ASCII), i) for i, t, _ in rows if i is not None)
    marks = pd.concat(list(exact._runs(iter([pd.DataFrame(part[:50], columns=["norm", "doc_id"]), pd.DataFrame(part[50:], columns=["norm", "doc_id"])]))))
    assert len(marks) == len(part) and marks["size"].max() <= 7 and frame.count() == len(rows)
    sizes = marks[marks["first"]].groupby("text_sha256")["size"].sum()
    want = Counter(hashlib.sha256(t.encode()).hexdigest() for t, _ in part)
    assert sizes.to_dict() == dict(want)
    again = marks[marks["first"]].groupby("text_sha256").agg(n=("run", "size"), open=("open", "all"))
    assert again[again["n"] > 1]["open"].all()


def test_the_rest_of_a_row_stays_and_names_may_clash(spark):
    rows = rows_of(6)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "lang keep_id", "lang norm", "lang part", "lang bytes", "lang n", "lang Keep_Sha", "lang row")
    got = exact.dedup(docs, parts=6)
    assert got.columns == docs.columns
    want = [k[0] for k, n in brute(rows, False).items() for _ in range(n) if k[3] or k[0] is None and k[1] is None]
    kept = [r["doc_id"] for r in got.collect()]
    assert Counter(i for i in kept if i is not None) == Counter(i for i in want if i is not None)
    assert kept.count(None) == 1  # of the two that differ in A-Z only
    assert exact.mark(spark.createDataFrame([], SCHEMA)).collect() == [] and exact.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        exact.mark(docs, "first")


def test_splitters_cut_parts_of_near_equal_bytes(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text").otherwise(F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 7).cast("int"))).alias("text"))
    texts = docs.withColumn("bytes", F.octet_length("text") + exact.ROW_BYTES)
    weight = texts.agg(F.sum("bytes")).first()[0]
    bounds = exact.splitters(texts, 16, weight)
    key = exact._key(exact.normal(F.col("text")))
    sizes = [r["s"] for r in texts.groupBy(exact._part(key, bounds).alias("p")).agg(F.sum("bytes").alias("s")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2.5 * weight / 16
    assert len({b["id"] for b in bounds if b["head"] == "one hot text"}) >= 3
