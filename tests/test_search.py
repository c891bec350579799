"""BM25 by the index, and dense and late-interaction search by cells, against brute force."""

import math
import random
import re
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest

from annalist.operators import lexical, retrieval, vectors
from annalist.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NOTES = "subject_id string, note_idx bigint, note_date date, text string"
ASKED = "question_id string, subject_id string, cutoff date, natural_query string"


def slow_bm25(questions, notes, k):
    out = set()
    for qid, subject, cutoff, query in questions:
        held = {i: re.findall(r"\b\w+\b", t.lower()) for s, i, d, t in notes if s == subject and d is not None and cutoff is not None and d <= cutoff}
        n, df = len(held), Counter(w for words in held.values() for w in set(words))
        weight = {w: math.log((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
        floor = 0.25 * sum(weight.values()) / len(weight) if weight else 0
        scores = {}
        for i, words in held.items():
            tf, avg = Counter(words), sum(map(len, held.values())) / n
            scores[i] = round(sum((weight[w] if weight[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / avg)) for w in re.findall(r"\b\w+\b", query.lower()) if tf[w]), 6)
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        out |= {(qid, i, scores[i], r + 1) for r, i in enumerate(ranked[:k])}
    return out


@pytest.mark.parametrize("k", [3, 10, None])
def test_bm25_equals_brute_force(spark, k):
    r = random.Random(k or 0)
    day = lambda: date(2024, 1, 1) + timedelta(days=r.randrange(40))
    words = ["the", "of", "été", "Straße", "x1", *[f"w{i}" for i in range(25)]]
    notes = [(str(s), i, r.choice([None, *[day() for _ in range(9)]]), r.choice(["", " - ", "the of"]) if r.random() < 0.1 else " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for s in range(3) for i in range(25)]
    notes += [("7", i, date(2024, 1, 2), "the same words the same") for i in range(6)]  # weights below zero, floors too
    asked = [(f"q{i}", r.choice("01279"), r.choice([None, day(), day(), day()]), " ".join(r.choice([*words, "unknown"]) for _ in range(r.randrange(0, 8)))) for i in range(40)]
    got = lexical.bm25(spark.createDataFrame(asked, ASKED), spark.createDataFrame(notes, NOTES), k)
    want = slow_bm25(asked, notes, k)
    near = lambda rows: {(q, i, rank): s for q, i, s, rank in rows}
    have, wanted = near(map(tuple, got.select("question_id", "note_idx", "score", "rank").collect())), near(want)
    assert have.keys() == wanted.keys() and all(abs(have[x] - wanted[x]) < 2e-6 for x in wanted) and len(wanted) > 50


def test_only_asked_terms_meet_their_postings(spark):
    """The joins of postings are on (subject, term, salt); nothing joins them on the subject alone."""
    notes = spark.createDataFrame([("0", i, date(2024, 1, 1 + i), "the old ship sails") for i in range(9)], NOTES)
    asked = spark.createDataFrame([("a", "0", date(2024, 2, 1), "ship")], ASKED)
    index = lexical.build_index(notes)
    plan = lexical._hits(asked.selectExpr("question_id", "subject_id", "cutoff", "xxhash64(natural_query) term", "1D weight", "4D avgdl"), index, 1.5, 0.75)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "term" in plan.split("Join ")[1].split("\n")[0] and "salt" in plan.split("Join ")[1].split("\n")[0]
    assert lexical.bm25(asked, index, 2).count() == 2


def clouds(n, dims, seed):
    """Vectors around 20 centers, as embeddings of a corpus lie, a few of zeros."""
    r = np.random.RandomState(seed)
    centers = r.randn(20, dims)
    rows = (centers[r.randint(0, 20, n)] + 0.4 * r.randn(n, dims)).round(3)
    rows[n // 2] = 0
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def slow_dense(rows, asked, k, threshold):
    v = np.array([x for _, x in rows])
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.where(norm > 0, norm, 1)
    out = {}
    for q in asked:
        s = np.round(v @ v[q], 6)
        ranked = [i for i in sorted(range(len(rows)), key=lambda i: (-s[i], i)) if threshold is None or s[i] >= threshold]
        out[q] = {i: s[i] for i in ranked[:k]}
    return out


@pytest.mark.parametrize("k,threshold", [(10, None), (50, 0.4), (None, 0.9)])
def test_search_without_probes_is_exact(spark, k, threshold):
    rows = clouds(900, 16, 3)
    df = spark.createDataFrame([*rows, (5000, None)], "vec_id bigint, vec array<float>")
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = vectors.build_cells(df.withColumnRenamed("vec_id", "item_id"))
    assert index.size.sum() == 900 and len(index.centers) == 30  # every row is indexed
    got = {}
    for x in vectors.search(asked, index, k, threshold).collect():
        got.setdefault(x["query_id"], {})[x["item_id"]] = x["score"]
    want = slow_dense([(i, np.float32(v).astype(float)) for i, v in rows], range(0, 900, 20), k, threshold)
    for q, best in want.items():
        have = got.get(q, {})
        assert len(have) == len(best) and sorted(have.values()) == pytest.approx(sorted(best.values()), abs=2e-6)
        assert all(i in have for i, s in best.items() if s > min(best.values()) + 2e-6)


def test_probed_search_has_a_recall_of_nine_tenths(spark):
    rows = clouds(4000, 16, 4)
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<float>")
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = vectors.build_cells(df.withColumnRenamed("vec_id", "item_id"))
    want = slow_dense([(i, np.float32(v).astype(float)) for i, v in rows], range(0, 4000, 20), 10, None)
    got = {(x["query_id"], x["item_id"]) for x in vectors.search(asked, index, 10, probes=8).collect()}
    hit = sum((q, i) in got for q, best in want.items() for i in best)
    assert hit >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("name,exact,folder", [("ret_04_probed", "ret_04", "sf0.01"), ("ret_09_probed", "ret_09", "sf0.01"), ("ret_04_probed", "ret_04", "sf0.1")])
def test_queries_with_probes_against_the_exact_ones(spark, name, exact, folder):
    found, all_ = ({(x["query_id"], x["item_id"]) for x in QUERIES[q](spark, f"/root/testdata/{folder}").collect()} for q in (name, exact))
    assert len(found & all_) >= 0.9 * len(all_)


@pytest.mark.parametrize("probes", [None, 4])
def test_late_search_against_brute_force(spark, probes):
    r = np.random.RandomState(7)
    centers = r.randn(12, 8)
    items = [(i, [[float(x) for x in centers[r.randint(12)] + 0.3 * r.randn(8)] for _ in range(r.randint(0, 6))]) for i in range(500)]
    df = spark.createDataFrame([*items, (900, None)], "id bigint, v array<array<double>>")
    asked = df.where("id % 20 = 0")
    got = vectors.late_search(asked.selectExpr("id query_id", "v q"), df.selectExpr("id item_id", "v c"), 10, probes).collect()
    have = {(x["query_id"], x["item_id"]): x["score"] for x in got}
    hit = total = 0
    for q, qv in items:
        if q % 20 or not qv:
            continue
        s = {i: float(np.round((np.array(qv) @ np.array(c).T).max(axis=1).sum(), 6)) for i, c in items if c}
        best = sorted(s, key=lambda i: (-s[i], i))[:10]
        total += 10
        hit += sum((q, i) in have for i in best)
        assert all(have[q, i] == pytest.approx(s[i], abs=2e-6) for i in s if (q, i) in have)
        if probes is None:
            assert sorted(v for (a, _), v in have.items() if a == q) == pytest.approx(sorted(s[i] for i in best), abs=2e-6)
    assert hit >= (0.9 if probes else 0.999) * total


def test_no_rows_and_no_cross_join(spark):
    none = spark.createDataFrame([], "query_id bigint, vec array<float>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vec array<float>")
    assert vectors.search(none, some.withColumnRenamed("query_id", "item_id")).count() == 0
    assert vectors.search(some, none.withColumnRenamed("query_id", "item_id")).count() == 0
    with pytest.raises(ValueError):
        vectors.search(some, some.withColumnRenamed("query_id", "item_id"), None)
    for name in ("ret_04", "ret_09"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert retrieval.bm25 is lexical.bm25 and retrieval.tokens is lexical.tokens


@pytest.mark.parametrize("late", [False, True])
def test_a_query_is_held_once_whatever_the_cells_it_visits(spark, monkeypatch, late):
    """A worker that held a query once a cell grew with the queries of a batch times the cells; ties stay at k a block too."""
    stored, store = [], vectors.kept
    monkeypatch.setattr(vectors, "kept", lambda df: stored.append(store(df)) or stored[-1])
    df = spark.createDataFrame([(i, v if i % 7 else [1.0] * 8) for i, v in clouds(400, 8, 5)], "id bigint, v array<double>")
    if late:
        df = df.selectExpr("id", "array(v, v) v")
        got = vectors.late_search(df.where("id % 20 = 0").selectExpr("id query_id", "v q"), df.selectExpr("id item_id", "v c"), 5)
    else:
        got = vectors.search(df.where("id % 20 = 0").selectExpr("id query_id", "v vec"), df.selectExpr("id item_id", "v vec"), 5)
    asked = [t for t in stored if "query_id" in t.columns]
    assert [t.count() for t in asked] == [20] and got.count() == 100
    if not late:
        same = got.where("query_id % 7 = 0").orderBy("query_id", "rank").select("item_id").collect()
        assert [r[0] for r in same] == [0, 7, 14, 21, 28] * 3  # the smallest ids among equal vectors
