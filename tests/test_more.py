"""Operators without SQL against brute force, on the smallest tables or on fixtures."""

import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import agent as G
from annalist.operators import pairwise as P
from annalist.operators import providers as M
from annalist.operators import retrieval as R
from annalist.operators import tables as S
from annalist.plans import views as V
from annalist.queries import QUERIES
from annalist.sources import folders, readers, sinks

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


def slow_chunks(text, size, overlap):
    for sep in ("\n\n", "\n", ". ", " "):
        if sep in text:
            out, now = [], ""
            for piece in (p + sep for p in text.split(sep)):
                if len(now) + len(piece) > size:
                    out.append(now.strip())
                    now = now[max(0, len(now) - overlap) :]
                now += piece
            return [x for x in (*out, now.strip()) if x] or hard(text, size, overlap)
    return hard(text, size, overlap)


def hard(text, size, overlap):
    return [x for x in (text[i : i + size].strip() for i in range(0, len(text), size - overlap)) if x]


def test_chunks(spark):
    texts = ["", " \n ", "a\tb" * 50, "one two  three\t" * 30, "p1\n\np2 is longer\n\n\tp3 \n\n" * 9, "no separators" * 0 + "x" * 100, "a. b. c. " * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    for size, overlap in ((40, 7), (100, 0), (13, 5)):
        got = {r["i"]: r["c"] for r in df.select("i", T.split_chunks(F.col("text"), size, overlap).alias("c")).collect()}
        assert got == {i: slow_chunks(t or "", size, overlap) for i, t in enumerate(texts)}


def test_chunk_retrieval(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    notes = V.notes(spark, DATA).collect()
    got = defaultdict(list)
    for r in rows(spark, "ret_02_chunks"):
        got[r["question_id"]].append((r["rank"], r["chunk_id"], r["score"]))
    tok = lambda t: re.findall(r"\b\w+\b", t.lower())
    for q in V.questions(spark, DATA).collect():
        seen = [n for n in notes if n["subject_id"] == q["subject_id"] and n["note_date"] and n["note_date"] <= q["cutoff"]]
        units = [(n["note_idx"], i, tok(c)) for n in seen for i, c in enumerate(slow_chunks(n["text"], 4000, 400))]
        if not units:
            continue
        df = Counter(w for _, _, t in units for w in set(t))
        mean = sum(len(t) for _, _, t in units) / len(units)
        idf = {w: math.log((len(units) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf)
        score = lambda t, c: sum((floor if idf[w] < 0 else idf[w]) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in tok(q["natural_query"]) if w in idf)  # noqa: B023, E731
        want = sorted(((-round(score(t, Counter(t)), 6), n, i) for n, i, t in units))[:50]
        assert [(x[1], pytest.approx(x[2], abs=2e-6)) for x in sorted(got[q["question_id"]])] == [(f"{q['subject_id']}_{n}_{i}", -s) for s, n, i in want] or {x[1] for x in got[q["question_id"]]} == {f"{q['subject_id']}_{n}_{i}" for _, n, i in want}
    assert docs and items


def test_note_candidates(spark):
    df = spark.createDataFrame([("q", 1, 0.5), ("q", 1, 0.9), ("q", 2, 0.9), ("q", 3, 0.4), ("q", 4, -1.0)], "k string, note_idx bigint, score double")
    assert [(r["note_idx"], r["score"], r["rank"]) for r in R.note_candidates(df, "k", 2, 0.4).collect()] == [(1, 0.9, 1), (2, 0.9, 2)]


def test_elo_in_the_seeded_order(spark):
    games = sorted((r.asDict() for r in V.pairwise(spark, DATA).withColumn("overall", P.majority(*P.DIMENSIONS)).collect()), key=lambda r: r["ord"])
    order = np.random.RandomState(42).permutation(len(games))
    assert {r["ord"]: r["turn"] for r in rows(spark, "win_02")} == {games[i]["ord"]: k for k, i in enumerate(order)}
    dims = (*P.DIMENSIONS, "overall")
    rating = defaultdict(lambda: dict.fromkeys(dims, 1000.0))
    for i in order:
        g = games[i]
        for dim in dims:
            a, b = rating[g["model_a"]][dim], rating[g["model_b"]][dim]
            won = {"A": 1.0, "B": 0.0}.get(g[dim], 0.5)
            e = 1 / (1 + 10 ** ((b - a) / 400))
            rating[g["model_a"]][dim] += 32 * (won - e)
            rating[g["model_b"]][dim] -= 32 * (won - e)
    got = rows(spark, "win_01")
    assert {r["model"]: [r[f"elo_{x}"] for x in dims] for r in got} == {m: [round(x[y], 1) for y in dims] for m, x in rating.items()}
    assert [r["elo_overall"] for r in got] == sorted((r["elo_overall"] for r in got), reverse=True)
    assert sum(r["total"] for r in got) == 2 * len(games)


def test_redundant_facts_go(spark):
    facts = [("s", i, f"f{i % 7}") for i in range(60)] + [("t", i, f"g{i}") for i in range(30)]
    df = spark.createDataFrame(facts, "subject string, fact_idx bigint, fact string")
    out = S.drop_redundant(df, "subject", M.repeats("subject"), sinks.kept, group=10, passes=3, least=2).collect()
    kept = [r["fact_idx"] for r in out if r["subject"] == "s"]
    assert len([r for r in out if r["subject"] == "t"]) == 30
    assert {facts[i][2] for i in kept} == {f"f{i}" for i in range(7)} and len(kept) < 60 / 10 * 7
    assert S.drop_redundant(df.limit(0), "subject", M.repeats("subject"), sinks.kept).count() == 0


def test_shuffle_is_a_permutation(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), "id")
    got = S.shuffled(df, ["k"], "id", "7").collect()
    for k in (0, 1):
        assert sorted(r["place"] for r in got if r["k"] == k) == list(range(25))


def test_rolling_batches(spark):
    sizes = {"a": [5, 5, 1, 30, 2, 2, 9], "b": [20], "c": [0, 0, 10]}
    df = spark.createDataFrame([(k, i, n) for k, x in sizes.items() for i, n in enumerate(x)], "k string, i bigint, n bigint")
    got = {(r["k"], r["o"]): r["batch"] for r in S.rolling_batches(df, "k", F.col("i"), F.col("n"), 10).collect()}
    want = {}
    for k, x in sizes.items():
        batch = used = 0
        for i, n in enumerate(x):
            if used and used + n > 10:
                batch, used = batch + 1, 0
            used += n
            want[(k, i)] = batch
    assert got == want


def test_longest_common_subsequence_and_overlap(spark):
    pairs = [("a b c d", "b x c d e"), ("a a a", "a a"), ("", "a"), ("x y z", "z y x"), ("a b", "c d")]
    df = spark.createDataFrame(pairs, "c string, r string").select(F.filter(F.split("c", " "), lambda w: w != "").alias("c"), F.filter(F.split("r", " "), lambda w: w != "").alias("r"))
    got = [tuple(round(v, 6) for v in r) for r in df.select(T.rouge_l(F.col("c"), F.col("r")), T.rouge_n(F.col("c"), F.col("r"), 1), T.rouge_n(F.col("c"), F.col("r"), 2)).collect()]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for (c, r), g in zip(pairs, got):
        a, b = c.split(), r.split()
        grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        f = lambda x, n: 2 * x / n if n else 0.0
        want = [f(lcs(a, b), len(a) + len(b))] + [f((grams(a, n) & grams(b, n)).total(), (grams(a, n).total() + grams(b, n).total())) for n in (1, 2)]
        assert g == tuple(round(v, 6) for v in want)


def test_long_texts_stay_linear(spark):
    import time

    words = " ".join(f"w{i % 5000}" for i in range(60_000))
    df = spark.createDataFrame([(words, words)], "c string, r string")
    started = time.time()
    out = df.select(T.bleu(F.split("c", " "), F.split("r", " "), 2).alias("b"), T.split_chunks(F.col("c"), 4000, 400).alias("s")).first()
    assert abs(out["b"] - 1) < 1e-9 and len(out["s"]) > 80 and time.time() - started < 30


def test_agent_and_tools(spark):
    notes = [{"note_date": "2024-01-02", "note_title": "A", "text": "under the License"}, {"note_date": None, "note_title": "B", "text": "nothing"}]
    out = G.run("q?", notes, G.scripted)
    assert json.loads(out["tools"]) == ["search", "note"] and out["answer"].startswith("read")
    assert json.loads(G.run("q?", notes[1:], G.scripted)["tools"]) == ["search"]
    assert G.run("q?", [], lambda p: {"draft": "d", "stop": True})["n_steps"] == 0
    recent, summary = G.compacted([{"tool": None, "draft": str(i)} for i in range(14)], "s", 10)
    assert [s["draft"] for s in recent] == [str(i) for i in range(4, 14)] and summary == "s; 0; 1; 2; 3"
    endless = G.run("q?", notes, lambda p: {"draft": "d", "tool": {"name": "meta"}}, steps=25)
    assert endless["n_steps"] == 25
    by_subject = defaultdict(list)
    for n in sorted(V.notes(spark, DATA).collect(), key=lambda n: n["note_idx"]):
        by_subject[n["subject_id"]].append(n)
    for r in rows(spark, "udf_07"):
        held = by_subject[r["subject_id"]]
        name = r["tool"].split(" ")[0]
        if name == "meta":
            assert r["output"].startswith(f"{len(held)} notes")
        elif r["tool"] == 'note {"note_id": 1}':
            assert r["output"] == held[1]["text"]
        elif r["tool"] == "note {}":
            assert r["output"].startswith("tool error (note)")
        elif name == "other":
            assert r["output"] == "unknown tool: other"
    seen = {q["question_id"] for q in R.as_of(V.questions(spark, DATA), V.notes(spark, DATA)).select("question_id").collect()}
    assert {r["question_id"] for r in rows(spark, "win_11")} == seen


def test_token_match(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "", "a"), (3, "a b", "a zz")], "i bigint, c string, r string")
    got = {r["i"]: r for r in M.token_match(df, ["i"]).collect()}
    assert got[1]["f1"] == 1.0 and got[2]["f1"] == 0.0
    v = np.array(M.hashed(["a", "b", "zz"]))[:, 1:]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v[:2] @ v[[0, 2]].T
    assert got[3]["precision"] == round(float(s.max(axis=1).mean()), 6) and got[3]["recall"] == round(float(s.max(axis=0).mean()), 6)


def test_accumulated_answers(spark):
    got = {r["seed"]: r for r in rows(spark, "oth_01")}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        answer, n = "", 0
        for i in range(0, max(1, len(d["text"])), 2000):
            new = M.echo([f"{answer}\n{d['text'][i : i + 2000]}"])[0]
            if new is None:
                break
            answer, n = new, n + 1
        assert not n or (got[str(d["doc_id"])]["answer"], got[str(d["doc_id"])]["n_updates"]) == (answer, n)


def test_snapshots_and_stages(spark, tmp_path):
    base = f"{tmp_path}/t"
    for n in (3, 5):
        sinks.replace(spark.range(n), base)
        assert sinks.current(spark, base).count() == n
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    assert [sinks.staged(spark, f"{tmp_path}/s", "one", build).count() for _ in range(2)] == [4, 4] and len(calls) == 1


def test_note_table_is_strict(spark, tmp_path):
    spark.createDataFrame([("not a date", "t", "x")], "note_date string, note_title string, text string").write.json(f"{tmp_path}/n.json")
    with pytest.raises(Exception, match="not a date"):
        readers.note_table(spark, f"{tmp_path}/n.json").collect()
    spark.createDataFrame([("2024-01-01", "t")], "note_date string, note_title string").write.option("header", True).csv(f"{tmp_path}/n.csv")
    with pytest.raises(ValueError, match="text"):
        readers.note_table(spark, f"{tmp_path}/n.csv")
    with pytest.raises(ValueError):
        T.prompt_assets("[1]")
    assert folders.scratch(spark, "x") != folders.scratch(spark, "x")
