"""Steps in Python hold a bounded part of a batch or group as Python objects."""

import json
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import functions as F

from annalist.functions import stem, text
from annalist.operators import agent


def test_stems_take_each_different_word_of_a_batch_once(monkeypatch):
    seen = []
    monkeypatch.setattr(stem, "stem", lambda w: seen.append(w) or w.rstrip("s"))
    lists = pa.array([["x"], ["ships", "sail", "ships"], None, [], ["ships", "a"]], pa.list_(pa.string()))
    assert stem._stems.func(lists.slice(1)).to_pylist() == [["ship", "sail", "ship"], None, [], ["ship", "a"]]
    assert sorted(seen) == ["sail", "ships"]


def test_common_subsequence_of_arrow_lists():
    a = pa.array([["q"], ["a", "b", "c", "a"], None, [], ["a"]], pa.list_(pa.string())).slice(1)
    b = pa.array([["b", "a", "a"], ["a"], ["a"], ["b"]], pa.list_(pa.string()))
    assert text._common_subsequence.func(a, b).to_pylist() == [2, 0, 0, 0]


def test_chunks_are_cut_a_few_texts_at_a_time(spark, monkeypatch):
    held = []
    split = text._split_text
    texts = [None if i % 9 == 4 else "one two. " * (i % 40) for i in range(200)]
    column = lambda: text.split_chunks(F.col("t"), 50, 10)
    got = dict(spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column()).collect())
    assert got == {i: split(t or "", 50, 10) for i, t in enumerate(texts)}
    monkeypatch.setattr(text, "FEW", 8)
    real = pa.StringArray.to_pylist
    made = []
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda c: c))
    column()

    class Texts:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            held.append(n)
            return self.values.slice(at, n)

    whole = pa.array([t or "" for t in texts])
    assert made[0](Texts(whole)).to_pylist() == [split(t, 50, 10) for t in real(whole)] and set(held) == {8}


def test_tool_outputs_equal_the_tools_and_gather_no_subject_in_python(spark):
    rows = [("a", i, None if i % 3 else str(date(2024, 1, 1 + i)), None if i == 5 else f"T{i % 2}", None if i == 7 else f"Text {i}\nof a LICENSE" if i % 2 else "x" * 120) for i in range(12)]
    rows += [("b", 9, None, "License\nof", "only"), (None, 3, "2024-02-02", "t", "no"), (None, 8, "", "t", "second")]
    got = agent.tool_outputs(spark.createDataFrame(rows[::-1], "subject_id string, note_idx bigint, note_date string, note_title string, text string"))
    assert "InPandas" not in got._jdf.queryExecution().toString()
    want = set()
    for subject in ("a", "b", None):
        notes = [{"note_date": d, "note_title": t or "", "text": x or ""} for s, _, d, t, x in rows if s == subject]
        for name, args in (("meta", {}), ("search", {"keywords": ["license"], "match": "all"}), ("note", {"note_id": 1}), ("note", {"note_id": 10**9}), ("note", {}), ("other", {})):
            want.add((subject, f"{name} {json.dumps(args, sort_keys=True)}", agent.call(notes, name, args)))
    assert set(map(tuple, got.collect())) == want and got.count() == 18


def test_small_keys_are_matched_together(spark, monkeypatch):
    """A call for each key and date cost more than its match; a bucket of many gives the same."""
    from annalist.operators import matching

    kind = "k bigint, fact_idx bigint, fact string, fact_date date"
    rows = [(k, i, f"the ship {k * i % 7} sails {i % 3}", date(2024, 1, 1 + i % 3) if i % 4 else None) for k in range(60) for i in range(5)]
    left, right = spark.createDataFrame(rows, kind), spark.createDataFrame([(k, i, f"{t} home", d) for k, i, t, d in rows if (k + i) % 5], kind)
    run = lambda: matching.best_matches(left, right, "k")
    plan = run()._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"FlatMapCoGroupsInPandas[^\n]*\n[^\n]*Project \[bucket#", plan), plan  # the key of the groups comes first
    best = lambda: sorted((r["k"], r["side"], r["fact_idx"], r["shared"] / r["total"]) for r in run().collect())
    together = best()
    monkeypatch.setattr(matching, "TOGETHER", 1)
    assert together == best() and len(together) == 300 + right.count()


def test_summaries_are_asked_of_the_provider_with_whole_notes(spark):
    silent = lambda prompts: [None if "SILENT" in p else f"said:{p}" for p in prompts]
    rows = [("a", i, None if i else "2024-01-01", f"T{i}", f"text {i} " + "x" * 300) for i in range(3)]
    rows += [("b", 9, None, None, "only {one}"), (None, 3, "2024-02-02", "t", "no"), (None, 8, "", "t", None), ("c", 0, None, "t", "SILENT")]
    df = spark.createDataFrame(rows[::-1], "subject_id string, note_idx bigint, note_date string, note_title string, text string")
    got = {(r["subject_id"], r["tool"]): r["output"] for r in agent.tool_outputs(df, silent).collect() if r["tool"].startswith("summary")}
    args, want = {"note_ids": [1, 0, 10**9]}, {}
    for subject in ("a", "b", "c", None):
        notes = [{"note_date": d, "note_title": t or "", "text": x or ""} for s, _, d, t, x in rows if s == subject]
        want |= {(subject, f"summary {json.dumps(args)}"): agent.call(notes, "summary", args, silent), (subject, "summary {}"): "no note ids"}
    assert got == want
    first = got["a", f"summary {json.dumps(args)}"]
    assert first.startswith("said:Summarize") and first.index("Note ID: 1\nNote Title: T1\nNote Date: \nText:\ntext 1 " + "x" * 300) < first.index("Note Title: T0\nNote Date: 2024-01-01")
    assert "note_id 1000000000 is not in 0..2" in first and "note_id 1 is not in 0..0" in got["b", f"summary {json.dumps(args)}"]
    assert got["c", f"summary {json.dumps(args)}"] == "tool error (summary): no answer"
    assert agent.call([], "summary", {"note_ids": ["x"]}, silent).startswith("tool error (summary)")


def test_the_query_of_all_tools_has_the_summary(spark):
    from annalist.queries import QUERIES

    tools = {}
    for r in QUERIES["udf_07"](spark, "/root/testdata/sf0.001").collect():
        tools.setdefault(r["subject_id"], {})[r["tool"].split(" ")[0]] = r["output"]
    assert len(tools) == 20 and all(set(t) == {"meta", "search", "note", "summary", "other"} for t in tools.values())
