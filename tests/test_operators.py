"""Behaviour on hand-made inputs."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import facts, pairwise, providers, tables, timeline
from annalist.plans import views as V
from annalist.sources import readers, sinks
from annalist.streaming import incremental

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reversed_order_is_not_flipped_twice(spark):
    rows = [("x", "y", "ab", "A"), ("y", "x", "ba", "B")]
    got = {r["model"]: r for r in pairwise.win_rates(spark.createDataFrame(rows, "model_a string, model_b string, position string, w string"), "w").collect()}
    assert got["x"]["wins"] == 2 and got["x"]["win_rate"] == 1.0 and got["y"]["losses"] == 2


@pytest.mark.parametrize("dates,want", [(["2024-01-01"], "before_cutoff"), (["2024-03-01"], "after_cutoff"), (["2024-01-01", "2024-03-01"], "spans_cutoff"), ([None], "undated"), (["2024-02-01"], "at_cutoff")])
def test_timeline_classes(spark, dates, want):
    rows = [("k", d and date.fromisoformat(d), date(2024, 2, 1)) for d in dates]
    df = spark.createDataFrame(rows, "k string, note_date date, cutoff date")
    assert timeline.timeline_class(df, ["k"]).first()["timeline_position"] == want


def test_leakage_and_overlap(spark):
    rows = [("k", date(2020, 1, 1), date(2020, 2, 1)), ("k", date(2020, 3, 1), date(2020, 2, 1)), ("k", None, date(2020, 2, 1))]
    r = timeline.leakage(spark.createDataFrame(rows, "k string, note_date date, cutoff date"), ["k"]).first()
    assert (r["n_future"], r["n_undated"]) == (1, 1)
    o = one(spark, timeline.date_overlap(F.lit(["2020-01-01", "2020-02-01"]), F.lit(["2020-02-01"])))
    assert (o["precision"], o["recall"]) == (1.0, 0.5)


def test_support_lists(spark):
    r = one(spark, facts.support_lists(F.lit(["a", "b", "c"]), F.lit([0, 2])))
    assert r["unsupported"] == 1 and r["rate"] == pytest.approx(1 / 3)
    r = one(spark, facts.support_lists(F.array().cast("array<string>"), F.array().cast("array<int>")))
    assert (r["precision"], r["rate"]) == (1.0, 0.0)


def test_incomplete_verdicts_fail(spark):
    with pytest.raises(Exception, match="incomplete"):
        facts.require_complete(spark.createDataFrame([("k", None)], "k string, vote boolean"), ["k"]).collect()


def test_elo_is_zero_sum_and_sequential(spark):
    games = [(0, "x", "y", "A"), (1, "y", "x", "B"), (2, "x", "z", "TIE"), (3, "z", "y", "A"), (4, "x", "x", "A")]
    got = {r["model"]: r["elo"] for r in pairwise.elo(spark.createDataFrame(games, "ord int, model_a string, model_b string, w string"), "w", "ord").collect()}
    want = {}
    for _, a, b, w in games[:4]:
        ra, rb = want.get(a, 1000.0), want.get(b, 1000.0)
        gain = 32 * ({"A": 1.0, "B": 0.0}.get(w, 0.5) - 1 / (1 + 10 ** ((rb - ra) / 400)))
        want |= {a: ra + gain, b: rb - gain}
    assert got == {k: round(v, 1) for k, v in want.items()} and sum(got.values()) == pytest.approx(3000, abs=0.2)


def slow_split(t, size, overlap):
    """Every piece keeps a separator, the last one too; chunks are stripped of all white space."""
    sep = next((s for s in T.SEPARATORS if s in t), None)
    if sep is None:
        return [x for x in (t[i : i + size].strip() for i in range(0, len(t), size - overlap)) if x]
    out, now = [], ""
    for p in (x + sep for x in t.split(sep)):
        if len(now) + len(p) > size:
            out.append(now.strip())
            now = now[max(0, len(now) - overlap) :] + p
        else:
            now += p
    return [x for x in [*out, now.strip()] if x]


@pytest.mark.parametrize("t", ["", "short", "ab cd " * 40, "x" * 130, "one. two. " * 20, "line one\nline two\n" * 15, "p1 p2\n\np3 " * 12])
def test_chunks(spark, t):
    assert one(spark, T.split_chunks(F.lit(t), 50, 10)) == slow_split(t, 50, 10)


def test_rolling_batches(spark):
    sizes = [3, 4, 20, 1, 1, 8, 3]
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate(sizes)], "k string, i bigint, n bigint")
    got = {r["o"]: r["batch"] for r in tables.rolling_batches(df, "k", F.col("i"), F.col("n"), 10).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 2, 2, 2, 3]


def test_parsers(spark):
    assert one(spark, T.parse_list(F.lit('["a", "b"]'))) == ["a", "b"] and one(spark, T.parse_list(F.lit("none"))) == []
    assert one(spark, T.parse_winner(F.lit('{"winner": " b "}'))) == "B" and one(spark, T.parse_winner(F.lit("{}"))) == "TIE"
    assert one(spark, T.lenient_json(F.lit('text {"a": 1} more')).isNotNull()) and one(spark, T.lenient_json(F.lit("no"))) is None
    assert one(spark, T.timestamp(F.lit("2020-01-01T10:00:00Z")).cast("string")) == "2020-01-01 10:00:00" and one(spark, T.timestamp(F.lit("2020"))) is None
    assert one(spark, T.span_of(F.lit("abc"), F.lit("bc"))) == [1, 3] and one(spark, T.span_of(F.lit("abc"), F.lit(""))) is None


def test_note_files_and_sinks(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "s1_subsetrecords.json").write_text(json.dumps([{"note_date": "2020-01-01", "note_title": "a", "text": "t"}, {"note_date": None, "note_title": "b", "text": "u"}]))
    (notes / "s2_subsetrecords.json").write_text("{}")
    assert [(r["subject_id"], r["note_idx"], r["note_title"]) for r in readers.note_files(spark, str(notes)).orderBy("note_idx").collect()] == [("s1", 0, "a"), ("s1", 1, "b")]
    with pytest.raises(Exception, match="not an array"):
        readers.note_files(spark, str(notes), strict=True).collect()
    base = str(tmp_path / "snap")
    for i in (1, 2):
        sinks.replace(spark.range(i), base)
    assert sinks.current(spark, base).count() == 2
    (tmp_path / "r.jsonl").write_text('{"key": "a", "status": "", "response": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}}\n{"custom_id": "b", "status": "bad"}\nbroken\n')
    got = {r["key"]: r["text"] for r in readers.shards(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got == {"a": "hi", "b": None}


def test_html_round_trip(spark):
    html = readers.to_html(F.array(F.struct(F.lit("é").alias("id"))))
    assert one(spark, readers.from_html(html, "array<struct<id:string>>"))[0]["id"] == "é"


def test_resume_and_providers(spark):
    tasks = spark.createDataFrame([("a", "p"), ("b", "qq"), ("c", " ")], "id string, prompt string")
    done = spark.createDataFrame([("a", "x"), ("b", " ")], "id string, text string")
    left = tables.pending(tasks, done, ["id"], "text")
    assert {r["id"]: r["text"] for r in providers.complete(left, providers.echo, "id").collect()} == {"b": "answer:2", "c": None}
    state = providers.turns(tasks.where("id <> 'c'"), providers.echo, "id", 2).collect()
    assert all(len(r["history"]) == 2 for r in state)
    batches = spark.createDataFrame([("k", 0, "a"), ("k", 1, "b")], "k string, batch bigint, text string")
    assert [r["answer"] for r in providers.rolling_answers(batches, providers.echo, "k", "{answer}|{text}").orderBy("batch").collect()] == ["answer:2", "answer:10"]


def test_stream_scores_each_key_once(spark, tmp_path):
    src, sink = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    sink.mkdir()
    schema = "id string, v bigint"
    for n in range(2):
        (src / f"{n}.json").write_text('{"id": "a", "v": 1}\n' + f'{{"id": "x{n}", "v": 2}}\n')
        stream = spark.readStream.schema(schema).json(str(src))
        incremental.score_new(stream, lambda df: df, str(sink), ["id"], str(tmp_path / "cp"), schema).awaitTermination()
    assert sorted(r["id"] for r in spark.read.schema(schema).json(str(sink)).collect()) == ["a", "x0", "x1"]


def plain_bleu(c, r, n):
    """BLEU by counting, one order at a time."""
    import math
    from collections import Counter

    if not set(c) & set(r):
        return 0.0
    total = 0.0
    for k in range(1, n + 1):
        grams = [Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (c, r)]
        hits = sum((grams[0] & grams[1]).values())
        total += math.log((hits or 0.1) / max(1, sum(grams[0].values())))
    return math.exp(min(0.0, 1 - len(r) / len(c)) + total / n)


def test_bleu(spark):
    pairs = [("a b c d", "a b c d"), ("a b", "a b c d e"), ("a a a b", "a b a"), ("x", "y"), ("", "a"), ("a", ""), ("", "")]
    df = spark.createDataFrame([(c.split(), r.split()) for c, r in pairs], "c array<string>, r array<string>")
    got = df.select("c", "r", *[T.bleu(F.col("c"), F.col("r"), n).alias(f"b{n}") for n in (1, 2, 3, 4)]).collect()
    for row in got:
        for n in (1, 2, 3, 4):
            assert abs(row[f"b{n}"] - plain_bleu(row.c, row.r, n)) < 1e-12


def test_literals_and_atoms(spark):
    texts = ['["a"]', "['it\\'s', 'b']", "('a', 2)", "{'a': 1}", "[", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.parse_literals(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [["a"], ["it's", "b"], ["a", "2"], [], [], [], []]
    texts = ['[{"text":"a","source_idx":3}]', '["a"]', "[]", '[{"text":"a"}]', '["a",{"text":"b","source_idx":1}]', "oops", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.parse_atoms(F.col("t")).alias("v")).orderBy("i").collect()
    assert [None if r.v is None else [tuple(x) for x in r.v] for r in got] == [[("a", 3)], [("a", None)], [], None, None, None, None]


def test_jobs_fill_to_the_limit(spark):
    from annalist.operators import tables as S

    keys = [(k,) for k in [5, 1, 9, 9, 200, 7, 3]]
    got = S.jobs(spark.createDataFrame(keys, "k bigint"), "k", limit=3, block=4).orderBy("job", "k").collect()
    assert [(r.k, r.job) for r in got] == [(1, 0), (3, 0), (5, 0), (7, 1), (9, 1), (9, 1), (200, 2)]
    assert S.jobs(spark.createDataFrame([], "k bigint"), "k").count() == 0


def test_stub_queries_run(spark):
    from annalist.queries import QUERIES

    asked = {r["question_id"]: r["natural_query"] for r in V.questions(spark, DATA).collect()}
    said = {r["question_id"]: r["text"] for r in QUERIES["udf_01"](spark, DATA).collect()}
    assert said == {k: f"answer:{len(q)}" if (q or "").strip() else None for k, q in asked.items()} and len(said) > 10
    assert QUERIES["fn_12"](spark, "/root/testdata/sf0.001").where("bleu_1 between 0 and 1").count() == QUERIES["fn_12"](spark, "/root/testdata/sf0.001").count()


def rolled(rows, provider):
    """``(key, batch, text)`` rows to the answers of each key in turn."""
    out, ended, last = set(), set(), {}
    for k, batch, text in sorted((k, b, t or "") for k, b, t in rows if k is not None):
        if k in ended:
            continue
        answer = provider([f"{last.get(k, '')}\n{text}"])[0]
        if answer is None:
            ended.add(k)
        else:
            last[k] = answer
            out.add((k, batch, answer))
    return out


def test_answers_roll_from_batch_to_batch(spark):
    from annalist.operators.providers import echo, rolling_answers
    from annalist.queries import QUERIES

    turns = [(str(r["conv_id"]), r["turn"], r["text"]) for r in V.read(spark, DATA, "conversations").collect()]
    got = [tuple(r) for r in QUERIES["win_09"](spark, DATA).select("conv_id", "batch", "answer").collect()]
    assert len(got) == len(turns) > 50 and set(got) == rolled(turns, echo)

    def count(prompts):
        """Fails at the third batch of a key, and for texts that say so."""
        n = int(prompts[0].split("\n")[0] or 0)
        return [None if n == 2 or "stop" in prompts[0] else str(n + 1)]

    rows = [("a", i, f"t{i}") for i in range(5)] + [("b", 0, "stop"), ("b", 1, "x"), ("c", 3, None), (None, 1, "x"), ("d", 2, "y"), ("d", 1, "z")]
    df = spark.createDataFrame(rows, "k string, batch int, text string")
    assert {tuple(r) for r in rolling_answers(df, count, "k", "{answer}\n{text}").collect()} == rolled(rows, count) == {("a", 0, "1"), ("a", 1, "2"), ("c", 3, "1"), ("d", 1, "1"), ("d", 2, "2")}
    assert rolling_answers(df.limit(0), count, "k", "{answer}\n{text}").count() == 0
