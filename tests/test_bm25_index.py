"""The steps of the BM25 index: how terms are cut, dealt and counted, and what meets the texts."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_search import ASKED, NOTES, slow_bm25

from annalist.operators import lexical, retrieval
from annalist.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_spread_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(lexical, "PART", part)
    r = random.Random(1)
    day = lambda i: date(2024, 1, 1) + timedelta(days=r.randrange(9)) if i % 9 else date(1960, 1, 1 + i % 20)
    notes = [(str(r.randrange(3)), i, day(i), " ".join(r.choice("abcdefghij") for _ in range(r.randrange(6)))) for i in range(300)]
    found = lexical.build_index(spark.createDataFrame([*notes, ("9", 0, date(2024, 1, 1), None)], NOTES)).spread.collect()
    by_day, df, want = defaultdict(Counter), Counter(), Counter()
    for subject, _, when, text in notes:
        by_day[when].update((subject, w) for w in set(text.split()))
    for when in sorted(by_day):
        for (subject, w), n in by_day[when].items():
            want[subject, when, df[subject, w]] -= 1
            df[subject, w] += n
            want[subject, when, df[subject, w]] += 1
    assert {(x["subject_id"], x["note_date"], x["k"]): x["terms"] for x in found} == {at: n for at, n in want.items() if n and at[2]}


def test_spread_does_not_grow_with_the_notes_of_a_date(spark):
    """There was a row for each note that a term had reached."""
    notes = spark.createDataFrame([("0", i, date(2024, 1, 1 + i % 2), "the sea") for i in range(400)], NOTES)
    assert {tuple(x)[1:] for x in lexical.build_index(notes).spread.collect()} == {(date(2024, 1, 1), 200, 2), (date(2024, 1, 2), 200, -2), (date(2024, 1, 2), 400, 2)}


def test_an_index_for_questions_holds_their_terms_alone_and_gives_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART", 30)
    r = random.Random(2)
    notes = [(str(i % 3), i, date(2024, 1, 1) + timedelta(days=r.randrange(40)), " ".join(r.choice(["the", *(f"w{j}" for j in range(30))]) for _ in range(r.randrange(20)))) for i in range(120)]
    asked = [(f"q{i}", str(i % 4), date(2024, 1, 1) + timedelta(days=r.randrange(45)), f"the w{i} w{i} w{i + 1}") for i in range(12)]
    held, made = spark.createDataFrame(notes, NOTES), []
    build = lexical.build_index
    monkeypatch.setattr(lexical, "build_index", lambda *a: made.append(build(*a)) or made[-1])
    questions = spark.createDataFrame(asked, ASKED)
    narrow, whole = ({(q, i, rank): s for q, i, s, rank in map(tuple, lexical.bm25(questions, x, 5).collect())} for x in (held, build(held)))
    want = {(q, i, rank): s for q, i, s, rank in slow_bm25(asked, notes, 5)}
    assert narrow.keys() == whole.keys() == want.keys() and all(abs(narrow[x] - want[x]) < 2e-6 for x in want)
    terms = {x[0] for x in questions.select(F.explode(lexical._hashes(F.col("natural_query")))).collect()}
    assert {x[0] for x in made[0].postings.select("term").distinct().collect()} <= terms and made[0].postings.count() < build(held).postings.count()


def test_words_end_where_word_boundaries_do(spark):
    """Every code point between letters, at a start and behind a blank: the pattern with boundaries gives the same words."""
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    text = F.concat("c", F.lit("a"), "c", F.lit("b "), "c", F.lit(" c"), "c")
    bounded = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    assert points.where(lexical.tokens(text) != bounded).count() == 0 and points.count() > 1_000_000


@pytest.mark.parametrize("name", ["ret_08", "ret_11"])
def test_texts_of_all_notes_are_not_shuffled(spark, name):
    """The texts met the ranked notes by a sort of both, since the size of a ranking isn't known before it is stored."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100k")  # far below the texts
    try:
        assert "SortMergeJoin" not in plan(QUERIES[name](spark, DATA))
    finally:
        spark.conf.set(limit, before)


def test_chunks_are_cut_once(spark, monkeypatch):
    """They were cut for the postings, again for the sizes and again for the notes without a hit."""
    plans, store = [], lexical.kept
    monkeypatch.setattr(lexical, "kept", lambda df: plans.append(plan(df)) or store(df))
    notes = spark.createDataFrame([("0", i, date(2024, 1, 1 + i), "title", "the old ship sails. " * 9) for i in range(9)], "subject_id string, note_idx bigint, note_date date, note_title string, text string")
    asked = spark.createDataFrame([("0_1", "0", date(2024, 2, 1), "ship")], ASKED)
    found = retrieval.chunk_bm25(asked, notes, 4, 60, 10)
    assert sum("ArrowEvalPython" in p for p in [*plans, plan(found)]) == 1 and found.count() == 4
