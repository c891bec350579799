"""Line and span dedup against brute force, and their SQL against DuckDB."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

pytest.importorskip("annalist.llm")
from pyspark.sql import functions as F  # noqa: E402

from annalist.llm import lines, pii, queries, spans  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)
    return df.withColumns({"first": F.lit("x"), "n_lines": F.lit(-1), "source_": F.lit(1), "key_a": F.lit(2)})


def words_of(t):
    return " ".join(t.split())


def picked(s, words):
    """Places of the lines a text's windows select."""
    h, n, out = [hashlib.md5(x.encode()).hexdigest() for x in s], [len(x.split()) for x in s], []
    for i in range(len(s)):
        end = next((e for e in range(i + 1, len(s) + 1) if sum(n[i:e]) >= words), None)
        if end:
            out.append(i + h[i:end].index(min(h[i:end])))
    return list(dict.fromkeys(out)) or ([h.index(min(h))] if s else [])


def slow_lines(texts, words=lines.WORDS, copies=lines.COPIES):
    """Which lines with a word go: by the definition, one document after the other."""
    held = [[words_of(x) for x in (t or "").split("\n") if x.split()] for t in texts]
    posted = [(s[i], d, i) for d, s in enumerate(held) for i in sorted(picked(s, words))]
    sources, gone, seen = {}, defaultdict(set), set()
    for key, d, i in posted:
        if key not in sources:
            sources[key] = (d, i)
            continue
        d0, i0 = sources[key]
        gone[d].add(i)
        for step in (-1, 1):
            total, j = 0, step
            while 0 <= i + j < len(held[d]) and 0 <= i0 + j < len(held[d0]) and held[d][i + j] == held[d0][i0 + j]:
                total += len(held[d][i + j].split())
                if total >= words:
                    break
                gone[d].add(i + j)
                j += step
    every = Counter(x for s in held for x in s)
    for d, s in enumerate(held):
        for i, x in enumerate(s):
            if x in seen and every[x] >= copies:
                gone[d].add(i)
            seen.add(x)
    return gone


def without_lines(t, gone):
    if t is None:
        return None
    out, k = [], 0
    for x in t.split("\n"):
        full = bool(x.split())
        if not (full and k in gone):
            out.append(x)
        k += full
    return "\n".join(out)


def line_texts(seed, n=80):
    r = random.Random(seed)
    short = ["ok", "a b", "c", "d e", "f", "g h"]
    pool = ["all rights reserved", "see also the page", "one two three four five six seven eight nine ten eleven", *short]
    texts = [None, "", "\n \n", "ok\na b\nc\nd e", "x\nok\na b\nc\nd e\ny", "Solo una línea larga"]
    return texts + ["\n".join(r.choice([*pool, *short, "", f"u{r.random()} v w"]) for _ in range(r.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("seed,words", [(3, 50), (4, 12), (5, 4), (6, 1)])
def test_line_dedup_against_brute_force(spark, seed, words):
    texts = line_texts(seed)
    gone = slow_lines(texts, words)
    got = {x["doc_id"]: x for x in lines.dedup_lines(frame(spark, texts), words).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == [without_lines(t, gone[i]) for i, t in enumerate(texts)]
    assert all(got[i]["n_removed"] == len(gone[i]) and got[i]["first"] == "x" for i in got)
    assert sum(map(len, gone.values())) > 20


def test_winnowing_keeps_its_guarantee(spark):
    """A run of 50 words that stands earlier goes whole, whatever its lines; first copies stay."""
    r = random.Random(5)
    for shape in ([5] * 10, [1] * 50, [25, 1, 24], [50], [3, 30, 2, 20, 7], [49, 1], [9] * 40):
        run = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in shape]
        own = lambda k: [" ".join(f"u{r.random()}" for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(k))]
        texts = ["\n".join([*own(5), *run, *own(5)]) for _ in range(6)]
        got = {x["doc_id"]: x for x in lines.dedup_lines(frame(spark, texts)).collect()}
        assert got[0]["text"] == texts[0]
        assert all(not set(run) & set(got[i]["text"].split("\n")) and got[i]["n_removed"] == len(run) for i in range(1, 6))


def test_most_postings_are_minima_of_windows(spark):
    """By kind, on the given texts: lines that are a window by themselves, and minima of windows of several lines; far from all lines are posted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds, total = {True: 0, False: 0}, 0
    for r in docs.collect():
        s = [words_of(x) for x in r["text"].split("\n") if x.split()]
        total += len(s)
        for i in picked(s, lines.WORDS):
            kinds[len(s[i].split()) >= lines.WORDS] += 1
    posted = lines.postings(lines.line_table(docs))
    assert posted.count() == sum(kinds.values()) < 0.65 * total and kinds[False] > 0.3 * posted.count()
    assert posted.where("size(before) + size(after) > 0").count() > 0.5 * kinds[False]
    many = "\n".join(f"w{i} v" for i in range(5000))
    assert lines.postings(lines.line_table(frame(spark, [many]))).count() < 2.6 / 26 * 5000  # windows of 25 lines


def test_short_boilerplate_goes_wherever_it_stands(spark):
    r = random.Random(2)
    texts = ["\n".join([*(f"own {r.random()} line of text" for _ in range(r.randrange(1, 9))), "all rights reserved", *(f"own {r.random()} too" for _ in range(r.randrange(1, 9)))]) for _ in range(60)]
    got = {x["doc_id"]: x for x in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 1 and "reserved" not in got[i]["text"] for i in range(1, 60))


def test_column_names_may_clash(spark):
    docs = frame(spark, ["one line of a text", "one line of a text"]).selectExpr("doc_id", "text", "lang gone", "lang full", "lang _cut", "lang _full", "lang k", "lang n", "lang source")
    got = {x["doc_id"]: x for x in lines.dedup_lines(docs).collect()}
    assert got[1]["text"] == "" and {got[1][c] for c in ("gone", "full", "_cut", "_full", "k", "n", "source")} == {"en"}
    said = " ".join(f"w{i}" for i in range(30)) + "."
    spoken = frame(spark, [said, said]).selectExpr("doc_id", "text", "lang gone", "lang pieces", "lang _pieces", "lang FULL")
    got = {x["doc_id"]: x for x in spans.dedup_spans(spoken).collect()}
    assert got[1]["text"] == "" and got[0]["text"] == said and {got[1][c] for c in ("gone", "pieces", "_pieces", "FULL")} == {"en"}
    mails = frame(spark, ["write to ann@example.org", "nothing here"]).selectExpr("doc_id", "text", "lang hits", "lang new", "lang _found")
    got = {x["doc_id"]: x for x in pii.pseudonymise(mails, "k").collect()}
    assert "ann@" not in got[0]["text"] and (got[0]["n_changed"], got[1]["n_changed"]) == (1, 0) and {got[0][c] for c in ("hits", "new", "_found")} == {"en"}


def test_odd_rows(spark):
    long = "the same long line here"
    texts, ids = [long, long, long, None, long, None], [None, 7, 7, 8, 9, None]
    got = lines.dedup_lines(frame(spark, texts, ids)).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in got if x["text"]) == [(True, 0, long)] and len(got) == 6
    sentence = " ".join(f"w{i}" for i in range(30)) + "."
    for op in (lambda f: lines.dedup_lines(f), lambda f: spans.dedup_spans(f)):
        assert op(frame(spark, [])).count() == 0
        rows = op(frame(spark, [sentence, sentence, None, "", " \n\t"], [7, 7, 8, 8, None])).collect()
        assert len(rows) == 5
    apart = spans.dedup_spans(frame(spark, [sentence, sentence], [None, 4])).collect()
    assert {x["doc_id"]: x["text"] for x in apart} == {None: sentence, 4: ""}


def test_very_long_texts(spark):
    """20,000 repeated lines or sentences take seconds."""
    import time

    body = "\n".join(f"line number {i % 10_000} of the text" for i in range(20_000))
    started = time.time()
    got = lines.dedup_lines(frame(spark, [body, body])).collect()
    assert sorted(x["n_removed"] for x in got) == [10_000, 20_000]
    talk = " ".join(f"Sentence {i} has some eight or nine words." for i in range(20_000))
    got = spans.dedup_spans(frame(spark, [talk, talk])).collect()
    assert sorted(x["n_removed"] for x in got) == [0, 20_000] and sorted(len(x["text"]) for x in got)[0] == 0
    assert time.time() - started < 60


def slow_spans(texts, span=3, min_words=20, long_words=20):
    seen, gone, full = {}, defaultdict(set), {}
    for d, t in enumerate(texts):
        p = [x for x in re.sub(r"([.!?][ \t-\r]+|\n[ \t-\r]*)", "\\1\x01\x02", t or "").split("\x01\x02")]
        full[d] = p
        at = [i for i, x in enumerate(p) if x.split()]
        s = [words_of(p[i]) for i in at]
        runs = [(i, span) for i in range(len(s) - span + 1)] or ([(0, len(s))] if len(s) > 1 else [])
        runs = [(i, n) for i, n in runs if sum(len(x.split()) for x in s[i : i + n]) >= min_words] + [(i, 1) for i, x in enumerate(s) if len(x.split()) >= long_words]
        for i, n in sorted(runs):
            key = (n, " ".join(s[i : i + n]))
            if seen.setdefault(key, (d, i)) != (d, i):
                gone[d] |= set(at[i : i + n])
    return [None if t is None else "".join(x for i, x in enumerate(full[d]) if i not in gone[d]) for d, t in enumerate(texts)]


def test_span_dedup_against_brute_force(spark):
    r = random.Random(6)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(n)).capitalize() + r.choice(".!?") for n in (1, 2, 5, 8, 12, 22, 60) for _ in range(4)]
    glue = [" ", "  ", "\n", " \n  ", "\n\n", "\t"]
    texts = [None, "", " \n "] + ["".join(r.choice(pool) + r.choice(glue) for _ in range(r.randint(1, 12))) for _ in range(80)]
    got = {x["doc_id"]: x["text"] for x in spans.dedup_spans(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == slow_spans(texts)


def test_passages_over_fifty_words_go(spark):
    r = random.Random(7)
    say = lambda n: " ".join(f"w{r.randrange(9000)}" for _ in range(n)).capitalize() + "."
    passages = [say(55), " ".join(say(9) for _ in range(7)), "  ".join(say(28) for _ in range(2)), "\n   ".join(say(20) for _ in range(3))]
    for p in passages:
        texts = [f"{say(12)} {p} {say(11)}" for _ in range(5)] + [say(80)]
        got = {x["doc_id"]: x["text"] for x in spans.dedup_spans(frame(spark, texts)).collect()}
        assert got[0] == texts[0] and got[5] == texts[5]
        assert all(p[:40] not in got[i] and p[-40:] not in got[i] and got[i].split()[0] == texts[i].split()[0] and got[i].split()[-1] == texts[i].split()[-1] for i in range(1, 5))


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_line_dedup"])
def test_sql_says_the_same(spark, tmp_path, name):
    texts = line_texts(9, 60) + [". ".join(r * 7 for r in ("ab ", "cd ", "ef ")) + "." for _ in range(3)] + ["One two. Three.\nFour"] * 2
    df = frame(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (tmp_path, "/root/testdata/sf0.001"):
        path = f"{folder}/documents.parquet" + ("/*.parquet" if folder == tmp_path else "")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        cursor = con.sql(queries.ORACLE[name])
        want = sorted((dict(zip(cursor.columns, r)) for r in cursor.fetchall()), key=lambda x: x["doc_id"])
        got = sorted((r.asDict() for r in queries.QUERIES[name](spark, str(folder)).collect()), key=lambda x: x["doc_id"])
        assert got == want
