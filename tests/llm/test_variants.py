"""Spelling variants: the one-errata trie against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import queries, variants  # noqa: E402

SCHEMA = "doc_id bigint, text string, word string, node string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least=5, times=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=2):
    words, forms, out = sorted(n), {}, []
    by = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    for w in words:
        first = min(by[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = first if first is not None and n[first] >= ratio * n[w] else None
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(by[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


def texts(seed, letters, lengths, size):
    r = random.Random(seed)
    pool = ["".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(size)]
    for w in list(pool):
        at, x = r.randrange(len(w)), r.choice(letters)
        pool += [w[:at] + w[at + 1 :], w[:at] + x + w[at:], w[:at] + x + w[at + 1 :]]
    return [(i, r.choice([" ", ", ", "\n", "1"]).join(r.choice(pool)[: r.choice([99, 99, 99, 6])].title() if r.random() < 0.1 else r.choice(pool) for _ in range(60))) for i in range(80)]


@pytest.mark.parametrize("letters,lengths,size", [("ab", range(4, 8), 60), ("abcdefé÷ÿ", range(4, 7), 150), ("aaab", [5, 6, 30, 31], 40)])
def test_rows_equal_brute_force(spark, letters, lengths, size):
    rows = texts(7, letters, lengths, size) + [(None, "nameless nameless Nameless"), (900, None), (901, ""), (901, "12 34 !"), (902, "Repeated " * 5), (902, "Repeated " * 5)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, variants.group_variants(docs).collect()))
    want = brute(counted(rows))
    assert got == want and sum(r[4] for r in want) > 20


def test_forms_are_followed_to_the_last(spark):
    words = ["chains", "chainsa", "chainsab", "chainsabc", "chainsabcd", "other"]
    rows = [(i, " ".join([w] * 3 * 2**k)) for k, w in enumerate(reversed(words[:5])) for i in [k]] + [(9, "other " * 3)]
    rows = [(1000 + i, t) for i, t in rows]
    want = brute(counted(rows))
    assert {r[0]: r[2] for r in want}["chainsabcd"] == "chains" and sorted(map(tuple, variants.group_variants(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect())) == want


def test_very_long_words_and_no_rows(spark):
    long = "".join(random.Random(1).choice("abc") for _ in range(60_000))
    rows = [(1, f"{long} {long} {long}"), (2, f"{long[:-1]} " * 9), (3, f"{long[:30_000]}z{long[30_001:]} " * 4), (4, f"x{long} " * 3)]
    got = sorted(map(tuple, variants.group_variants(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()))
    assert got == brute(counted(rows)) and len(got) == 4
    assert variants.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_word_lies_in_few_light_children(spark):
    rows = texts(11, "abcdef", range(5, 9), 400)
    words = spark.createDataFrame(list(counted(rows, 5, 1).items()), "word string, n bigint").selectExpr("word", "n", "xxhash64(word) id_a", "xxhash64(12, word) id_b")
    split = variants.cut(variants.branches(words))
    light = [r["count"] for r in variants.light_edges(words, split).where("at >= 0").groupBy("id_a").count().collect()]
    assert max(light) <= words.count().bit_length() + 1


def test_the_query_on_the_smallest_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").collect()))
    n = counted(rows)
    assert [r[0] for r in got] == sorted(n)
    held = set(n)
    letters = sorted({c for w in n for c in w})
    for word, form, _, own, n_near, form_n in got:
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) for c in letters}
        found = sorted((edits & held) - {word}, key=lambda v: (-n[v], v))
        assert (own, n_near) == (n[word], len(found)) and form == (found[0] if found and n[found[0]] >= 2 * own else None) and form_n == (n[form] if form else None)
