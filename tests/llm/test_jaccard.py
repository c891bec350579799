"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity."""

import random

import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import simhash  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def test_stage_finds_every_pair_at_080(spark):
    r = random.Random(11)
    texts = [None, "", "one", "One", "a b c d", "a b c d e f"]
    for n in (12, 40, 150, 600):
        for _ in range(6):
            w = [f"w{r.randrange(5000)}" for _ in range(n)]
            for changes in (0, 1, 1, 2, n // 60, n // 45, n // 30):
                x = list(w)
                for at in r.sample(range(n), changes):
                    x[at] = f"v{r.randrange(5000)}"
                texts.append(" ".join(x[: n - r.choice([0, 0, n // 10])]))
    frequent = " ".join(f"f{i}" for i in range(30))
    texts += [frequent + " " + " ".join(f"u{r.randrange(9**9)}" for _ in range(20)) for _ in range(40)]
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "one", "en", "s", 3)], SCHEMA)
    want = kept_by_brute_force(texts)
    got = [x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want | {None}
    # the fingerprints' four bits miss some of these
    assert {x["doc_id"] for x in simhash.keep_first(df).collect()} - {None} != want
    assert corpus_pipeline.simhash_stage(spark, df.limit(0), "").count() == 0


def test_stage_on_a_whole_table(spark):
    """All of sf0.01: every pair at 0.8 or more is found, so the stage's recall is one there, and no other pair is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {rows[i][0] for i in kept_by_brute_force([t for _, t in rows])}
    assert {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()} == want and len(want) < len(rows)


@pytest.mark.parametrize("dense,block", [(48, 200_000), (3, 500)])
def test_clouds_compared_in_blocks(spark, monkeypatch, dense, block):
    from annalist.llm import jaccard

    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(13)
    texts = []
    for _ in range(2):
        base = [f"w{r.randrange(9000)}" for _ in range(90)]
        for _ in range(110):
            x = list(base)
            for at in r.sample(range(90), r.randint(0, 9)):
                x[at] = f"v{r.randrange(9**9)}"
            texts.append(" ".join(x))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    want = kept_by_brute_force(texts)
    assert {x["doc_id"] for x in jaccard.keep_first(df).collect()} == want and len(want) > 10


def test_dense_blocks_are_bounded_by_texts_too(spark, monkeypatch):
    """Short texts of one opening phrase: blocks hold CLASSES texts at most, so memory doesn't grow with the square of a bucket."""
    import tracemalloc

    import numpy as np

    from annalist.llm import jaccard

    r = np.random.RandomState(3)
    sets = [np.unique(np.append(r.randint(0, 10**9, 5), [1, 2])) for _ in range(2 * jaccard.CLASSES)]
    tracemalloc.start()
    near = jaccard._overlaps(sets) * 9 >= 4 * (np.array([len(g) for g in sets])[:, None] + np.array([len(g) for g in sets])[None, :])
    np.fill_diagonal(near, True)
    assert (jaccard._forest(near) == np.arange(len(sets))).all() and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    monkeypatch.setattr(jaccard, "DENSE", 20)
    monkeypatch.setattr(jaccard, "CLASSES", 40)
    texts = [f"our common opening phrase is here {i} {'x y z' if i % 2 else 'v w'} {i}" for i in range(300)] + [f"our common opening phrase is here then one two three four five six seven eight nine ten {i}" for i in range(3)]
    texts += [f"six word text number {i} only" for i in range(300)] + ["six word text number 1 only"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    want = kept_by_brute_force(texts)
    assert {x["doc_id"] for x in jaccard.keep_first(df).collect()} == want and len(texts) - len(want) == 3


def test_hubs_are_split(spark, monkeypatch):
    from annalist.llm import common, components

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(59, 100), (100, 101), (200, 201), (7, 7)], "u bigint, v bigint")
    got = {x["node"]: x["root"] for x in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 0, 101: 0, 200: 200, 201: 200}
    rows = spark.createDataFrame([(0, i) for i in range(40)] + [(1, 1)], "u bigint, v bigint")
    wide = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "u bigint, w string")
    met = common.salted_join(rows, wide, "u", "v", rows).collect()
    assert sorted((x["u"], x["v"], x["w"]) for x in met) == [(0, i, "a") for i in range(40)] + [(1, 1, "b")]
