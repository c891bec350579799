"""The pipeline's near-duplicate stage goes through SimHash, and the exact check adds what no distance holds."""

import random

import numpy as np
import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import jaccard, simhash  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def near_copies(seed, n=60, length=300):
    r, texts = random.Random(seed), []
    for _ in range(n):
        w = [f"w{r.randrange(9**9)}" for _ in range(length)]
        x = list(w)
        for at in r.sample(range(length), length // 75):
            x[at] = f"v{r.randrange(9**9)}"
        texts += [" ".join(w), " ".join(x)]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_near_pairs_are_all_within_11_bits_each_once(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 64, 60, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, k, replace=False).astype(np.uint64)) for b in base for k in (1, 4, 8, 11, 12, 14)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)]))
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= 11}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    got = [tuple(sorted((x["u"] % (1 << 64), x["v"] % (1 << 64)))) for x in simhash.near_pairs(df, links=10**6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 240
    assert simhash.near_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_pairs(df, distance=12)


def test_a_cloud_of_fingerprints_stays_one_component_without_all_its_pairs(spark):
    r = np.random.default_rng(6)
    fps = np.unique(np.array([0x0123456789ABCDEF ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(600)], np.uint64)).view(np.int64)
    links = [(x["u"], x["v"]) for x in simhash.near_pairs(spark.createDataFrame([(int(x),) for x in fps], "fp bigint")).collect()]
    root = {int(x): int(x) for x in fps}
    for _ in range(20):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert len(set(root.values())) == 1 and len(links) < len(fps) * (len(fps) - 1) / 4


def test_of_hashes_is_the_majority_of_each_bit():
    g = np.array([5, -3, 1 << 40, 77, -(1 << 62)], np.int64)
    ones = [simhash.of_hashes(g[i : i + 1]) for i in range(len(g))]  # a set of one hash gives its mixed bits
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in ones) > 2)
    assert simhash.of_hashes(g) % (1 << 64) == want and simhash.of_hashes(g[:0]) == 0


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    asked = []
    real, verified = simhash.near_pairs, jaccard._verified

    def near_pairs(*args, **named):
        asked.append("fingerprints")
        return real(*args, **named)

    def verify(texts, pairs, *args):
        out = verified(texts, pairs, *args)
        asked.append({tuple(sorted((x["u"], x["v"]))) for x in out.collect()})
        return out

    monkeypatch.setattr(simhash, "near_pairs", near_pairs, raising=False)
    monkeypatch.setattr(jaccard, "_verified", verify)
    texts = near_copies(3)
    want = {(i, i + 1) for i in range(0, len(texts), 2)}
    kept = {x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, frame(spark, texts), "").collect()}
    assert kept == set(range(0, len(texts), 2))
    assert asked[0] == "fingerprints" and asked[1] <= want and len(asked[1]) > 0.8 * len(want)


def test_pairs_beyond_the_distance_are_linked_too(spark, monkeypatch):
    monkeypatch.setattr(simhash, "near_pairs", lambda distinct, *a, **k: distinct.select(distinct.fp.alias("u"), distinct.fp.alias("v")).limit(0))
    texts = near_copies(4, 20)
    kept = {x["doc_id"] for x in jaccard.keep_first(frame(spark, texts)).collect()}
    assert kept == set(range(0, len(texts), 2))
