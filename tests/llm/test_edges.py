"""Null and repeated ids, empty tables, hot groups and files of the corpus operators."""

from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("annalist.llm")
from pyspark.sql import functions as F  # noqa: E402

from annalist.llm import common, decontam, jaccard, licenses, packing, quality, rules, sharding, simhash  # noqa: E402
from annalist.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [(None, "the same text of a few words here"), (None, None), (5, "the same text of a few words here"), (5, "the same text of a few words here"), (6, None), (7, ""), (8, " \n"), (9, "Released under the MIT License")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_every_row_is_scored_measured_and_packed(spark):
    docs, labels = frame(spark, ROWS), spark.createDataFrame([(5, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    scores = quality.score(docs, labels).collect()
    assert Counter(r["doc_id"] for r in scores) == Counter(i for i, _ in ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["held_out"] for r in scores if r["doc_id"] is None} == {None}
    assert Counter(r["doc_id"] for r in rules.ledger(docs).collect()) == Counter(i for i, _ in ROWS)
    pieces = packing.pack(docs, tokenizer_path()).collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(i for i, _ in ROWS) and sum(r["length"] for r in pieces if r["doc_id"] in (6, 7)) == 2


def test_no_null_id_is_dropped_or_named(spark):
    docs = frame(spark, ROWS)
    named = simhash.near_duplicates(docs).collect()
    assert len(named) == len(ROWS) and {r["component_id"] for r in named if r["doc_id"] in (None, 5)} == {5, 6}
    for keep in (simhash.keep_first, jaccard.keep_first):
        kept = [r["doc_id"] for r in keep(docs).collect()]
        assert Counter(kept) == Counter([None, None, 5, 6, 9])
    items = spark.createDataFrame([(1, "the same text of a few words"), (1, "zz"), (None, "Released under the MIT License"), (2, None)], "item_id bigint, text string")
    found = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()]
    assert found == [(5, 1)]
    assert Counter(r["doc_id"] for r in decontam.clean(docs, items).collect()) == Counter([None, None, 6, 7, 8, 9])
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs, licenses.templates(spark)).collect()} == {(9, "MIT")}


def test_item_blocks_give_the_same(spark):
    r = np.random.RandomState(3)
    word = lambda: "".join(chr(c) for c in r.choice([*range(97, 103), 233, 223, 304, 0x4E2D, 0x664, 0x1D7D8, 0x301], r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(40)]
    docs = [(i, " ".join(word() for _ in range(50)) + " " + items[i % 40][1] + ", " + " ".join(word() for _ in range(30))) for i in range(60)]
    d, q = frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")
    got = [sorted(tuple(x) for x in decontam.contaminated(d, q, block=b).collect()) for b in (10**9, 200)]
    assert got[0] == got[1] and len(got[0]) >= 40
    assert sorted(x["doc_id"] for x in decontam.clean(d, q, block=200).collect()) == sorted({i for i, _ in docs} - {x[0] for x in got[0]})


def test_packing_over_many_parts(spark):
    r = np.random.RandomState(4)
    docs = frame(spark, [(i, " ".join(["word"] * int(r.choice([0, 3, 50, 3000])))) for i in range(300)])
    rows = packing.pack(docs, tokenizer_path(), parts=7).collect()
    places = sorted(x["sequence_id"] * 2048 + x["offset"] for x in rows)
    ends = sorted(x["sequence_id"] * 2048 + x["offset"] + x["length"] for x in rows)
    assert places[0] == 0 and places[1:] == ends[:-1]
    total = defaultdict(int)
    for x in rows:
        total[x["doc_id"]] += x["length"]
    assert all(total[x["doc_id"]] == x["doc_tokens"] for x in rows) and len(total) == 300


def test_shards_keep_equal_texts_and_move_little(spark):
    r = np.random.RandomState(5)
    texts = [f"text {i % 900} " + "x" * int(r.choice([5, 80, 900])) * (i % 900 < 880) for i in range(6000)] + ["hot"] * 3000
    docs = frame(spark, enumerate(texts))
    old = sharding.old_shard(sharding.group_of(F.col("text")))
    rows = sharding.reshard(docs, old).collect()
    held = defaultdict(set)
    for x in rows:
        held[texts[x["doc_id"]]].add(x["shard"])
    assert all(len(s) == 1 for t, s in held.items() if t != "hot") and len(held["hot"]) > 1
    load, before = defaultdict(int), defaultdict(int)
    for x in rows:
        load[x["shard"]] += x["size"]
        before[x["old_shard"]] += x["size"]
    total = sum(load.values())
    least = sum(max(0, b - (total // 40 + (s < total % 40))) for s, b in before.items())  # what no shard has room for
    moved = sum(x["size"] for x in rows if x["shard"] != x["old_shard"])
    assert least <= moved <= 1.1 * least and max(load.values()) < 1.1 * total / 40


def test_flow_against_brute_force():
    from itertools import product

    r = np.random.RandomState(6)
    for _ in range(30):
        supply, capacity = r.randint(0, 4, 3).tolist(), r.randint(1, 5, 3).tolist()
        if sum(supply) > sum(capacity):
            continue
        cost = r.randint(0, 5, (3, 3))
        best = None
        ways = [[c for c in product(range(s + 1), repeat=3) if sum(c) == s] for s in supply]
        for flows in product(*ways):
            if all(sum(f[j] for f in flows) <= capacity[j] for j in range(3)):
                price = sum(flows[i][j] * cost[i][j] for i in range(3) for j in range(3))
                best = price if best is None else min(best, price)
        got = sharding.min_cost_flow(supply, capacity, lambda i, j: int(cost[i][j]))
        assert sum(f * cost[i][j] for (i, j), f in got.items()) == best


def test_unaffected_shards_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/shards"
    docs = frame(spark, [(i, f"t{i}") for i in range(40)])
    placed = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("old_shard"), (F.col("doc_id") % 4).cast("int").alias("shard"), F.col("doc_id").alias("slot"))
    docs.join(placed, "doc_id").drop("old_shard").write.partitionBy("shard").parquet(path)
    moved = placed.withColumn("shard", F.when(F.col("shard") == 3, 1).otherwise(F.col("shard")))  # shard 3 hands all it has to shard 1
    assert sharding.rewrite_affected(docs, moved, path) == [1, 3]
    back = {r["doc_id"]: r["shard"] for r in spark.read.parquet(path).collect()}
    assert back == {i: 1 if i % 4 == 3 else i % 4 for i in range(40)}
    assert not (tmp_path / "shards" / "shard=3").exists() and (tmp_path / "shards" / "shard=0").exists()


def test_hot_join_is_a_join(spark):
    rows = spark.createDataFrame([(0, i) for i in range(5000)] + [(k, k) for k in range(1, 50)], "k bigint, v bigint")
    one = common.cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")))
    got = common.hot_join(rows, one, ["k"])
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("k", "v", "least").collect())) == sorted(map(tuple, rows.join(one, "k").select("k", "v", "least").collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_tells_hot_keys_apart_without_a_join(spark, how):
    """Rows of no hot key pass one join; an anti-join before it emitted them once more as soon as a key was hot."""
    rows = spark.createDataFrame([("a", i) for i in range(2000)] + [(f"b{i % 30}", i) for i in range(60)] + [(None, 7), ("alone", 8)], "k string, v bigint")
    one = common.cut(rows.where("k <> 'alone'").groupBy("k").agg(F.count("*").alias("n")))
    got = common.hot_join(rows, one, ["k"], how)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.select("k", "v", "n").collect())) == sorted(map(str, rows.join(one, "k", how).select("k", "v", "n").collect()))


def test_empty_tables(spark):
    none, items = frame(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.clean(none, items).count() == 0 and quality.keep_good(none, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
    assert jaccard.keep_first(none).count() == 0 and simhash.keep_first(none).count() == 0
    for stage in ("quality", "line_dedup", "simhash", "decontamination", "packing"):
        pipeline = pytest.importorskip("corpus_pipeline")
        out = dict(pipeline.STAGES)[stage](spark, none, "/root/testdata/sf0.001")
        assert out.count() == 0
