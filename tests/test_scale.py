"""As-of joins, token budgets, samples, ranks, fact matching, rejected lines and the streaming limiter against brute force."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from annalist.functions import tokens as K
from annalist.operators import asof, matching, tables
from annalist.sources import readers


def history(seed=1):
    r = random.Random(seed)
    day = lambda: date(2023, 12, 20) + timedelta(days=r.randrange(100))
    notes = [(r.choice("aab"), i, r.choice([None, day(), day(), day()])) for i in range(300)]
    return notes, [(f"q{i}", r.choice("abc"), r.choice([None, day(), date(2024, 1, 31), date(2024, 2, 1)])) for i in range(40)]


def test_as_of_by_buckets(spark):
    notes, asked = history()
    n = spark.createDataFrame(notes, "subject_id string, note_idx bigint, note_date date")
    q = spark.createDataFrame(asked, "question_id string, subject_id string, cutoff date")
    seen = {(qid, i, d) for qid, s, c in asked for t, i, d in notes if s == t and c and d and d <= c}
    got = [(x["question_id"], x["note_idx"], x["note_date"]) for x in asof.as_of_rows(q, n).collect()]
    assert len(got) == len(seen) and set(got) == seen and asof.as_of_rows(q, n).columns == ["question_id", "subject_id", "cutoff", "note_idx", "note_date"]
    for x in asof.as_of_summary(q, n).collect():
        own = [d for a, _, d in seen if a == x["question_id"]]
        assert (x["n"], x["first_date"], x["last_date"]) == (len(own), min(own, default=None), max(own, default=None))
    assert asof.as_of_rows(q, n.limit(0)).count() == 0 and asof.as_of_summary(q.limit(0), n).count() == 0


@pytest.mark.parametrize("budget", [0, 7, 120, 10**6])
def test_newest_within_a_budget(spark, budget):
    notes, _ = history(2)
    sizes = [(s, i, d, i * 7 % 11) for s, i, d in notes]
    got = asof.newest_within(spark.createDataFrame(sizes, "subject_id string, note_idx bigint, note_date date, w int"), F.col("w"), budget)
    want = set()
    for s in "ab":
        used = 0
        for _, i, _, w in sorted((x for x in sizes if x[0] == s), key=lambda x: (x[2] is None, -(x[2] or date.min).toordinal(), x[1])):
            used += w
            if used > budget:
                break
            want.add((s, i, used))
    assert {(x["subject_id"], x["note_idx"], x["used"]) for x in got.collect()} == want


def test_token_counts_are_the_tokenizer_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    file = tokenizers.Tokenizer.from_file(K.vocabulary_path("byte_bpe_50k.json"))
    file.encode_special_tokens = True
    r = random.Random(3)
    pools = ["abcdefgh ", "aé漢字 😀́", " \t\n\r\x0b\xa0 ​", "0123٣²½ ", "'s't're'll I'm", "<|endoftext|>#$%&\\", "".join(chr(c) for c in range(32, 0x3000, 7))]
    texts = ["", " ", "a", "<|endoftext|>", *("".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 120))) for _ in range(400))]
    texts += ["word " * 60_000, "x" * 3000 + "\n" * 2500 + "y" + " " * 1500, " " * 150_000, ("long line of words " * 400 + "\n\n\t") * 20 + " " * 3000 + "end", "1 a\n" * 40_000]
    want = [len(x.ids) for x in file.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {x["i"]: x["n"] for x in df.select("i", K.model_tokens(F.col("t")).alias("n")).collect()}
    assert got[-1] == 0 and [got[i] for i in range(len(texts))] == want


def test_samples_hold_the_first_of_each_stratum(spark):
    import hashlib

    place = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    rows = [(i, "hot" if i % 3 else ["cold", "rare", None][i % 9 // 3]) for i in range(6000)] + [(7000, "one")]
    df = spark.createDataFrame(rows, "id bigint, s string")
    own = defaultdict(list)
    for i, s in rows:
        own[s].append(i)
    got = defaultdict(set)
    for x in tables.stratified_quota(df, "s", 50, F.col("id")).collect():
        got[x["s"]].add(x["id"])
    for s in ("hot", "cold", "rare", "one"):
        quota = max(1, round(50 * len(own[s]) / len(rows)))
        assert got[s] == set(sorted(own[s], key=place)[:quota])
    turns = sorted((sorted(own[s], key=place).index(i) + 1, s, i) for s in own if s for i in sorted(own[s], key=place)[:10])[:10]
    assert [(x["turn"], x["s"], x["id"]) for x in tables.round_robin(df, "s", 10, F.col("id")).collect()] == turns
    # where too few hashes lie below the bound, the stratum is looked at whole
    sizes = df.where("s is not null").groupBy("s").agg((F.count("*") * 1000).alias("k"), F.lit(40).alias("quota"))
    whole = tables.k_smallest(df, "s", sizes, F.col("id")).where("s = 'cold'").collect()
    assert {x["id"] for x in whole} == set(sorted(own["cold"], key=place)[:40])


def test_ranks_by_hash_ranges(spark):
    import hashlib

    df = spark.createDataFrame([(i, r) for i in range(900) for r in "xy" if r == "x" or i % 4], "unit bigint, rater string")
    got = {(x["rater"], x["unit"]): x["card"] for x in tables.hash_ranks(df, ["rater"], F.col("unit"), "card", rows=20).collect()}
    for r in "xy":
        order = sorted((i for i in range(900) if r == "x" or i % 4), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        assert [got[r, i] for i in order] == list(range(1, len(order) + 1))


def test_facts_match_by_their_best_f1(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(matching, "FACTS", 7)
    words = [f"w{i}" for i in range(14)]
    fact = lambda: " ".join(r.choice(words) for _ in range(r.randrange(0, 6)))
    day = lambda: r.choice([None, date(2024, 1, 1), date(2024, 1, 2)])
    sides = [[(k, i, fact(), day()) for k in range(4) for i in range(r.randrange(1, 40))] for _ in range(2)] 
    sides[0].append((9, 0, "alone", None))
    frames = [spark.createDataFrame(s, "k bigint, fact_idx bigint, fact string, fact_date date") for s in sides]
    got = {(x["k"], x["side"], x["fact_idx"]): x["shared"] / max(1, x["total"]) for x in matching.best_matches(*frames, "k").collect()}

    def best(me, others):
        f1 = [2 * len(a & b) / (len(a) + len(b)) for a, b in ((set(me[2].split()), set(o[2].split())) for o in others if o[0] == me[0] and o[3] == me[3]) if a | b]
        return max(f1, default=0.0)

    want = {(x[0], name, x[1]): best(x, sides[1 - i]) for i, name in enumerate(("candidate", "reference")) for x in sides[i]}
    assert got.keys() == want.keys() and all(2 * got[x] == pytest.approx(want[x]) for x in want)
    for x in matching.fact_scores(*frames, "k").collect():
        for name, n, hit, share in (("candidate", "n_cand", "cand_hit", "precision"), ("reference", "n_ref", "ref_hit", "recall")):
            own = [v for (k, s, _), v in want.items() if k == x["k"] and s == name]
            assert (x[n], x[hit]) == (len(own), sum(v >= 0.9 for v in own)) and x[share] == (round(x[hit] / len(own), 6) if own else None)


def test_lines_of_another_width_are_kept_aside(spark, tmp_path):
    for name, text in (("a", 'id,x\n1,"two\nlines"\n2,b,c\n3\n4,d\n'), ("b", "id,y,z\n5,1,2\n6,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    good, bad = readers.union_with_rejects(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    assert {x["id"]: x["x"] for x in good.collect()} == {"1": "two\nlines", "4": "d", "5": None}
    assert sorted((x["source_file"][-5:], x["line"].strip()) for x in bad.collect()) == [("a.csv", "2,b,c"), ("a.csv", "3"), ("b.csv", "6,1")]
    assert good.columns == ["id", "x", "y", "z"] and readers.union_files(spark, [f"{tmp_path}/a.csv"]).count() == 2


def test_streaming_limiter_agrees_with_the_batch_over_a_restart(spark, tmp_path):
    from annalist.streaming import limiter

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    schema = "user_id bigint, event_id bigint, ts timestamp, value double"
    r, start = random.Random(1), datetime(2024, 1, 1)
    rows = [(r.randrange(3), i, start + timedelta(seconds=r.randrange(600)), float(r.randrange(9))) for i in range(200)]
    late = (0, 500, start, 5.0)  # behind the watermark when it comes
    parts = [rows[:100], [*rows[100:], (9, 998, start + timedelta(hours=1), 0.0)], [late], [(9, 999, start + timedelta(hours=9), 0.0)]]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = limiter.trailing_sums(stream, "ts", "value").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(ValueError):
        limiter.trailing_sums(spark.createDataFrame(rows, schema), "ts", "value")
    spark.conf.set(name, limiter.PROVIDER)
    try:
        for part in parts:  # each start goes on from the checkpoint
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run()
    finally:
        spark.conf.set(name, before)
    got = {x["event_id"]: x["in_window"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = tables.rate_window(spark.createDataFrame(rows, schema), "user_id", "ts", "value", 60)
    want = {x["event_id"]: x["in_window"] for x in batch.collect()}
    assert {i: s for i, s in got.items() if i < 500} == want and 500 not in got
    assert Counter(x["event_id"] for x in spark.read.parquet(f"{tmp_path}/out").collect()).most_common(1)[0][1] == 1


def test_agents_over_rows_against_one_at_a_time(spark):
    from annalist.operators import agents
    from annalist.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        i, cutoff = r["item_id"], date(2024, 1, 1) + timedelta(days=r["item_id"] * 11 % 365)
        day = {d: date(2024, 1, 1) + timedelta(days=d * 7 % 365) for d in docs}
        seen = [d for d in sorted(docs) if d % 20 == i % 20 and d % 17 and day[d] <= cutoff]
        met = [d for d in seen if any(w in f"{docs[d]['source']} {docs[d]['text']}".lower() for w in ("license", "token"))]
        lines = [f"[{d // 20}] {docs[d]['source']} ({day[d]}) {docs[d]['text'][:100]}".replace("\n", " ") for d in met]
        asked = "\n".join([r["text"], " -> searching", "\n".join([f"{len(met)} matched", *lines]) if met else "nothing matched"])
        if met:
            call = '{"name":"search","keywords":["license","token"]} -> reading ' + str(met[0] // 20)
            asked = "\n".join([r["text"], " -> searching", call, docs[met[0]]["text"]])
        want.add((f"{i % 20}_{i}", f"read {len(asked)}", 1 + bool(met), 2 + bool(met)))
    assert {tuple(x) for x in QUERIES["win_11_rows"](spark, folder).collect()} == want and any(x[2] == 2 for x in want)
    held = spark.range(1).select(F.array(*[F.struct(F.lit("c").alias("call"), F.lit(f"d{i}" if i != 1 else "").alias("draft")) for i in range(5)]).alias("h"), F.lit("s").alias("s"))
    history, summary = agents.compact(F.col("h"), F.col("s"), 2)
    got = held.select(history.alias("h"), summary.alias("s")).first()
    assert [x["draft"] for x in got["h"]] == ["d3", "d4"] and got["s"] == "s; d0; d2"


def test_agents_end_on_answers_that_do_not_parse_and_keep_few_steps(spark):
    import json

    from annalist.operators import agents
    from annalist.sources.sinks import kept

    tools = [{"name": "meta"}, {"name": "summary", "note_ids": [2, 0, 99]}, {"name": "note", "note_id": 7}, {"name": "dance"}, {"name": "meta"}]

    def provider(prompts):
        return ["broken" if "bad" in p else json.dumps({"draft": f"step {n}", "tool": tools[n]} if (n := p.count("step ")) < 5 else {"draft": p, "stop": True}) for p in prompts]

    notes = spark.createDataFrame([("0", i, date(2024, 1, 1 + i), "t", f"text {i}") for i in range(3)], "subject_id string, note_idx bigint, note_date date, note_title string, text string")
    asked = spark.createDataFrame([("a", "0", date(2024, 1, 2), "go"), ("b", "0", date(2024, 1, 2), "bad"), ("c", "0", None, "go")], "question_id string, subject_id string, cutoff date, question string")
    got = {x["question_id"]: x for x in agents.run(asked, notes, provider, kept, keep=3).collect()}
    assert got["b"]["answer"] == "" and got["b"]["n_steps"] == 0 and got["a"]["n_steps"] == 5
    assert len(got["a"]["history"]) == 3 and got["a"]["summary"] == "step 0; step 1; step 2" and "2 notes, 2024-01-01 to 2024-01-02" in got["a"]["answer"]
    assert "0 notes, ? to ?" in got["c"]["answer"] and agents.run(asked, notes, provider, kept, steps=2).where("n_steps = 2").count() == 2
    seen = {tuple(x) for x in agents.observe(asked.selectExpr("question_id", "subject_id", "cutoff", "cast(from_json(if(question_id = 'a', '{\"name\":\"summary\",\"note_ids\":[1,0,2]}', '{\"name\":\"dance\"}'), 'name string, note_id bigint, keywords array<string>, note_ids array<bigint>') as struct<name:string,note_id:bigint,keywords:array<string>,note_ids:array<bigint>>) tool"), notes).collect()}
    assert seen == {("a", "text 1 | text 0"), ("b", "unknown tool: dance"), ("c", "unknown tool: dance")}
