"""Lloyd rounds on whole numbers: against brute force and DuckDB."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import lloyd, queries  # noqa: E402

SCHEMA = "vec_id bigint, vec array<float>"


def brute(rows, k, rounds, dims, salt="1"):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    kept = [(i, [math.floor(64 * single(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(cents)]
    rows = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    total = Counter()
    for _, c, d in rows:
        total[c] += d
    return Counter((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in rows)


def vectors(n, dims, seed=3):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(i % 5 - 2, 0.6), r.choice([0, 1, 4])) for _ in range(dims)]) for i in range(n)]
    rows += [(None, [0.25] * dims), (7, [0.5] * dims), (7, [0.5] * dims), (n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1)), (n + 3, [1.0] * (dims + 1))]
    return rows + [(n + 4, [None] + [1.0] * (dims - 1)), (n + 5, [float("nan")] + [1.0] * (dims - 1)), (n + 6, [float("-inf")] + [1.0] * (dims - 1)), (n + 7, [-30000.0] * dims)]


@pytest.mark.parametrize("n,dims,k,rounds", [(300, 64, 16, 3), (60, 3, 5, 0), (5, 4, 16, 2), (200, 2, 7, 9)])
def test_rows_equal_brute_force(spark, n, dims, k, rounds):
    rows = vectors(n, dims)
    got, cents = lloyd.cluster(spark.createDataFrame(rows, SCHEMA).repartition(6), k, rounds, dims)
    assert Counter(map(tuple, got.collect())) == brute(rows, k, rounds, dims)
    assert cents.shape == (min(k, sum(i is not None for i, v in rows if v and len(v) == dims and None not in v and all(map(math.isfinite, v)))), dims)


def test_defined_results_at_the_edges(spark):
    empty = spark.createDataFrame([], SCHEMA + ", cluster string, total string, place string")
    assert lloyd.cluster(empty)[0].collect() == []
    assert lloyd.cluster(spark.createDataFrame([(None, [1.0] * 64)], SCHEMA))[0].collect() == []
    same = spark.createDataFrame([(i, [1.0] * 64, "x") for i in range(40)], SCHEMA + ", cluster string")
    got = lloyd.cluster(same)[0].collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 40
    with pytest.raises(Exception, match="not supported"):
        lloyd.cluster(spark.createDataFrame([(1, [3e30] * 64)], SCHEMA))


def test_sql_says_the_same(spark, tmp_path):
    con = duckdb.connect()
    spark.createDataFrame([r for r in vectors(400, 64, 9) if r[0] is not None and r[1] != [0.5] * 64], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for folder, files in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.001", "")):
        con.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet{files}'")
        want = con.sql(queries.ORACLE["op13_centroid_clustering"])
        df = queries.QUERIES["op13_centroid_clustering"](spark, folder)
        assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
