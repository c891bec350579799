"""Late-interaction search over all rows against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.operators import vectors as N
from annalist.queries import QUERIES, _token_vectors

DATA = "/root/testdata/sf0.001"


def best(vectors, query_ids, k=10):
    ids = sorted(vectors)
    c = np.array([vectors[i] for i in ids], dtype=np.float64).reshape(len(ids), 4, 16)
    out = set()
    for x in query_ids:
        q = np.array(vectors[x], dtype=np.float64).reshape(4, 16)
        s = np.round(np.einsum("qd,ncd->nqc", q, c).max(axis=2).sum(axis=1), 6)
        out |= {(x, ids[i], rank + 1) for rank, i in enumerate(sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k])}
    return out


def test_every_twentieth_row_is_asked_against_all(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    asked = [i for i in vectors if i % 20 == 0]
    rows = QUERIES["ret_09"](spark, DATA).collect()
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in rows} == best(vectors, asked)
    assert len(asked) > 20 and {r["query_id"] for r in rows} == set(asked)


def test_blocks_make_no_difference(spark, monkeypatch):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    q, c = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), cut.alias("q")), e.select(F.col("vec_id").alias("item_id"), cut.alias("c"))
    want = {tuple(r) for r in N.late_search(q, c, 10).collect()}
    monkeypatch.setattr(N, "QUERIES", 3)
    monkeypatch.setattr(N, "ROWS", 17)
    assert {tuple(r) for r in N.late_search(q, c, 10).collect()} == want
    assert N.late_search(q.limit(0), c).count() == 0 and N.late_search(q, c.limit(0)).count() == 0


def test_an_item_is_stored_once_and_met_once_where_cells_rule_nothing_out(spark, monkeypatch):
    """An item in the cells of all its vectors was stored, sent and scored up to four times for a query that visits them all."""
    stored, store = [], N.kept
    monkeypatch.setattr(N, "kept", lambda df: stored.append(store(df)) or stored[-1])
    q, c = _token_vectors(spark, DATA)
    index = N.build_late_cells(c)
    assert index.rows.count() == index.total == c.count() and index.size.sum() > index.total
    want = {tuple(r) for r in N.late_search(q, index, 10).collect()}
    assert [r[0] for r in stored[1].select("cells").distinct().collect()] == [[N.ALL]]
    monkeypatch.setattr(N, "ALL", -2)  # cells are visited one by one if the whole isn't cheaper
    index.total = 10**9
    assert {tuple(r) for r in N.late_search(q, index, 10).collect()} == want


@pytest.mark.parametrize("k,threshold", [(3, None), (3, 1.0), (None, 1.0)])
def test_a_block_against_brute_force(monkeypatch, k, threshold):
    """Items and queries of unlike numbers of vectors, many equal ones among them, cut anywhere."""
    r = np.random.RandomState(1)
    some = lambda n: [r.randint(-1, 2, (r.randint(1, 5), 3)).astype(float) for _ in range(n)]
    items, asks = some(200), some(30)
    ids, names = r.permutation(200), r.permutation(30)
    score = np.array([[(q @ c.T).max(axis=1).sum() for c in items] for q in asks])
    want = set()
    for j, name in enumerate(names):
        best = sorted(range(200), key=lambda i: (-score[j, i], ids[i]))
        want |= {(name, ids[i], score[j, i]) for i in [i for i in best if threshold is None or score[j, i] >= threshold][:k]}
    least = np.sort(score[:, ::4], axis=1)[:, -3] if k else np.full(30, -np.inf)
    count = lambda x: np.array([len(v) for v in x])
    for tile, piece, known in ((1024, 64, least), (50, 7, np.full(30, -np.inf)), (7, 1, least)):
        monkeypatch.setattr(N, "TILE", tile)
        monkeypatch.setattr(N, "SLICE", piece)
        got = N._best(ids, np.concatenate(items), count(items), names, np.concatenate(asks), count(asks), known, k, threshold).to_pylist()
        assert {(x["query_id"], x["item_id"], x["score"]) for x in got} == want and len(got) == len(want)
