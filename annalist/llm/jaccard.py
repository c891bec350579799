"""Near-duplicates by SimHash, verified by exact Jaccard similarity of word shingles, without loss.

Texts with equal shingle sets are one class, with the SimHash of its set.
Fingerprints within 11 bits meet by multi-index hashing (``simhash.near_pairs``),
and their classes are linked if the whole sets reach the similarity.  About nine
in ten pairs at 0.8 lie within that distance; at 0.8 itself two fingerprints
differ in 9.7 bits on average, so no distance holds all of them.

The pairs beyond are found by an exact check between the components linked so
far.  A class of n shingles shares at least m = ceil(n * similarity) of them with any other at the similarity, so of
its first n - m + e shingles in one global order (e is EXTRA, or m if less) at
least the smaller e of the two are common.  These are posted, and pairs that
share so many are verified on their whole sets.  The order puts shingles that
are frequent in a sample last, which only saves work.

Pairs within a component can't change the components, so they aren't compared
again.  Buckets of many classes never emit their pairs: they are
cut into blocks of bounded size, and each pair of blocks is compared as a matrix
of exact overlaps, of which only a spanning forest comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, discard, hot_join, only, salted_join, small_batches, stored, without
from .components import connected_components

#: Similarity as a fraction, so that thresholds are whole numbers.
SHINGLE, SIMILARITY = 5, (4, 5)
EXTRA, SAMPLED, FREQUENT = 8, 16, 100_000
#: Classes of a bucket beyond which it is compared in blocks, and the shingles and classes of a block: two blocks meet as a matrix of classes.
DENSE, BLOCK, CLASSES = 48, 200_000, 1000
_SETS = "doc_id bigint, key_a bigint, key_b bigint, n int, fp bigint, taken array<bigint>"


class Shingler:
    """Sorted sets of the 64-bit hashes of a text's shingles; words compare in lower case."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words, known = (text or "").lower().encode("utf-8", "surrogatepass").split(), self.known
        if len(known) > 500_000:  # a cache, not a vocabulary
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(ids))
        if not k:
            return np.zeros(0, np.int64)
        n = len(ids) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = (h ^ ids[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h.view(np.int64))


def _chunks(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Smaller frames, so that what a batch gives stays small too."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _sets(texts: DataFrame, frequent: np.ndarray, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Each text's set by key and size, its fingerprint, and the hashes it posts in the global order."""
    from xxhash import xxh3_128_digest

    a, b = similarity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Shingler(shingle)
        for batch in _chunks(batches):
            keys, sizes, prints, taken = [], [], [], []
            for text in batch["text"]:
                g = grams(text)
                late = frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] == g if len(frequent) and len(g) else np.zeros(len(g), bool)
                least = (len(g) * a + b - 1) // b
                keys.append(np.frombuffer(xxh3_128_digest(g.tobytes()), np.int64))
                sizes.append(len(g))
                prints.append(simhash.of_hashes(g))
                taken.append(np.concatenate([g[~late], g[late]])[: len(g) - least + min(EXTRA, least)])
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "key_a": [k[0] for k in keys], "key_b": [k[1] for k in keys], "n": sizes, "fp": prints, "taken": taken})

    return texts.mapInPandas(run, _SETS)


def _frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of the shingles found most often in a sample, at most FREQUENT; they only order the work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Shingler(shingle)
        for batch in _chunks(batches):
            found = [grams(t) for t in batch["text"]]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"h": h, "n": n})

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInPandas(run, "h bigint, n bigint")
    counts = sample.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return np.array(sorted(r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()), dtype=np.int64)


def _fits(m: Column, n: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    a, b = similarity
    return F.least(m, n) * b >= F.greatest(m, n) * a


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs(u, v)`` of doc_ids whose sets reach the similarity; only texts of pairs are cut into shingles."""
    a, b = similarity
    asked = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Shingler(shingle)
        for batch in _chunks(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "g": [grams(t) for t in batch["text"]]})

    held = stored(only(texts, asked).mapInPandas(run, "doc_id bigint, g array<bigint>"))
    # sets are wide, so that a text asked about often is copied to parts rather than broadcast
    half = salted_join(pairs, held.select(F.col("doc_id").alias("u"), F.col("g").alias("gu")), "u", "v", pairs)
    met = salted_join(half, held.select(F.col("doc_id").alias("v"), F.col("g").alias("gv")), "v", "u", pairs)
    both = met.select("u", "v", F.size("gu").alias("m"), F.size("gv").alias("n"), F.size(F.array_intersect("gu", "gv")).alias("both"))
    near = cut(both.where(F.col("both") * b >= (F.col("m") + F.col("n") - F.col("both")) * a).select("u", "v"))
    discard(held)
    return near


def _overlaps(sets: list[np.ndarray], chunk: int = 1024) -> np.ndarray:
    """How many shingles each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    order = np.argsort(grams := np.concatenate(sets), kind="stable")
    owner, grams = owner[order], grams[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    counts = np.diff(np.r_[starts, len(grams)])
    both = np.zeros((len(sets), len(sets)), np.float32)
    often = counts > 24
    column = np.full(len(counts), -1)
    column[often] = np.arange(often.sum())
    at = np.repeat(column, counts)
    for lo in range(0, int(often.sum()), chunk):
        m = np.zeros((len(sets), chunk), np.float32)
        here = (at >= lo) & (at < lo + chunk)
        m[owner[here], at[here] - lo] = 1
        both += m @ m.T
    for s, n in zip(starts[~often & (counts > 1)], counts[~often & (counts > 1)]):
        who = owner[s : s + n]
        both[who[:, None], who] += 1  # a set holds a shingle once, so the places differ
    return both


def _forest(near: np.ndarray) -> np.ndarray:
    """The least index each row reaches over the links of a symmetric matrix with a full diagonal."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def _linked_blocks(texts: DataFrame, live: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs at the similarity within the buckets of ``live(gram, id, n, m, weight)``."""
    a, b = similarity
    asked = live.select(F.col("id").alias("doc_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Shingler(shingle)
        for batch in _chunks(batches):
            yield pd.DataFrame({"id": batch["doc_id"].to_numpy(), "g": [grams(t) for t in batch["text"]]})

    held = stored(only(texts, asked).mapInPandas(run, "id bigint, g array<bigint>"))
    parted = live.withColumn("parts", F.ceil(F.greatest(F.col("weight") / BLOCK, F.col("m") / CLASSES)).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    spread = parted.select("gram", "id", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    blocks = spread.select("gram", F.least("part", "q").alias("lo"), F.greatest("part", "q").alias("hi"), "id").join(held, "id")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("id")
        ids, sets = group["id"].to_numpy(np.int64), list(group["g"])
        n = np.array([len(g) for g in sets])
        near = _overlaps(sets) * (a + b) >= a * (n[:, None] + n[None, :])
        np.fill_diagonal(near, True)
        label = _forest(near)
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[at], "v": ids[label[at]]}, dtype="int64")

    near = cut(blocks.groupBy("gram", "lo", "hi").applyInPandas(verify, "u bigint, v bigint"))
    discard(held)
    return near


def _likely(classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs ``(u, v)`` of class ids whose SimHashes are near; where classes share one, the least speaks for it."""
    first = F.min(F.struct("id", "size"))
    prints = cut(classes.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")).select("fp", F.col("first.id").alias("u"), F.col("first.size").alias("u_size"), "n"))
    same = hot_join(classes.select("fp", F.col("id").alias("v"), F.col("size").alias("v_size")), prints, ["fp"]).where("u <> v")
    near = simhash.near_pairs(prints.select("fp")).withColumnsRenamed({"u": "fp", "v": "o_fp"})
    other = prints.select(F.col("fp").alias("o_fp"), F.col("u").alias("v"), F.col("u_size").alias("v_size"))
    both = near.join(prints, "fp").join(other, "o_fp").unionByName(same, allowMissingColumns=True)
    return cut(both.where(_fits(F.col("u_size"), F.col("v_size"), similarity)).select("u", "v"))


def _roots(classes: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges).withColumnRenamed("node", "id")
    return cut(classes.select("id", "n").join(found, "id", "left").withColumn("root", F.coalesce("root", "id")))


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``(doc_id, root)``: root is the least doc_id reachable over pairs at or above the similarity.

    Texts of fewer words than a shingle are one shingle.  Null and blank texts
    are one class.  Rows that repeat a doc_id are one document.  Rows without a
    doc_id are left out; no rows give none; other columns are ignored.
    """
    a, b = similarity
    small_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    marked = stored(_sets(texts, _frequent(texts, shingle), shingle, similarity))
    # copies go no further than this: a class is posted once, whatever its size
    keyed = marked.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("id"), F.first("n").alias("size"), F.first("fp").alias("fp"), F.min_by("taken", "doc_id").alias("taken"), F.count("*").alias("n"))
    wide = stored(keyed)
    members = stored(marked.select("doc_id", "key_a", "key_b"))
    discard(marked)
    classes = cut(wide.select("key_a", "key_b", "id", "size", "n", "fp"))
    unique = classes.select("id", F.col("size").alias("n"))
    first = _verified(texts, _likely(classes, similarity), shingle, similarity)
    rooted = _roots(unique, first)

    # distinct sets of fewer shingles can't reach the similarity: one of n shares n / (n + 1) with another at most
    posted = wide.where(F.col("size") * (b - a) >= a).select("id", F.posexplode("taken").alias("place", "gram"))
    # a shingle that one class alone posts, or classes of one component, adds no link
    shared = posted.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    open_ = stored(hot_join(posted, cut(shared), ["gram"]).select("id", "gram", "place").join(rooted, "id"))
    discard(wide)
    mixed = open_.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("weight")).where("lo <> hi").select("gram", "m", "weight")
    every = stored(hot_join(open_, cut(mixed), ["gram"], count="m"))
    discard(open_)
    dense = _linked_blocks(texts, every.where(F.col("m") > DENSE), shingle, similarity)
    live = every.where(F.col("m") <= DENSE).select("id", "gram", "place", "n", "root")
    other = live.select("gram", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "root", "place")])
    rest = F.least(F.col("n") - F.col("place"), F.col("o_n") - F.col("o_place"))
    pairs = (
        live.join(other, "gram")
        .where("id < o_id and root <> o_root")
        .where(_fits(F.col("n"), F.col("o_n"), similarity))
        # what stands before and behind the shared shingle bounds the overlap
        .where((F.least("place", "o_place") + rest) * (a + b) >= (F.col("n") + F.col("o_n")) * a)
        .groupBy(F.col("id").alias("u"), F.col("o_id").alias("v"))
        .agg(F.count("*").alias("common"), F.min(F.least("n", "o_n")).alias("least"))
        # shingles shared in dense buckets aren't counted, but a pair that shares one there is compared there
        .where(F.col("common") >= F.least(F.lit(EXTRA), F.ceil(F.col("least") * a / b)))
        .select("u", "v")
    )
    asked = cut(pairs)
    discard(every)
    second = _verified(texts, asked, shingle, similarity)
    done = _roots(unique, first.unionByName(dense).unionByName(second))
    named = cut(classes.select("key_a", "key_b", "id", F.col("n")).join(done.select("id", "root"), "id").select("key_a", "key_b", "root", "n"))
    return hot_join(members, named, ["key_a", "key_b"]).select("doc_id", "root")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id.  Rows without a doc_id stay.

    Of rows that repeat a doc_id one stays, that with the least text.
    """
    found = cut(groups(docs, shingle, similarity))
    kept = without(docs, found.where("doc_id <> root").select("doc_id"))
    twice = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.take(1):
        return kept
    again = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*").select(*docs.columns)
    return without(kept, twice).unionByName(again)
