"""Operator 3: near-duplicates by SimHash and multi-index hashing.

A fingerprint holds 64 bits.  It is cut into segments whose ball radii r_i
satisfy sum(r_i + 1) > distance, so two fingerprints within that distance
agree in at least one segment up to its radius.  Every fingerprint is stored
once per segment; probes enumerate the ball, fetch the stored fingerprints by
an equi-join and verify the complete distance.

Buckets that hold many *different* fingerprints (a dense cloud of near copies)
are cut into blocks; each pair of blocks is verified as a bit matrix and
reported as a spanning forest, so neither rows nor memory grow with the square
of a bucket, and no link is lost for the components.

``near_pairs`` is the same index for texts at a similarity: a wider distance,
balls split between both sides, and pairs instead of a forest, since each is
then verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, small_batches, without
from .components import connected_components

#: (first bit, width, ball radius) of each segment; the radii guarantee a distance of 4.
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
#: The same for a distance of 11: both sides enter a ball of radius 1, so they meet up to radius 2.
WIDE, WIDE_DISTANCE = ((0, 16, 2), (16, 16, 2), (32, 16, 2), (48, 16, 2)), 11
#: Near fingerprints after which one leaves a bucket.
LINKS = 8


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the A-Z-lower-cased words' shingles, repeats included; no words give 0."""
    from xxhash import xxh64_digest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    runs = [b" ".join(tokens[i : i + shingle]) for i in range(max(1, len(tokens) - shingle + 1))]
    return _majority(np.frombuffer(b"".join([xxh64_digest(r, seed) for r in runs]), dtype=np.uint8))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, of eight bytes each."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8 << 16):  # long texts in bounded memory
        ones += np.unpackbits(hashes[at : at + (8 << 16)].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(16 * ones > len(hashes)).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of a set of 64-bit shingle hashes, as a signed long; an empty set gives 0."""
    h = hashes.view(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    one = _majority(h.view(np.uint8))
    return one - (1 << 64) if one >> 63 else one


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp)``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": values.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, fp bigint")


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _around(seg: int, first: int, width: int, radius: int) -> Column:
    """The bucket keys within ``radius`` of a fingerprint's segment."""
    own = _segment(F.col("fp"), first, width)
    return F.transform(F.lit(_ball(width, radius)).cast("array<bigint>"), lambda m: F.struct(F.lit(seg).alias("seg"), own.bitwiseXOR(m).alias("value")))


def _forest(probe: np.ndarray, held: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bipartite graph of pairs within ``distance``."""
    near = np.bitwise_count(probe.view(np.uint64)[:, None] ^ held.view(np.uint64)[None, :]) <= distance
    left, right = np.arange(len(probe)), len(probe) + np.arange(len(held))
    big = len(probe) + len(held)
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], big).min(axis=0))
        new_left = np.minimum(left, np.where(near, new_right[None, :], big).min(axis=1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    value, root = np.concatenate([probe, held]), np.concatenate([left, right])
    at = np.flatnonzero(root != np.arange(big))
    return [(int(value[i]), int(value[root[i]])) for i in at if value[i] != value[root[i]]]


def hamming_links(distinct: DataFrame, distance: int = 4, segments=SEGMENTS, dense: int = 64, block: int = 1024) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs of ``distinct.fp`` within ``distance``."""
    if sum(r + 1 for _, _, r in segments) <= distance or sum(w for _, w, _ in segments) != 64:
        raise ValueError("these segments don't guarantee that distance")
    table = distinct.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), a, w).alias("value")) for i, (a, w, _) in enumerate(segments)])).alias("k"),
        "fp",
    ).select("k.*", "fp")
    probes = distinct.select(
        F.explode(
            F.concat(
                *[_around(i, a, w, r) for i, (a, w, r) in enumerate(segments)]
            )
        ).alias("k"),
        F.col("fp").alias("probe"),
    ).select("k.*", "probe")
    sizes = cut(table.groupBy("seg", "value").agg(F.count("*").alias("n")))
    # one row per bucket: its fingerprints if few, only their number if many
    buckets = cut(
        hot_join(table, sizes, ["seg", "value"])
        .groupBy("seg", "value", "n")
        .agg(F.collect_list(F.when(F.col("n") <= dense, F.col("fp"))).alias("held"))
    )
    met = cut(
        probes.join(buckets, ["seg", "value"])
        .select("seg", "value", "n", "probe", F.filter("held", lambda q: (q < F.col("probe")) & (F.bit_count(q.bitwiseXOR(F.col("probe"))) <= distance)).alias("near"))
        .where((F.col("n") > dense) | (F.size("near") > 0))
    )
    direct = met.where(F.col("n") <= dense).select(F.col("probe").alias("u"), F.explode("near").alias("v"))

    large = buckets.where(F.col("n") > dense).select("seg", "value", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    held = table.join(large, ["seg", "value"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    asked = met.where(F.col("n") > dense).join(large, ["seg", "value"]).withColumn("slice", F.pmod(F.xxhash64("probe"), F.col("parts")).cast("int"))
    blocks = held.select(
        "seg", "value", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "fp", F.lit(False).alias("asks")
    ).unionByName(
        asked.select("seg", "value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slice", F.col("probe").alias("fp"), F.lit(True).alias("asks"))
    )

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        fp, asks = group["fp"].to_numpy(np.int64), group["asks"].to_numpy(bool)
        probe, stay = fp[asks], fp[~asks]
        edges: list[tuple[int, int]] = []
        for i in range(0, len(probe), block):  # bounded memory even if a slice is larger than planned
            for j in range(0, len(stay), block):
                edges += _forest(probe[i : i + block], stay[j : j + block], distance)
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    return direct.unionByName(blocks.groupBy("seg", "value", "part", "slice").applyInPandas(verify, "u bigint, v bigint"))


def near_pairs(distinct: DataFrame, distance: int = WIDE_DISTANCE, segments=WIDE, links: int = LINKS) -> DataFrame:
    """Pairs ``(u, v)`` of ``distinct.fp`` within ``distance``, each once.

    A fingerprint enters the buckets of half a ball around each segment, so two
    meet wherever their segments differ by up to the radius, which must be 0 or
    2.  In a bucket each is compared with those behind it, until ``links`` of
    them were near: in a cloud pairs are left out, though hardly a component.
    """
    if sum(r + 1 for _, _, r in segments) <= distance or any(w > 16 or r not in (0, 2) for _, w, r in segments):
        raise ValueError("these segments don't guarantee that distance")
    entered = distinct.select("fp", F.explode(F.concat(*[_around(i, a, w, r // 2) for i, (a, w, r) in enumerate(segments)])).alias("k"))
    rows = entered.select("fp", (F.col("k.seg") * (1 << 16) + F.col("k.value")).cast("int").alias("bucket"))
    groups = 2048 + distinct.count() // 5000

    def home(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The one bucket of those two near fingerprints meet in that reports them."""
        out = np.full(len(u), -1, np.int64)
        for i, (a, w, r) in reversed(list(enumerate(segments))):
            mask = np.uint64((1 << w) - 1)
            own, differ = ((u >> np.uint64(a)) & mask).astype(np.int64), (((u ^ v) >> np.uint64(a)) & mask).astype(np.int64)
            low = differ & -differ
            out = np.where(np.bitwise_count(differ) <= r, (i << 16) + np.minimum(own ^ low, own ^ differ ^ low), out)
        return out

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        fp, bucket = group["fp"].to_numpy(np.int64).view(np.uint64), group["bucket"].to_numpy(np.int64)
        order = np.lexsort((fp, bucket))
        fp, bucket = fp[order], bucket[order]
        end = np.searchsorted(bucket, bucket, side="right")
        at, seen, step, found = np.arange(len(fp)), np.zeros(len(fp), np.int64), 0, []
        while len(at):
            step += 1
            at = at[at + step < end[at]]
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
            if len(near):
                found.append(near[home(fp[near], fp[near + step]) == bucket[near]] + np.array([[0], [step]]))
                seen[near] += 1
                at = at[seen[at] < links]
        u, v = fp.view(np.int64)[np.concatenate(found, axis=1)] if found else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"u": u, "v": v})

    return rows.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("part")).applyInPandas(meet, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)``, one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``distance`` differing bits.  Null and blank texts have fingerprint zero
    and link like any other; rows with a null doc_id link but never name a
    component; repeated rows stay; other columns are ignored; no rows give none.
    """
    small_batches(docs.sparkSession)
    marked = cut(fingerprints(docs, shingle))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = cut(connected_components(hamming_links(classes.select("fp"), distance)).withColumnRenamed("node", "fp"))
    linked = classes.join(parts, "fp")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(linked.select("fp", "root", F.col("n").alias("copies")), cut(roots), ["root"]).select("fp", "component_id", F.col("copies").alias("n"))
    alone = classes.join(parts, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    out = hot_join(marked, cut(named.unionByName(alone)), ["fp"])
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id.  Rows without a doc_id stay."""
    found = near_duplicates(docs, distance, shingle)
    kept = without(docs, found.where("doc_id <> component_id").select("doc_id"))
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
