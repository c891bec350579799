"""Operator 1: quality classifier.

Document statistics -> random Fourier features, which approximate a Gaussian
kernel -> ridge scores from normal equations that are summed per partition and
then in two levels -> isotonic calibration on rows the ridge has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

N_STATS = 20
#: Fourier features, kernel width in standard deviations, ridge, seed.
FEATURES, WIDTH, RIDGE, SEED = 192, 6.0, 3.0, 42
#: The labelled rows that are learned from, at most about so many, and the partitions whose sums are taken.
LABELLED, PARTS = 400_000, 32
BINS = 1024
THRESHOLD = 0.7


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; all finite, for empty texts too."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    tokens = raw.split()
    w = max(1, len(tokens))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    high = counts[128:].sum()
    symbols = counts[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126, 124]].sum()
    share = counts[counts > 0] / n
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    distinct = len(set(tokens))
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) if tokens else np.zeros(1)
    return [
        math.log1p(len(raw)),
        math.log1p(len(tokens)),
        lengths.mean(),
        lengths.std(),
        upper / n,
        lower / n,
        digit / n,
        high / n,
        symbols / n,
        min(2.0, counts[124] / w),
        min(2.0, counts[33] / w),
        counts[[44, 59, 58]].sum() / w,
        counts[46] / w,
        math.log1p(w / max(1, counts[46] + counts[63] + counts[33])),
        -(share * np.log2(share)).sum() if len(share) else 0.0,
        distinct / w,
        1 - len(set(full)) / max(1, len(full)),
        math.log1p(w / max(1, len(full))),
        (lengths <= 3).mean(),
        upper / max(1, upper + lower),
    ]


NAMES = [f"s{i}" for i in range(N_STATS)]


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, N_STATS)


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def measured(docs: DataFrame, labels: DataFrame, held_out: int, limit: int = LABELLED) -> DataFrame:
    """``(fold, y, s0 ...)`` of the labelled documents outside the held-out fold, at most about ``limit`` of them, chosen by a hash of the id."""
    marks = labels.where("quality is not null and doc_id is not null").where(fold_of(F.col("doc_id")) != held_out)
    marks = cut(marks.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")))
    share = limit / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(_matrix(batch["text"]), columns=NAMES)
            out.insert(0, "y", batch["y"].to_numpy())
            out.insert(0, "fold", batch["fold"].to_numpy())
            yield out

    # the marks are bounded by ``limit``, so the texts need no shuffle
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select(fold_of(F.col("doc_id")).alias("fold"), "y", "text")
    return cut(texts.mapInPandas(run, "fold int, y double, " + ", ".join(f"{n} double" for n in NAMES)).repartition(PARTS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    edges: np.ndarray  # calibrated score of each bin of the raw score
    prior: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        rng = np.random.RandomState(SEED)
        w, b = rng.normal(size=(N_STATS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2.0) * np.cos(z @ w + b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        calibrated = self.edges[raw_bin(raw)]
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30))), 0, 1)  # ties keep the order of the raw scores


def raw_bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins; bins without rows take the value between their neighbours."""
    blocks: list[list[float]] = []  # sum, weight, bins
    used = np.flatnonzero(weight > 0)
    for i in used:
        blocks.append([total[i], weight[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + k]
    if not blocks:
        return np.full(len(weight), 0.5)
    values = np.concatenate([np.full(int(k), s / w) for s, w, k in blocks])
    return np.interp(np.arange(len(weight)), used, values)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, calibration: int = 3) -> Model:
    """Labelled rows outside the held-out fold are used, up to LABELLED; the sums of PARTS partitions bound all memory."""
    small_batches(docs.sparkSession)
    names = NAMES
    train = measured(docs, labels, held_out)
    head = train.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"d{c}") for c in names]).first()
    n_stats, zero = N_STATS, np.zeros(N_STATS)
    if not head["n"] or head["y"] in (0.0, 1.0):
        prior = 1.0 if not head["n"] else float(head["y"])  # nothing to tell apart: no labels keep all
        return Model(zero, zero + 1, np.zeros(1), np.zeros(BINS), prior)
    mean = np.array([head[f"m{c}"] for c in names])
    scale = np.array([head[f"d{c}"] for c in names])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(1 + n_stats + FEATURES), np.zeros(BINS))
    size = 1 + n_stats + FEATURES

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(batch[names].to_numpy())
            a += z.T @ np.hstack([z, batch[["y"]].to_numpy()])
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "a": [a.tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        a = sum(np.frombuffer(x, np.float64) for x in group["a"])
        return pd.DataFrame({"part": [0], "a": [a.tobytes()]})

    kind = "part bigint, a binary"
    level = train.where(F.col("fold") != calibration).mapInPandas(sums, kind)
    groups = math.isqrt(PARTS)
    merged = level.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInPandas(merge, kind).collect()  # at most sqrt(PARTS) matrices
    a = sum((np.frombuffer(bytes(r["a"]), np.float64) for r in merged), np.zeros(size * (size + 1))).reshape(size, size + 1)
    penalty = np.full(size, RIDGE)
    penalty[0] = 1e-6
    model.beta = np.linalg.solve(a[:, :size] + np.diag(penalty), a[:, size])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, w = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = raw_bin(model.raw(batch[names].to_numpy()))
            y += np.bincount(at, batch["y"], BINS)
            w += np.bincount(at, minlength=BINS)
        used = np.flatnonzero(w)
        yield pd.DataFrame({"bin": used, "y": y[used], "w": w[used]})

    bins = train.where(F.col("fold") == calibration).mapInPandas(binned, "bin bigint, y double, w double").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).collect()
    y, w = np.zeros(BINS), np.zeros(BINS)
    for r in bins:  # at most BINS rows
        y[r["bin"]], w[r["bin"]] = r["y"], r["w"]
    model.edges = isotonic(y, w) if bins else np.clip((np.arange(BINS) + 0.5) / BINS * 2 - 0.5, 0, 1)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    Only ``labels.quality`` of rows whose fold is not 2 is learned, and only
    the text enters a score.  Null texts score as empty ones.  Labels of a
    repeated doc_id are averaged; null labels and ids are ignored; a null
    doc_id has a null held_out.  Without any label every score is 1; with
    labels of one class, it is that class.  No documents give no rows.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fold": batch["fold"], "score": model.score(_matrix(batch["text"]))})

    scored = docs.select("doc_id", fold_of(F.col("doc_id")).alias("fold"), "text").mapInPandas(run, "doc_id bigint, fold int, score double")
    return scored.select("doc_id", (F.col("fold") == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those the classifier rejects, in one narrow pass: each row is judged by its own text, and no text is shuffled.

    Null texts are judged as empty ones; rows without a doc_id stay; other columns stay; no documents give no rows.
    """
    model = fit(docs, labels)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)) >= threshold)

    return docs.where(F.col("doc_id").isNull() | good("text"))
