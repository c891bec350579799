"""Semantic matching of facts: each side's best token F1 on the other side, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .lexical import tokens

#: Facts of a block, and different words of a block looked at in one matrix product.
FACTS, WORDS = 512, 4096
#: Facts that meet in one task call on average: small keys and dates go together, as a call costs more than their match.
TOGETHER = 16_384


def overlaps(left: list, right: list) -> np.ndarray:
    """How many different words each fact of one side shares with each of the other."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for facts in (left, right):
        owner = np.repeat(np.arange(len(facts)), [len(f) for f in facts])
        sides.append((owner, np.concatenate([np.asarray(f, np.int64) for f in facts]) if len(facts) else np.zeros(0, np.int64)))
    shared = np.intersect1d(sides[0][1], sides[1][1])
    for at in range(0, len(shared), WORDS):
        part, m = shared[at : at + WORDS], []
        for (owner, words), facts in zip(sides, (left, right)):
            place = np.minimum(np.searchsorted(part, words), len(part) - 1)
            here = part[place] == words
            m.append(np.zeros((len(facts), len(part)), np.float32))
            m[-1][owner[here], place[here]] = 1
        out += m[0] @ m[1].T
    return out


def best_matches(candidates: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """``(key, side, fact_idx, shared, total)``: for each fact the best match on the other side among facts of its date.

    Facts ``(key, fact_idx, fact, fact_date)`` compare by their sets of words;
    F1 is 2 * shared / total, where total counts the words of both.  The facts
    of a key and date are cut into blocks on both sides; a pair of blocks gives
    the best of every row and column, reduced by maximum, so no pair of facts
    becomes a row.  Pairs of blocks meet in buckets of about TOGETHER facts.  Undated facts match undated ones; facts without a partner
    of their date have shared 0.
    """
    kind = candidates.schema[key].dataType.simpleString()
    dated = lambda df: df.select(key, "fact_idx", F.coalesce(F.col("fact_date").cast("string"), F.lit("")).alias("day"), F.transform(F.array_distinct(tokens(F.coalesce("fact", F.lit("")))), lambda w: F.xxhash64(w)).alias("words"))
    left, right = dated(candidates), dated(references)
    parts = lambda df, name: df.groupBy(key, "day").agg(F.ceil(F.count("*") / FACTS).cast("int").alias(name), F.count("*").alias(f"n_{name}"))
    plan = kept(parts(left, "cs").join(parts(right, "rs"), [key, "day"]))
    meeting = plan.agg(F.sum(F.col("n_cs") * F.col("rs") + F.col("n_rs") * F.col("cs"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64(key, "day", "c", "r"), F.lit(max(1, -(-meeting // TOGETHER)))).alias("bucket")
    plan = plan.drop("n_cs", "n_rs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("fact_idx"), F.col(n)).cast("int")
    blocks = [key, "day", "c", "r"]
    own = [*blocks, "fact_idx", "words", "bucket"]  # both sides may come of one table, so their columns are named anew
    a = left.join(plan, [key, "day"]).withColumns({"c": place("cs"), "r": every("rs")}).select(*own[:-1], bucket).toDF(*own)
    b = right.join(plan, [key, "day"]).withColumns({"r": place("rs"), "c": every("cs")}).select(*own[:-1], bucket).toDF(*own)

    def meet(cs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        out = {name: [] for name in (key, "side", "fact_idx", "shared", "total")}
        if not len(cs) or not len(rs):
            return pd.DataFrame(out)
        places = [x.groupby(blocks, sort=False).indices for x in (cs, rs)]
        words, size, idx = ([x[name].to_numpy() for x in (cs, rs)] for name in ("words", "words", "fact_idx"))
        size = [np.array([len(w) for w in x]) for x in size]
        for group in places[0].keys() & places[1].keys():
            i, j = (p[group] for p in places)
            both, total = overlaps(list(words[0][i]), list(words[1][j])), size[0][i][:, None] + size[1][j][None, :]
            f1 = both / np.maximum(total, 1)
            best_c, best_r = (np.arange(len(i)), f1.argmax(axis=1)), (f1.argmax(axis=0), np.arange(len(j)))
            for side, ids, where in (("candidate", idx[0][i], best_c), ("reference", idx[1][j], best_r)):
                for name, values in ((key, [group[0]] * len(ids)), ("side", [side] * len(ids)), ("fact_idx", ids), ("shared", both[where].astype(int)), ("total", total[where])):
                    out[name].extend(values)
        return pd.DataFrame(out)

    met = a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInPandas(meet, f"`{key}` {kind}, side string, fact_idx bigint, shared bigint, total bigint")
    sides = left.select(key, F.lit("candidate").alias("side"), "fact_idx").unionByName(right.select(key, F.lit("reference").alias("side"), "fact_idx")).withColumns({"shared": F.lit(0).cast("bigint"), "total": F.lit(1).cast("bigint")})
    best = F.max_by(F.struct("shared", "total"), F.col("shared") / F.greatest("total", F.lit(1)))
    return met.unionByName(sides).groupBy(key, "side", "fact_idx").agg(best.alias("b")).select(key, "side", "fact_idx", "b.shared", "b.total")


def fact_scores(candidates: DataFrame, references: DataFrame, key: str, tenths: int = 9) -> DataFrame:
    """Per key how many facts of each side have a match at an F1 of ``tenths`` / 10 or more, and precision and recall; a side without facts has null."""
    hit = F.col("shared") * 20 >= F.col("total") * tenths
    of = lambda side: F.count_if(F.col("side") == side)
    got = lambda side: F.count_if((F.col("side") == side) & hit)
    n = best_matches(candidates, references, key).groupBy(key).agg(of("candidate").alias("n_cand"), got("candidate").alias("cand_hit"), of("reference").alias("n_ref"), got("reference").alias("ref_hit"))
    return n.select(key, "n_cand", "cand_hit", "n_ref", "ref_hit", F.round(F.try_divide("cand_hit", "n_cand"), 6).alias("precision"), F.round(F.try_divide("ref_hit", "n_ref"), 6).alias("recall"))
