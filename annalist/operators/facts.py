"""Atomic-fact precision and recall, jury consensus, unsupported claims and rubrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_share(indices: Column, n: Column) -> Column:
    """Share of n facts named by an index list: repeated and out-of-range indices don't count; 0 for no facts."""
    good = F.array_distinct(F.filter(indices, lambda i: (i >= 0) & (i < n)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(good) / n)


def juror_shares(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of entailed facts per key and juror."""
    return verdicts.groupBy(*keys, "juror").agg(F.count("*").alias("n_facts"), F.round(F.avg(F.col("vote").cast("int")), 4).alias("share"))


def consensus(verdicts: DataFrame, keys: list[str], fact: str, votes: int | None = None) -> DataFrame:
    """Facts with at least ``votes`` jurors (by default a majority), and their share per key."""
    per_fact = verdicts.groupBy(*keys, fact).agg(F.count_if(F.col("vote")).alias("yes"), F.count("vote").alias("jurors"))
    need = F.lit(votes) if votes else F.floor(F.col("jurors") / 2) + 1
    return per_fact.withColumn("entailed", F.col("yes") >= need).groupBy(*keys).agg(F.count("*").alias("n_facts"), F.count_if(F.col("entailed")).alias("n_entailed"), F.round(F.avg(F.col("entailed").cast("int")), 4).alias("consensus"))


def macro_average(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over jurors of their shares; jurors without a verdict don't count."""
    return juror_shares(verdicts.where("vote is not null"), keys).groupBy(*keys).agg(F.count("*").alias("jurors"), F.round(F.avg("share"), 4).alias("average"))


def claim_support(claims: DataFrame, supported: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: claims, supported ones, precision, unsupported rate and flag.  ``supported`` names claims by index."""
    total = claims.groupBy(*keys).agg(F.count("*").alias("n_claims"))
    hit = supported.join(claims.select(*keys, "fact_idx"), [*keys, "fact_idx"], "left_semi").groupBy(*keys).agg(F.countDistinct("fact_idx").alias("n_supported"))
    out = total.join(hit, keys, "left").withColumn("n_supported", F.coalesce("n_supported", F.lit(0)))
    return out.withColumns({"precision": F.round(F.col("n_supported") / F.col("n_claims"), 6), "unsupported_rate": F.round(1 - F.col("n_supported") / F.col("n_claims"), 6), "has_unsupported": F.col("n_supported") < F.col("n_claims")})


def support_lists(facts: Column, supported: Column) -> Column:
    """The same for list columns: empty lists are fully supported."""
    n = F.size(facts)
    hit = F.size(F.array_distinct(F.filter(supported, lambda i: (i >= 0) & (i < n))))
    precision = F.when(n == 0, F.lit(1.0)).otherwise(hit / n)
    return F.struct((n - hit).alias("unsupported"), precision.alias("precision"), F.when(n == 0, F.lit(0.0)).otherwise((n - hit) / n).alias("rate"))


def same_date_pairs(candidates: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Pairs of facts of one key that share their date, undated with undated."""
    c = candidates.select(key, F.col("fact_idx").alias("cand_idx"), F.coalesce(F.col("fact_date").cast("string"), F.lit("")).alias("day"))
    r = references.select(key, F.col("fact_idx").alias("ref_idx"), F.coalesce(F.col("fact_date").cast("string"), F.lit("")).alias("day"))
    return c.join(r, [key, "day"])


def rubric_points(criteria: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Points of the applied criteria (unknown ids give none), their number and the most reachable."""
    best = criteria.groupBy(key).agg(F.sum(F.greatest("points", F.lit(0))).alias("max_points"), F.count("*").alias("num_criteria"))
    got = applied.join(criteria, [key, "criterion"]).groupBy(key).agg(F.sum("points").alias("points"), F.count("*").alias("n_applied"))
    return best.join(got, key, "left").withColumns({"points": F.coalesce("points", F.lit(0)), "n_applied": F.coalesce("n_applied", F.lit(0))})


def rubric_items(items: DataFrame, scores: DataFrame, keys: list[str], votes: int = 2) -> DataFrame:
    """Items met by at least ``votes`` judges; items without a score are not met."""
    met = scores.groupBy(*keys, "item").agg(F.count_if(F.col("met")).alias("yes"))
    return items.join(met, [*keys, "item"], "left").groupBy(*keys).agg(F.count("*").alias("total_items"), F.count_if(F.coalesce("yes", F.lit(0)) >= votes).alias("items_met")).withColumn("rubric_score", F.round(F.col("items_met") / F.col("total_items"), 4))


def require_complete(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Gate: fails if any verdict is missing."""
    gap = F.count_if(F.col("vote").isNull())
    return verdicts.groupBy(*keys).agg(F.count("*").alias("n"), gap.alias("missing")).withColumn("n", F.when(F.col("missing") > 0, F.raise_error(F.lit("incomplete verdicts")).cast("bigint")).otherwise(F.col("n")))


def fully_marked(marks: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups all of whose marks are set, with their number: what few-shot turns may be built from."""
    return marks.groupBy(*keys).agg(F.count("*").alias("marks"), F.count(label).alias("_set")).where("marks = _set").drop("_set")
