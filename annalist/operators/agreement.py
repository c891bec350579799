"""Rater agreement over tidy ratings (unit, rater, label): one self-join feeds nearly every statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Units labelled by both raters, for every pair of raters: rater_a < rater_b, a, b."""
    x = ratings.where("label is not null").select(*keys, F.col("rater").alias("rater_a"), F.col("label").alias("a"))
    y = ratings.where("label is not null").select(*keys, F.col("rater").alias("rater_b"), F.col("label").alias("b"))
    return x.join(y, keys).where("rater_a < rater_b")


def _share(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


def binary_agreement(both: DataFrame, keys: list[str]) -> DataFrame:
    """n, raw agreement, Cohen's kappa (null if chance agreement is one) and PABAK of 0/1 labels."""
    s = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.withColumn("pe", pe).select(*keys, "n", F.round("po", 6).alias("agreement"), F.round(F.when(F.abs(1 - F.col("pe")) > 1e-12, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"), F.round(2 * F.col("po") - 1, 6).alias("pabak"))


def nominal_agreement(both: DataFrame, keys: list[str], labels=("A", "TIE", "B")) -> DataFrame:
    """n, agreement, nominal and quadratic-weighted kappa, and the rate of flips between the ends, for ordered labels."""
    index = F.create_map(*[x for i, c in enumerate(labels) for x in (F.lit(c), F.lit(i))])
    n = len(labels)
    x = both.withColumns({"i": index[F.col("a")], "j": index[F.col("b")]})
    aggs = [F.count("*").alias("n"), F.avg((F.col("i") == F.col("j")).cast("int")).alias("po"), F.avg(F.pow(F.col("i") - F.col("j"), F.lit(2)) / (n - 1) ** 2).alias("wo"), F.avg((F.abs(F.col("i") - F.col("j")) == n - 1).cast("int")).alias("flip")]
    aggs += [F.avg((F.col(c) == k).cast("int")).alias(f"{c}{k}") for c in "ij" for k in range(n)]
    g = x.groupBy(*keys).agg(*aggs)
    pe = sum((F.col(f"i{k}") * F.col(f"j{k}") for k in range(n)), F.lit(0.0))
    we = sum((F.col(f"i{k}") * F.col(f"j{m}") * ((k - m) ** 2 / (n - 1) ** 2) for k in range(n) for m in range(n)), F.lit(0.0))
    g = g.withColumns({"pe": pe, "we": we})
    return g.select(*keys, "n", F.round("po", 6).alias("agreement"), F.round(F.when(F.abs(1 - F.col("pe")) > 1e-12, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"), F.round(F.when(F.col("we") > 1e-12, 1 - F.col("wo") / F.col("we")), 6).alias("quadratic_kappa"), F.round("flip", 6).alias("flip_rate"))


def judge_accuracy(both: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-aware accuracy of b against a: strict, adjacent and flip sum to one."""
    same, tie = F.col("a") == F.col("b"), (F.col("a") == "TIE") | (F.col("b") == "TIE")
    g = both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(same).alias("s"), F.count_if(~same & tie).alias("adj"), F.count_if(~same & ~tie).alias("f"), F.count_if((F.col("a") != "TIE") & (F.col("b") != "TIE")).alias("c"))
    r = lambda x, d="n": F.round(_share(F.col(x), F.col(d)), 6)
    return g.select(*keys, "n", r("s").alias("strict"), r("adj").alias("adjacent"), r("f").alias("flip"), F.round((F.col("s") + F.col("adj")) / F.col("n"), 6).alias("tolerant"), F.round(F.try_divide(F.col("c") - F.col("f"), F.col("c")), 6).alias("committed"))


def transitions(both: DataFrame, keys: list[str], alpha: float = 0.0, labels=("A", "TIE", "B")) -> DataFrame:
    """Row-stochastic matrix of b given a, with Laplace smoothing; a label never seen gives nulls without it."""
    grid = both.select(*keys).distinct().select(*keys, F.explode(F.lit(list(labels))).alias("a")).select(*keys, "a", F.explode(F.lit(list(labels))).alias("b"))
    counts = both.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    rows = both.groupBy(*keys, "a").agg(F.count("*").alias("t"))
    full = grid.join(counts, [*keys, "a", "b"], "left").join(rows, [*keys, "a"], "left")
    return full.select(*keys, "a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.try_divide(F.coalesce("n", F.lit(0)) + alpha, F.coalesce("t", F.lit(0)) + alpha * len(labels)), 6).alias("p"))


def prevalence(ratings: DataFrame) -> DataFrame:
    """Share of positive labels by rater and direction, with pooled rows."""
    g = ratings.where("label is not null").rollup("rater", "direction").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"))
    return g.where("rater is not null").select("rater", F.coalesce("direction", F.lit("pooled")).alias("direction"), "n", "rate")


def majority_rater(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Binary majority per unit; exact splits are left out."""
    g = ratings.where("label is not null").groupBy(*keys).agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
    return g.where("2 * yes <> n").select(*keys, (2 * F.col("yes") > F.col("n")).cast("int").alias("label"))


def majority_choice(ratings: DataFrame, keys: list[str], raters: int) -> DataFrame:
    """A/B/TIE majority of units that all raters labelled; no unique top is a TIE."""
    g = ratings.where("label is not null").groupBy(*keys).agg(F.countDistinct("rater").alias("r"), *[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("A", "B", "TIE")]).where(F.col("r") == raters)
    return g.select(*keys, F.when((F.col("a") > F.col("b")) & (F.col("a") > F.col("tie")), "A").when((F.col("b") > F.col("a")) & (F.col("b") > F.col("tie")), "B").otherwise("TIE").alias("label"))


def symmetric(statistic: DataFrame, value: str) -> DataFrame:
    """Both halves of a pairwise statistic."""
    return statistic.select("rater_a", "rater_b", value).unionByName(statistic.select(F.col("rater_b").alias("rater_a"), F.col("rater_a").alias("rater_b"), value))


def profile(ratings: DataFrame, record: str) -> DataFrame:
    """Per rater: pooled rate and the mean of the records' rates."""
    per = ratings.where("label is not null").groupBy("rater", record).agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    return per.groupBy("rater").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"))


def strata(ratings: DataFrame, keys: list[str], raters: int) -> DataFrame:
    """Units that every rater labelled, unanimous or contested."""
    g = ratings.where("label is not null").groupBy(*keys).agg(F.countDistinct("rater").alias("r"), F.countDistinct("label").alias("d")).where(F.col("r") == raters)
    return g.groupBy(F.when(F.col("d") == 1, "unanimous").otherwise("contested").alias("stratum")).agg(F.count("*").alias("n"))


def leniency(both: DataFrame) -> DataFrame:
    """On disagreements of two raters: who says yes more often."""
    g = both.where("a <> b").groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.sum("a").alias("a_yes"), F.sum("b").alias("b_yes"))
    return g.withColumn("more_lenient", F.when(F.col("a_yes") > F.col("b_yes"), F.col("rater_a")).when(F.col("b_yes") > F.col("a_yes"), F.col("rater_b")).otherwise("tie"))


def leniency_index(pairwise: DataFrame) -> DataFrame:
    """Net yes votes on disagreements over all partners."""
    side = F.explode(F.array(F.struct(F.col("rater_a").alias("rater"), (F.col("a_yes") - F.col("b_yes")).alias("net")), F.struct(F.col("rater_b").alias("rater"), (F.col("b_yes") - F.col("a_yes")).alias("net"))))
    return pairwise.select(side.alias("s")).groupBy("s.rater").agg(F.sum("s.net").alias("net"))


def choice_profile(ratings: DataFrame) -> DataFrame:
    """Shares of A, B and TIE, decisiveness and A minus B, per rater."""
    g = ratings.where("label is not null").groupBy("rater").agg(F.count("*").alias("n"), *[F.avg((F.col("label") == x).cast("int")).alias(x.lower()) for x in ("A", "B", "TIE")])
    return g.select("rater", "n", F.round("a", 6).alias("share_a"), F.round("b", 6).alias("share_b"), F.round("tie", 6).alias("share_tie"), F.round(1 - F.col("tie"), 6).alias("decisiveness"), F.round(F.col("a") - F.col("b"), 6).alias("a_minus_b"))


def hedging(both: DataFrame) -> DataFrame:
    """Disagreements of two raters: flips between A and B, and which of them hedges with TIE."""
    return both.where("a <> b").groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.count_if((F.col("a") != "TIE") & (F.col("b") != "TIE")).alias("flips"), F.count_if(F.col("a") == "TIE").alias("a_hedges"), F.count_if(F.col("b") == "TIE").alias("b_hedges"))


def constant_raters(ratings: DataFrame) -> DataFrame:
    return ratings.where("label is not null").groupBy("rater").agg(F.countDistinct("label").alias("n_labels"), F.min("label").alias("only")).where("n_labels = 1").select("rater", "only")


def discrepancies(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Units on which two annotators differ, or that one of them lacks."""
    x, y = first.select(*keys, F.col("label").alias("a")), second.select(*keys, F.col("label").alias("b"))
    kind = F.when(F.col("a").isNull(), "only second").when(F.col("b").isNull(), "only first").otherwise("differs")
    return x.where("a is not null").join(y.where("b is not null"), keys, "full_outer").where("not (a <=> b)").withColumn("kind", kind)


def judge_vs_human(both: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion, precision, recall and F1 of binary judge labels b against a."""
    g = both.groupBy(*keys).agg(*[F.count_if((F.col("a") == i) & (F.col("b") == j)).alias(n) for n, i, j in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    return g.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6), "f1": F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)})
