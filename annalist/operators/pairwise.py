"""All-pairs comparison, jury votes, win rates and sequential ratings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("completeness", "relevancy", "concision")


def all_pairs(responses: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Every unordered pair of a key's responses in both display orders."""
    a = responses.select(key, F.col(name).alias("a"), F.col(order).alias("oa"))
    b = responses.select(key, F.col(name).alias("b"), F.col(order).alias("ob"))
    both = F.explode(F.array(F.struct(F.col("a").alias("model_a"), F.col("b").alias("model_b"), F.lit("ab").alias("position")), F.struct(F.col("b").alias("model_a"), F.col("a").alias("model_b"), F.lit("ba").alias("position"))))
    return a.join(b, key).where("oa < ob").select(key, both.alias("p")).select(key, "p.*")


def majority(*labels: str) -> Column:
    """A or B if at least two of the labels say so, else TIE."""
    votes = {x: sum((F.when(F.col(c) == x, 1).otherwise(0) for c in labels), F.lit(0)) for x in "AB"}
    return F.when(votes["A"] >= 2, "A").when(votes["B"] >= 2, "B").otherwise("TIE")


def winner_model(label: Column) -> Column:
    return F.when(label == "A", F.col("model_a")).when(label == "B", F.col("model_b")).otherwise("TIE")


def win_rates(judged: DataFrame, label: str) -> DataFrame:
    """Wins, losses, ties and rates per model; one shuffle of two rows for each judgment, pre-aggregated."""
    side = F.explode(
        F.array(
            F.struct(F.col("model_a").alias("model"), (F.col(label) == "A").alias("w"), (F.col(label) == "B").alias("l")),
            F.struct(F.col("model_b").alias("model"), (F.col(label) == "B").alias("w"), (F.col(label) == "A").alias("l")),
        )
    )
    n = judged.select(side.alias("s")).select("s.*").groupBy("model").agg(F.count_if("w").alias("wins"), F.count_if("l").alias("losses"), F.count("*").alias("total"))
    return n.select("model", "wins", "losses", (F.col("total") - F.col("wins") - F.col("losses")).alias("ties"), "total", F.round(F.try_divide("wins", "total"), 6).alias("win_rate"), F.round(F.try_divide("wins", F.col("wins") + F.col("losses")), 6).alias("non_tie_win_rate"))


def jury_vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Plurality of labels per key; any tie for the top is a TIE; keys without a vote are left out."""
    counts = votes.where("label is not null").groupBy(*keys).agg(*[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("A", "B", "TIE")])
    top = F.greatest("a", "b", "tie")
    winners = sum((F.when(F.col(c) == top, 1).otherwise(0) for c in ("a", "b", "tie")), F.lit(0))
    return counts.withColumn("winner", F.when(winners > 1, "TIE").when(F.col("a") == top, "A").when(F.col("b") == top, "B").otherwise("TIE"))


def canonical(judged: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Both orders of a pair collapsed: a unanimous winner wins, any disagreement is a TIE; lo is A."""
    won = winner_model(F.nullif(F.col(label), F.lit("")))
    low = judged.where(F.nullif(F.col(label), F.lit("")).isNotNull()).select(*keys, F.least("model_a", "model_b").alias("lo_model"), F.greatest("model_a", "model_b").alias("hi_model"), won.alias("won"))
    g = low.groupBy(*keys, "lo_model", "hi_model").agg(F.min("won").alias("x"), F.max("won").alias("y"), F.count("*").alias("n_orders"))
    return g.select(*keys, "lo_model", "hi_model", "n_orders", F.when(F.col("x") != F.col("y"), "TIE").when(F.col("x") == F.col("lo_model"), "A").when(F.col("x") == F.col("hi_model"), "B").otherwise("TIE").alias("label"))


def missing_orders(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs seen in one display order, with the order that is missing."""
    g = judged.groupBy(*keys, F.least("model_a", "model_b").alias("lo_model"), F.greatest("model_a", "model_b").alias("hi_model")).agg(F.min(F.col("model_a") > F.col("model_b")).alias("x"), F.max(F.col("model_a") > F.col("model_b")).alias("y"))
    return g.where("x = y").select(*keys, F.when(F.col("x"), F.col("lo_model")).otherwise(F.col("hi_model")).alias("model_a"), F.when(F.col("x"), F.col("hi_model")).otherwise(F.col("lo_model")).alias("model_b"))


def flip(judged: DataFrame, labels=DIMENSIONS) -> DataFrame:
    """Every judgment in the other display order."""
    swapped = {c: F.when(F.col(c) == "A", "B").when(F.col(c) == "B", "A").otherwise(F.col(c)) for c in labels}
    position = F.when(F.col("position") == "ab", "ba").when(F.col("position") == "ba", "ab").otherwise(F.concat("position", F.lit("_flip")))
    return judged.withColumns({"model_a": F.col("model_b"), "model_b": F.col("model_a"), "position": position, **swapped})


def elo(judged: DataFrame, label: str, order: str, group: list[str] = (), k: float = 32.0, start: float = 1000.0) -> DataFrame:
    """Sequential Elo ratings by an ordered fold with a map state; one fold for each group.

    The fold of one group is sequential by nature; groups run in parallel.
    """
    rows = judged.where(F.col("model_a") != F.col("model_b")).select(*group, F.col(order).alias("o"), "model_a", "model_b", F.when(F.col(label) == "A", 1.0).when(F.col(label) == "B", 0.0).otherwise(0.5).alias("s"))
    folded = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("o", "model_a", "model_b", "s"))).alias("games"))
    state = "map<string,double>"

    def step(acc: Column, g: Column) -> Column:
        ra, rb = F.coalesce(acc[g["model_a"]], F.lit(start)), F.coalesce(acc[g["model_b"]], F.lit(start))
        gain = F.lit(k) * (g["s"] - 1 / (1 + F.pow(F.lit(10.0), (rb - ra) / 400)))
        new = F.map_from_arrays(F.array(g["model_a"], g["model_b"]), F.array(ra + gain, rb - gain))
        return F.map_concat(F.map_filter(acc, lambda m, _: (m != g["model_a"]) & (m != g["model_b"])), new)

    rated = folded.select(*group, F.aggregate("games", F.create_map().cast(state), step).alias("r"))
    return rated.select(*group, F.explode("r").alias("model", "elo")).withColumn("elo", F.round("elo", 1))


def seeded_order(n: int, seed: int = 42):
    """The rows in the order of a seeded shuffle: the k-th to come is row order[k]."""
    import numpy as np

    return np.random.RandomState(seed).permutation(n)


def elo_table(judged: DataFrame, order: str, labels=(*DIMENSIONS, "overall"), seed: int = 42, k: float = 32.0, start: float = 1000.0) -> DataFrame:
    """Ratings of every dimension after one seeded pass over all judgments, with wins, losses and ties of the overall label.

    A rating is a sequential fold, so one task holds the ratings (one row per
    model) and streams the games in order; the shuffle's permutation is 8 bytes
    a game on the driver.  Rates and counts are aggregated apart.
    """
    ranked = judged.select(order, "model_a", "model_b", *labels)
    n = ranked.count()
    spark = judged.sparkSession
    place = spark.createDataFrame(pd.DataFrame({"row": seeded_order(n, seed), "turn": range(n)}), "row bigint, turn bigint")
    numbered = numbered_rows(ranked, order)
    games = numbered.join(place, "row").coalesce(1).sortWithinPartitions("turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating: dict[str, list[float]] = {}
        for batch in batches:
            for a, b, *said in zip(batch["model_a"], batch["model_b"], *[batch[c] for c in labels]):
                ra, rb = rating.setdefault(a, [start] * len(labels)), rating.setdefault(b, [start] * len(labels))
                for i, label in enumerate(said):
                    gain = k * ({"A": 1.0, "B": 0.0}.get(label, 0.5) - 1 / (1 + 10 ** ((rb[i] - ra[i]) / 400)))
                    ra[i], rb[i] = (ra[i] + gain, rb[i] - gain) if a != b else (ra[i] + gain - gain, rb[i])
        names = sorted(rating)
        yield pd.DataFrame({"model": names} | {f"elo_{c}": [round(rating[m][i], 1) for m in names] for i, c in enumerate(labels)})

    rated = games.mapInPandas(run, "model string, " + ", ".join(f"elo_{c} double" for c in labels))
    return rated.join(win_rates(judged, labels[-1]), "model", "left").orderBy(F.desc(f"elo_{labels[-1]}"), "model")


def numbered_rows(df: DataFrame, order: str, block: int = 65_536) -> DataFrame:
    """``df`` with ``row``, its place in the order of an integer column, from counts of blocks; no task orders more than a block."""
    held = df.withColumn("_block", F.expr(f"`{order}` div {block}"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    return held.withColumn("_rank", rank).join(starts, "_block").withColumn("row", (F.col("_start") + F.col("_rank")).cast("bigint")).drop("_block", "_rank", "_start")
