"""Resume, upsert, set and sampling operators on keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], filled: str | None = None) -> DataFrame:
    """Tasks without a completed row; a row counts only if ``filled`` isn't blank."""
    ok = done.where(F.coalesce(F.trim(filled), F.lit("")) != "") if filled else done
    return tasks.join(ok.select(*keys).distinct(), keys, "left_anti")


def upsert(previous: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return previous.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def resume_merge(previous: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New values where there are any, else the previous ones."""
    n = new.select(*keys, F.col(value).alias("_new"))
    return previous.join(n, keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def keyed_results(expected: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Expected requests with their returned text, and why it is missing."""
    got = lines.select(*keys, "status", F.col("text").alias("raw"), F.lit(True).alias("_got"))
    reason = F.when(F.col("_got").isNull(), "missing").when(F.coalesce("status", F.lit("")) != "", "error").when(F.coalesce(F.trim("raw"), F.lit("")) == "", "empty")
    return expected.join(got, keys, "left").withColumn("reason", reason).withColumn("text", F.when(reason.isNull(), F.col("raw"))).drop("_got", "raw", "status")


def cross_models(questions: DataFrame, models: list[str]) -> DataFrame:
    """Every question with every model of a short list."""
    return questions.select("*", F.explode(F.lit(list(models))).alias("model"))


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix within a budget: a running sum, since sizes aren't negative."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def rolling_batches(df: DataFrame, key: str, order: Column, size: Column, budget: int) -> DataFrame:
    """Greedy batches in order; an item larger than the budget stands alone.  Returns key, item order and batch.

    A key's items stream through one task in order; only the running sum is held.
    """
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used = object(), 0, 0
        for rows in batches:
            out = []
            for k, n in zip(rows[key], rows["n"]):
                if k != now:
                    now, batch, used = k, 0, 0
                elif used and used + n > budget:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield pd.DataFrame({key: rows[key], "o": rows["o"], "batch": out})

    rows = df.select(key, order.cast("bigint").alias("o"), size.cast("bigint").alias("n")).where(F.col(key).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, "o").mapInPandas(run, f"`{key}` {kind}, o bigint, batch bigint")


def running_ordinal(counts: DataFrame, key: str, order: str, n: str) -> DataFrame:
    """``counts`` with ``start``: how many items of the key stand before a row; the rows are counts, so windows stay small."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("bigint"))


def shuffled(df: DataFrame, keys: list[str], index: str, salt: str = "") -> DataFrame:
    """``df`` with ``place``, its place in a hash order of each group: the permutation, and with ``index`` its inverse."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(salt), *keys, index)), index)
    return df.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def drop_redundant(facts: DataFrame, key: str, judge: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], group: int = 500, passes: int = 3, least: int = 5) -> DataFrame:
    """Facts without those a judge calls redundant: ``facts(key, fact_idx, fact)`` to the ones that stay.

    ``judge`` gets ``(key, group, fact_idx, fact)`` and returns ``(key, fact_idx)``
    to remove.  One pass within groups in order is followed by up to ``passes``
    over shuffled groups; a key stops once a pass removes fewer than ``least``.
    ``save`` stores a pass, so that a judge is asked once.
    """
    left = facts.select(key, "fact_idx", "fact")
    gone = save(judge(left.select(key, F.expr(f"fact_idx div {group}").alias("group"), "fact_idx", "fact")).select(key, "fact_idx").distinct())
    active = left.select(key).distinct()
    for i in range(passes):
        rest = left.join(gone, [key, "fact_idx"], "left_anti")
        mixed = shuffled(rest.join(active, key, "left_semi"), [key], "fact_idx", str(i))
        found = save(judge(mixed.select(key, F.expr(f"place div {group}").alias("group"), "fact_idx", "fact")).select(key, "fact_idx").distinct())
        active = save(found.groupBy(key).count().where(F.col("count") >= least).select(key))
        gone = save(gone.unionByName(found).distinct())
        if not active.take(1):
            break
    return left.join(gone, [key, "fact_idx"], "left_anti")


def _place(key: Column) -> Column:
    """Where the hash order of a key stands between 0 and 2**32: its first eight digits."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def k_smallest(df: DataFrame, stratum: str, quotas: DataFrame, key: Column) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order, with their ``turn``; ``quotas(stratum, k, quota)`` has a row a stratum with its size.

    Hashes are even, so of a stratum of k rows all but very few of the first
    ``quota`` hashes lie below a bound somewhat above quota / k; rows beyond it
    never leave their task.  Strata in which fewer than their quota lie below
    are looked at whole, so the result is exact.
    """
    keep, bound, turn = F.least("quota", "k"), "__bound", "turn"
    share = (keep + 6 * F.sqrt(keep) + 20) / F.col("k")
    held = quotas.select(stratum, "quota", keep.alias("__keep"), F.when(share >= 1, F.lit(1 << 32)).otherwise(share * (1 << 32)).cast("bigint").alias(bound))
    placed = df.withColumn("__place", _place(key))
    near = placed.join(held, stratum).where(F.col("__place") < F.col(bound))
    # counts by stratum, so nothing but numbers meets
    few = near.groupBy(stratum).agg(F.count("*").alias("__n"), F.first("__keep").alias("__least")).where("__n >= __least").select(stratum)
    sure = near.join(few, stratum, "left_semi")
    rest = placed.join(held.join(few, stratum, "left_anti"), stratum)
    order = Window.partitionBy(stratum).orderBy("__place", F.md5(key.cast("string")), key)
    ranked = sure.unionByName(rest).withColumn(turn, F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col(turn) <= F.col("quota")).drop("__place", bound, "quota", "__keep")


def stratified_quota(df: DataFrame, stratum: str, n: int, key: Column) -> DataFrame:
    """About n rows in proportion to the strata, at least one of each, by hash order; the strata are few enough to be listed."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("k"))
    quotas = sizes.select(stratum, "k", F.greatest(F.lit(1), F.round(n * F.col("k") / F.lit(max(1, df.count()))).cast("int")).alias("quota"))
    return k_smallest(df, stratum, quotas, key).drop("turn")


def round_robin(df: DataFrame, stratum: str, n: int, key: Column) -> DataFrame:
    """n rows that take the strata in turn; of each stratum at most n rows leave their task but few."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("k"), F.lit(n).alias("quota"))
    return k_smallest(df, stratum, sizes, key).orderBy("turn", stratum).limit(n)


def hash_ranks(df: DataFrame, keys: list[str], key: Column, rank: str = "rank", rows: int = 50_000) -> DataFrame:
    """``df`` with the 1-based place of each row in the hash order of its group, ties by the key itself.

    Places come from counts of hash ranges and ranks within a range; ranges are
    narrow enough that about ``rows`` rows of the whole table share one, so no
    task orders a group whatever its size.
    """
    ranges = 1 << max(0, min(20, (df.count() // rows).bit_length()))
    placed = df.withColumns({"__place": _place(key)}).withColumn("__range", F.floor(F.col("__place") * ranges / (1 << 32)))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = placed.groupBy(*keys, "__range").agg(F.count("*").alias("__n")).select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys, "__range").orderBy("__place", F.md5(key.cast("string")), key)
    ranked = placed.withColumn("__within", F.row_number().over(within)).join(starts, [*keys, "__range"])
    return ranked.withColumn(rank, (F.col("__start") + F.col("__within")).cast("bigint")).drop("__place", "__range", "__within", "__start")


def rate_window(events: DataFrame, by: str, at: str, size: str, seconds: int = 60) -> DataFrame:
    """Trailing sum over a time range, as a rate limiter sees it."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.sum(size).over(w))


def jobs(requests: DataFrame, key: str, limit: int = 200_000, block: int = 65_536) -> DataFrame:
    """``requests`` with ``job``: at most ``limit`` requests a job, in the order of the integer ``key``.

    Ranks come from counts of key blocks and ranks within a block, so no task
    orders more than ``block`` different keys; only the counts meet in one.
    """
    placed = requests.withColumn("_block", F.expr(f"`{key}` div {block}"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    ranked = placed.withColumn("_rank", rank).join(starts, "_block")
    return ranked.withColumn("job", F.floor((F.col("_start") + F.col("_rank")) / limit)).drop("_block", "_rank", "_start")


def same_requests(manifest: DataFrame, requested: DataFrame, key: str) -> bool:
    """Whether a manifest covers exactly the requested ids, so that its jobs may be attached to again."""
    sides = manifest.select(key, F.lit(1).alias("_s")).unionByName(requested.select(key, F.lit(2).alias("_s"))).groupBy(key).agg(F.bit_or("_s").alias("_s"))
    return not sides.where("_s <> 3").take(1)


def rolling_progress(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the last batch with an answer, how many there are, and whether it is done: the state from which to resume."""
    ok = rows.where(F.coalesce(F.trim("answer"), F.lit("")) != "")
    last = ok.groupBy(*keys).agg(F.max_by(F.struct("batch", "total", "answer"), "batch").alias("x"))
    return last.select(*keys, "x.batch", "x.total", "x.answer", (F.col("x.batch") + 1 >= F.col("x.total")).alias("complete"))


def output_columns(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The columns of an output file: keys first, then the asked metrics in their order; a metric that is absent is null."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(m) if m in have else F.lit(None).cast("double").alias(m) for m in metrics])


def seeded_turns(rows: DataFrame, index: str, order) -> DataFrame:
    """``rows`` with ``turn``, the place of each row in a permutation of their numbers (8 bytes a row on the driver)."""
    turn = df_of(rows, order)
    return rows.join(turn, rows[index] == turn["_row"]).drop("_row")


def df_of(rows: DataFrame, order) -> DataFrame:
    return rows.sparkSession.createDataFrame(pd.DataFrame({"_row": order, "turn": range(len(order))}), "_row bigint, turn bigint")
