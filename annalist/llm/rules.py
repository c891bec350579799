"""Operator 5: quality rules as a bitmask ledger.

Every rule is evaluated once; a row keeps its measurements and one bit for each
failed rule.  A policy is a mask over the bits, so versions of a policy and
ablations are bitwise work over the ledger and never read a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Bit, name and condition for failure, over the columns of ``measure``.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > 2 * n_words AND n_symbols >= 5"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    ("long_words", "word_chars > 25 * n_words AND n_words > 0"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of the policy: the rules that reject.
POLICIES = {"v1": BASE, "v2": (*BASE, "many_symbols", "duplicate_lines"), "v3": tuple(name for name, _ in RULES)}


def mask(names) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(n) for n in set(names))


def _repeat_words(w: Column, k: int) -> Column:
    """Words that lie in a window of ``k`` words found twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    def covered(h: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            twice = F.filter(
                F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])),
                lambda p: p.isNotNull(),
            )
            return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x))

        slow = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), from_sorted)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    return F.when(F.size(w) <= k, F.lit(0)).otherwise(let(hashes, covered))


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and the measurements of its text (null: none)."""
    text = F.coalesce("text", F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    long = "bigint"
    return docs.select(
        "doc_id",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast(long).alias("n_words"), _repeat_words(w, 5).cast(long).alias("n_repeat_words"))).alias("w"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast(long).alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast(long).alias("n_symbols"),
        let(full, lambda x: F.struct(F.size(x).cast(long).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast(long).alias("n_dup_lines"))).alias("l"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that each text fails.

    Null and empty texts measure zero and fail ``few_words``.  Every row of
    ``docs`` gives a row, repeated and null ids too; no rows give none.
    """
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failed", total)


def apply_policy(book: DataFrame, names) -> DataFrame:
    m = mask(names)
    return book.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(m | mask(BASE))) == 0)


def ablation(book: DataFrame, names) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it rejects, rows kept without it.  One pass over the bits."""
    m = mask(names)
    hit = F.col("failed").bitwiseAND(F.lit(m))
    aggs = [F.count("*").alias("n"), F.count_if(hit == 0).alias("kept")]
    for name in names:
        b = mask([name])
        aggs += [F.count_if(hit.bitwiseAND(F.lit(b)) != 0).alias(f"{name}_fails"), F.count_if(hit == b).alias(f"{name}_alone")]
    wide = book.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_fails").alias("fails"), F.col(f"{n}_alone").alias("fails_alone"), (F.col("kept") + F.col(f"{n}_alone")).alias("kept_without")) for n in names])
    return wide.select(F.explode(rows).alias("r"), "n", "kept").select("r.*", "n", "kept")
