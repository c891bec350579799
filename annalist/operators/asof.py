"""As-of joins by time buckets.

Every row before a cutoff's bucket is visible whole, so only rows of the bucket
that holds the cutoff are compared with it one by one.  Aggregates take the
buckets before it from prefix sums; rows meet by (subject, bucket, salt), so a
subject's rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a bucket of a subject is dealt to.
SALTS = 16


def _bucket(day: Column) -> Column:
    """The month of a date, as a number."""
    return (F.year(day) * 12 + F.month(day)).cast("int")


def _salted(notes: DataFrame, key: str) -> DataFrame:
    return notes.withColumns({"bucket": _bucket(F.col("note_date")), "salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")})


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def as_of_rows(questions: DataFrame, notes: DataFrame, key: str = "note_idx") -> DataFrame:
    """``questions`` joined to the dated notes of their subject up to the cutoff, inclusive: all columns of both sides.

    Questions are copied to the buckets up to their cutoff in which their
    subject has a row, and to each salt; undated notes and questions without a
    cutoff join nothing.
    """
    dated = _salted(notes.where("note_date is not null"), key)
    held = dated.groupBy("subject_id").agg(F.sort_array(F.collect_set("bucket")).alias("held"))  # a number a month
    placed = questions.where("cutoff is not null").join(held, "subject_id").withColumn("last", _bucket(F.col("cutoff")))
    asked = placed.withColumn("bucket", F.explode(F.filter("held", lambda b: b <= F.col("last")))).withColumn("salt", _every_salt()).drop("held")
    met = asked.join(dated, ["subject_id", "bucket", "salt"]).where("bucket < last or note_date <= cutoff")
    return met.select(*questions.columns, *[c for c in notes.columns if c != "subject_id"])


def as_of_summary(questions: DataFrame, notes: DataFrame, key: str = "note_idx") -> DataFrame:
    """``questions(question_id, subject_id, cutoff)`` with ``n``, ``first_date`` and ``last_date`` of the notes visible to each; none: 0 and null."""
    dated = _salted(notes.where("note_date is not null").select("subject_id", key, "note_date"), key)
    q = questions.select("question_id", "subject_id", "cutoff", _bucket(F.col("cutoff")).alias("bucket"))
    whole = dated.groupBy("subject_id", "bucket").agg(F.count("*").alias("n"), F.min("note_date").alias("first_date"), F.max("note_date").alias("last_date"))
    upto = Window.partitionBy("subject_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    prefix = whole.select("subject_id", "bucket", F.sum("n").over(upto).alias("n"), F.min("first_date").over(upto).alias("first_date"), F.max("last_date").over(upto).alias("last_date"))
    sums = prefix.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "first_date", "last_date"))).alias("sums"))
    before = q.join(sums, "subject_id").select("question_id", F.inline(F.slice(F.filter("sums", lambda x: x["bucket"] < F.col("bucket")), -1, 1))).drop("bucket")
    border = q.withColumn("salt", _every_salt()).join(dated, ["subject_id", "bucket", "salt"]).where("note_date <= cutoff")
    parts = before.unionByName(border.groupBy("question_id").agg(F.count("*").alias("n"), F.min("note_date").alias("first_date"), F.max("note_date").alias("last_date")))
    seen = parts.groupBy("question_id").agg(F.sum("n").alias("n"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    return questions.join(seen, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def newest_within(notes: DataFrame, size: Column, budget: int) -> DataFrame:
    """Per subject the newest notes that fit a budget, undated ones last: ``(subject_id, note_idx, note_date, used)``.

    Sums by month first: only months that begin within the budget are put in
    order note by note, so a long history costs no more than a short one.
    """
    sized = notes.select("subject_id", "note_idx", "note_date", size.cast("bigint").alias("size"), F.coalesce(_bucket(F.col("note_date")), F.lit(-1)).alias("bucket"))
    newer = Window.partitionBy("subject_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row a month
    sums = sized.groupBy("subject_id", "bucket").agg(F.sum("size").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(newer), F.lit(0)))
    near = sized.join(sums.where(F.col("before") <= budget).select("subject_id", "bucket", "before"), ["subject_id", "bucket"])
    within = Window.partitionBy("subject_id", "bucket").orderBy(F.desc_nulls_last("note_date"), "note_idx").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("used", F.col("before") + F.sum("size").over(within)).where(F.col("used") <= budget).select("subject_id", "note_idx", "note_date", "used")
