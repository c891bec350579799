"""Cutoffs, temporal leakage and provenance of dated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leakage(retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: evidence after the cutoff and undated evidence; undated rows stay in the denominator."""
    future = F.count_if(F.col("note_date") > F.col("cutoff"))
    return retrieved.groupBy(*keys).agg(F.count("*").alias("n"), future.alias("n_future"), F.count_if(F.col("note_date").isNull()).alias("n_undated")).withColumns(
        {"future_rate": F.round(F.col("n_future") / F.col("n"), 6), "leaks": F.col("n_future") > 0}
    )


def date_overlap(reference: Column, candidate: Column) -> Column:
    """Struct of precision and recall between two date arrays, as sets; no candidates are precise only if none were asked."""
    r, c = F.array_distinct(F.array_compact(reference)), F.array_distinct(F.array_compact(candidate))
    shared = F.size(F.array_intersect(r, c))
    return F.struct(
        F.when(F.size(c) == 0, (F.size(r) == 0).cast("double")).otherwise(shared / F.size(c)).alias("precision"),
        F.when(F.size(r) == 0, F.lit(1.0)).otherwise(shared / F.size(r)).alias("recall"),
    )


def timeline_class(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: where the dated evidence lies with respect to the cutoff."""
    before, after, at = (F.coalesce(F.bool_or(x), F.lit(False)) for x in (F.col("note_date") < F.col("cutoff"), F.col("note_date") > F.col("cutoff"), F.col("note_date") == F.col("cutoff")))
    label = (
        F.when(F.col("n_dated") == 0, "undated").when(F.col("cutoff").isNull(), "cutoff_unknown").when(F.col("b") & F.col("a"), "spans_cutoff").when(F.col("a"), "after_cutoff").when(F.col("e") & ~F.col("b"), "at_cutoff").otherwise("before_cutoff")
    )
    return (
        evidence.groupBy(*keys)
        .agg(F.max("cutoff").alias("cutoff"), F.count("note_date").alias("n_dated"), before.alias("b"), after.alias("a"), at.alias("e"), F.min("note_date").alias("earliest"), F.max("note_date").alias("latest"))
        .select(*keys, label.alias("timeline_position"), "earliest", "latest")
    )


def provenance(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Roll candidate confirmations (``supports`` true, false or null for an error) up to a status per fact."""
    n = entries.groupBy(*keys).agg(F.count("*").alias("candidate_note_count"), F.count_if(F.col("supports")).alias("supporting_note_count"), F.count_if(F.col("supports").isNull()).alias("confirmation_error_count"), F.min(F.when(F.col("supports"), F.col("note_date"))).alias("earliest"), F.max(F.when(F.col("supports"), F.col("note_date"))).alias("latest"))
    status = F.when(F.col("supporting_note_count") > 0, "supported").when(F.col("confirmation_error_count") > 0, "inconclusive").otherwise("unsupported")
    return n.withColumn("status", status).withColumn("is_hallucinated", F.when(F.col("status") == "unsupported", True).when(F.col("status") == "supported", False))


def date_window(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Facts whose trailing date lies in the window; undated ones go."""
    day = F.try_to_date(F.regexp_extract("fact", r"\((\d{4}-\d{2}-\d{2})\)\s*$", 1), "yyyy-MM-dd")
    return facts.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def violations(questions: DataFrame, notes: DataFrame) -> DataFrame:
    """Data-set checks as rows: question_id, problem."""
    known = notes.select("subject_id").distinct()
    checks = [
        questions.where(~F.contains("question_id", F.lit("_")) | F.col("question_id").startswith("_")).select("question_id", F.lit("bad question_id").alias("problem")),
        questions.where(F.col("cutoff").isNull()).select("question_id", F.lit("bad timestamp").alias("problem")),
        questions.join(known, "subject_id", "left_anti").select("question_id", F.lit("no notes").alias("problem")),
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])
