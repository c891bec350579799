"""Lexical, dense, late-interaction and fused retrieval over as-of visible records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_chunks
from ..sources.sinks import kept
from .lexical import bm25, tokens, top_k  # noqa: F401  a part of this module's interface


def as_of(questions: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes visible to each question: same subject, dated, not after the cutoff (inclusive)."""
    return questions.join(notes, "subject_id").where("note_date is not null and note_date <= cutoff")


def with_notes(ranked: DataFrame, notes: DataFrame) -> DataFrame:
    """``ranked(subject_id, note_idx, ...)`` with its notes.  It is stored first: Spark then knows its size, and a few ranked notes don't send all texts through a shuffle."""
    return kept(ranked).join(notes, ["subject_id", "note_idx"])


Scorer = Callable[[list[str], list[str]], list[float]]


def word_share(questions: list[str], texts: list[str]) -> list[float]:
    """A stub of a pair scorer: the share of a question's different words that a text holds."""
    found = re.compile(r"\w+").findall
    asked, held = ([set(found(x.lower())) for x in side] for side in (questions, texts))
    return [len(q & t) / len(q) if q else 0.0 for q, t in zip(asked, held)]


def rerank(pairs: DataFrame, scorer: Scorer, k: int | None = 10) -> DataFrame:
    """Pairs ``(question_id, note_idx, natural_query, text)`` scored in batches by a cross-encoder: (question_id, note_idx, score, rank)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = scorer(b["natural_query"].fillna("").tolist(), b["text"].fillna("").tolist())
            yield b[["question_id", "note_idx"]].assign(score=scores)

    scored = pairs.select("question_id", "note_idx", "natural_query", "text").mapInPandas(score, "question_id string, note_idx bigint, score double")
    return top_k(scored.withColumn("score", F.round("score", 6)), ["question_id"], [F.desc("score"), F.asc("note_idx")], k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised copy of a vector, in doubles."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def max_sim(q: Column, d: Column) -> Column:
    """Late interaction: the sum over query vectors of the best document vector's product."""
    return F.aggregate(F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y)))), F.lit(0.0), lambda s, x: s + x)


def fuse(first: DataFrame, second: DataFrame, key: str, item: str, k: int = 100, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two complete rankings (1-based ``rank``)."""
    both = first.select(key, item, F.col("rank").alias("r1")).join(second.select(key, item, F.col("rank").alias("r2")), [key, item])
    scored = both.select(key, item, F.round(1 / (constant + F.col("r1") - 1) + 1 / (constant + F.col("r2") - 1), 8).alias("score"))
    return top_k(scored, [key], [F.desc("score"), F.asc(item)], k)


def candidates(*ranked: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """Union that keeps order: the first source's items by rank, then the next one's new ones; at most k."""
    tagged = [r.select(key, item, F.lit(i).alias("src"), "rank") for i, r in enumerate(ranked)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    first = union.groupBy(key, item).agg(F.min(F.struct("src", "rank")).alias("at"))
    return top_k(first, [key], [F.asc("at"), F.asc(item)], k).select(key, item, "rank")


def search(notes: DataFrame, start: str | None = None, end: str | None = None, keywords: list[str] = (), types: list[str] = (), match: str = "any") -> DataFrame:
    """The notes tool: string comparison of dates, any or all keywords in title and text, types in the title."""
    day, out = F.coalesce(F.col("note_date").cast("string"), F.lit("")), notes
    if start:
        out = out.where(day >= start)
    if end:
        out = out.where(day <= end)
    for needles, hay in ((keywords, F.concat_ws(" ", "note_title", "text")), (types, F.col("note_title"))):
        if needles:
            found = [F.contains(F.lower(hay), F.lit(n.lower())) for n in needles]
            test = found[0]
            for f in found[1:]:
                test = (test & f) if match == "all" else (test | f)
            out = out.where(test)
    return out


def listing(notes: DataFrame, width: int = 100) -> DataFrame:
    preview = F.translate(F.substring("text", 1, width), "\n", " ")
    return notes.select("subject_id", "note_idx", F.concat_ws(" | ", F.concat(F.lit("["), F.col("note_idx"), F.lit("]")), F.coalesce(F.col("note_date").cast("string"), F.lit("")), "note_title", preview).alias("line"))


def profile(notes: DataFrame) -> DataFrame:
    """Per subject: notes, first and last date, titles by falling count."""
    titles = notes.groupBy("subject_id", "note_title").agg(F.count("*").alias("n")).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "note_title"))).alias("t"))
    span = notes.groupBy("subject_id").agg(F.count("*").alias("n_notes"), F.min("note_date").alias("first_date"), F.max("note_date").alias("last_date"))
    return span.join(titles, "subject_id").select("subject_id", "n_notes", "first_date", "last_date", F.array_join(F.transform("t", lambda x: F.concat(x["note_title"], F.lit(": "), -x["m"])), ", ").alias("titles"))


def context(ranked: DataFrame, key: str) -> DataFrame:
    """The retrieved notes of a key as one prompt block, by rank."""
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "note_title", F.coalesce(F.col("note_date").cast("string"), F.lit("")).alias("note_date"), "text"))).alias("r"))
    return rows.select(key, F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), x["rank"], F.lit("] Note Title: "), x["note_title"], F.lit("\nNote Date: "), x["note_date"], F.lit("\nText: "), x["text"])), "\n\n").alias("context"))


def chunks(notes: DataFrame, size: int = 4000, overlap: int = 400) -> DataFrame:
    """The notes' chunks as retrieval units: chunk_id, subject_id, note_idx, chunk_idx, note_date, note_title, text."""
    cut = notes.select("subject_id", "note_idx", "note_date", "note_title", F.posexplode(split_chunks(F.col("text"), size, overlap)).alias("chunk_idx", "text"))
    return cut.withColumn("chunk_id", F.concat_ws("_", "subject_id", "note_idx", "chunk_idx"))


def chunk_bm25(questions: DataFrame, notes: DataFrame, k: int = 50, size: int = 4000, overlap: int = 400) -> DataFrame:
    """BM25 over the chunks of the notes visible to each question: (question_id, chunk_id, score, rank)."""
    held = chunks(notes, size, overlap)
    # chunks take the place of notes; their numbers order ties as the list of chunks does
    number = (F.col("note_idx") * 1_000_000 + F.col("chunk_idx")).cast("bigint")
    found = bm25(questions, held.select("subject_id", number.alias("note_idx"), "note_date", "text"), k)
    name = F.concat_ws("_", F.split_part("question_id", F.lit("_"), F.lit(1)), F.expr("note_idx div 1000000"), F.col("note_idx") % 1_000_000)
    return found.select("question_id", name.alias("chunk_id"), "score", "rank")


def note_candidates(scored: DataFrame, key: str, k: int, least: float = 0.0) -> DataFrame:
    """Notes by the best score of their chunks: ``scored(key, note_idx, score)`` above ``least`` to the k best notes."""
    best = scored.where(F.col("score") > least).groupBy(key, "note_idx").agg(F.max("score").alias("score"))
    return top_k(best, [key], [F.desc("score"), F.asc("note_idx")], k)
