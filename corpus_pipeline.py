"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
its result is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import decontam, jaccard, lines, packing, quality
from annalist.llm.common import read, shared_dir
from annalist.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; each row is judged by its own text.

    Null and empty texts are judged like any other; rows without a doc_id stay;
    ties at the threshold stay; without labels all stay; no documents give none.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, found by winnowing, and so do later copies of lines it finds repeated; documents of which no line is left go too.

    Null texts and texts without a word stay as they are; rows without a doc_id
    are never cut; rows that repeat a doc_id get the same cuts; of equal lines
    the first in (doc_id, line) order stays; very long texts and lines are
    handled whole; other columns are left out; no documents give none.
    """
    cleaned = lines.dedup_lines(docs)
    left = cleaned.where("n_removed = 0 or n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: texts at a 5-word Jaccard similarity of 0.8 or more.

    SimHashes within 11 bits are verified on the texts; an exact check between
    the groups so found adds the pairs whose SimHashes lie further apart.
    Null and blank texts are one group; the smallest doc_id of a group stays; of
    rows that repeat a doc_id one stays, that with the least text; rows without
    a doc_id stay; no documents give none.
    """
    return jaccard.keep_first(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is judged by its own text.

    Null and blank texts hold nothing; rows without a doc_id stay; null and
    blank items match nothing; no documents give none.
    """
    return decontam.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along a space-filling curve, one row a piece; null and empty texts are their end id.

    Ties on the curve are ordered by a hash of the id; rows that repeat a
    doc_id and rows without one are packed like others; very long texts are cut
    into pieces; other columns are left out; no documents give none.
    """
    return packing.pack(docs, tokenizer_path(), special=True).drop("tokens")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: The classifier and the fingerprints are beyond SQL; tests/llm checks the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
