"""Readers of the on-disk contracts.  Ids always stay strings; nothing is inferred."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "struct<note_date:string,note_title:string,text:string>"
TRIPLE = ("note_date", "note_title", "text")


def note_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``<subject>_subsetrecords.json``, each a JSON array of notes, to one row per note with its index.

    A file that isn't such an array is skipped, or fails the query if ``strict``.
    """
    files = spark.read.option("wholetext", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_subsetrecords\.json$", 1).alias("subject_id"))
    parsed = files.select("subject_id", F.from_json("value", f"array<{NOTE}>").alias("notes"), F.ltrim("value").startswith("[").alias("is_array"))
    if strict:
        good = F.when(F.col("notes").isNull() | ~F.col("is_array"), F.raise_error(F.concat(F.lit("not an array of notes: "), "subject_id")).cast(f"array<{NOTE}>")).otherwise(F.col("notes"))
        parsed = parsed.withColumn("notes", good)
    rows = parsed.where(F.col("is_array") & F.col("notes").isNotNull()).select("subject_id", F.posexplode("notes").alias("note_idx", "n"))
    return rows.select("subject_id", F.col("note_idx").cast("bigint").alias("note_idx"), "n.note_date", "n.note_title", "n.text")


def strings(spark: SparkSession, paths: str | list[str], columns: list[str], sep: str = ",", tolerant: bool = False) -> DataFrame:
    """CSV or TSV with a header, every column a string; ``tolerant`` drops bad lines."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', sep=sep, enforceSchema=False, mode="DROPMALFORMED" if tolerant else "FAILFAST").csv(paths)


def tagged_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A folder of CSV files with their stem as ``source_file``; ``*_sample.csv`` is left out."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    return df.where(~F.col("source_file").endswith("_sample"))


def configured(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Sources of a configuration as one table: source_name, question_id, model, text, facts."""
    out = None
    for s in sources:
        raw = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(s["path"])
        pick = lambda key, default=None: F.col(s[key]) if s.get(key) in raw.columns else F.lit(default).cast("string")  # noqa: B023, E731
        part = raw.select(F.lit(s["source_name"]).alias("source_name"), "question_id", pick("model_column", s["source_name"]).alias("model"), pick("text_column").alias("text"), pick("facts_column").alias("facts"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def shards(spark: SparkSession, path: str) -> DataFrame:
    """JSONL result shards in any order: key, status, text; both spellings of the key."""
    schema = "key string, custom_id string, status string, response struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    parts = F.get(F.get("response.candidates", F.lit(0))["content"]["parts"], F.lit(0))["text"]
    return raw.select(F.coalesce("key", "custom_id").alias("key"), "status", parts.alias("text")).where("key is not null")


def last_per_id(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lists of several files merged; of records with one id, the last file's last wins."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("_f"), F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("_p", "_r"))
    return raw.groupBy(F.col(f"_r.{key}").alias("_k")).agg(F.max_by("_r", F.struct("_f", "_p")).alias("_r")).select("_r.*")


def from_html(html: Column, schema: str) -> Column:
    """Records that a page carries as base64 JSON in ``data-records``."""
    return F.from_json(F.unbase64(F.regexp_extract(html, 'data-records="([A-Za-z0-9+/=\\s]*)"', 1)).cast("string"), schema)


def to_html(records: Column) -> Column:
    return F.concat(F.lit('<div data-records="'), F.regexp_replace(F.base64(F.to_json(records).cast("binary")), r"\s", ""), F.lit('"></div>'))


def resolve(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """A fixed projection from aliased columns: the first that exists; missing ones fail."""
    out = []
    for name, options in aliases.items():
        found = next((c for c in [name, *options] if c in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}: {options}")
        out.append(F.col(found).alias(name))
    return df.select(*out)


def note_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or JSON table of notes with a typed note_date; missing columns and dates that don't parse fail."""
    if path.rstrip("/").endswith(".csv"):
        raw = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(path)
    elif path.rstrip("/").endswith(".json"):
        raw = spark.read.option("primitivesAsString", True).json(path)
    else:
        raise ValueError("notes must be CSV or JSON")
    missing = sorted(set(TRIPLE) - set(raw.columns))
    if missing:
        raise ValueError(f"notes are missing required columns: {missing}")
    wrong = F.raise_error(F.concat(F.lit("not a date: "), "note_date")).cast("timestamp")
    stamp = F.try_to_timestamp("note_date")
    return raw.withColumn("note_date", F.when(F.col("note_date").isNotNull() & stamp.isNull(), wrong).otherwise(stamp))


def _with_rejects(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header of its own, and ``_rejected``: the line itself where it is of another width."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    columns = spark.read.options(**options, inferSchema=False).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_rejected"])
    return spark.read.schema(schema).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_rejected").csv(path)


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with headers of their own as one table of strings: columns a file lacks are null, lines of another width go."""
    return union_with_rejects(spark, paths)[0]


def union_with_rejects(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``union_files``, and beside it the lines left out: ``(source_file, line, parsed)``, parsed being what fits the header, as JSON."""
    good, bad = None, None
    for p in paths:
        raw = _with_rejects(spark, p)
        columns = [c for c in raw.columns if c != "_rejected"]
        # always true: Spark refuses to read nothing but the column of rejected lines, as a plain count would
        raw = raw.where(F.coalesce(F.length(columns[0]), F.lit(0)) >= 0)
        part = raw.where("_rejected is null").select(*columns)
        left = raw.where("_rejected is not null").select(F.col("_metadata.file_path").alias("source_file"), F.col("_rejected").alias("line"), F.to_json(F.struct(*columns)).alias("parsed"))
        good = part if good is None else good.unionByName(part, allowMissingColumns=True)
        bad = left if bad is None else bad.unionByName(left)
    if good is None:
        raise ValueError("no files")
    return good, bad


def tsv_facts(spark: SparkSession, path: str) -> DataFrame:
    """``index<TAB>fact`` files to ``(fact_idx, fact)``."""
    return strings(spark, path, ["index", "fact"], sep="\t").select(F.col("index").cast("bigint").alias("fact_idx"), "fact")


def cached(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache by subject, empty where nothing was stored yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def heatmap(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a drawn heat map: (rater_a, rater_b, shade)."""
    from .sinks import BLANK, SIDE, STEP

    def cells(batches):
        for batch in batches:
            for png in batch["content"]:
                at, chunks = 8, {}
                while at < len(png):
                    size = int.from_bytes(png[at : at + 4], "big")
                    chunks[png[at + 4 : at + 8]] = png[at + 8 : at + 8 + size]
                    at += 12 + size
                names = json.loads(chunks[b"tEXt"].split(b"\0", 1)[1])
                lines, width = zlib.decompress(chunks[b"IDAT"]), len(names) * SIDE + 1
                found = ((a, b, lines[i * SIDE * width + 1 + j * SIDE]) for i, a in enumerate(names) for j, b in enumerate(names))
                yield pd.DataFrame([(a, b, g // STEP) for a, b, g in found if g != BLANK], columns=["rater_a", "rater_b", "shade"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "rater_a string, rater_b string, shade bigint")
