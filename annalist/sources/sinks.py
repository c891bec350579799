"""Sinks: appends, snapshot replacement and per-key files."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, columns: list[str], kind: str = "parquet") -> None:
    """Append a fixed projection: extra columns go, missing ones are null."""
    have = set(df.columns)
    df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("append").options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)


def replace(df: DataFrame, base: str) -> str:
    """Write a new snapshot beside the old ones; its last step, one rename, makes it the current one.

    Snapshots are numbered folders.  A reader takes the highest complete one,
    so it sees the old table or the new one, never half of either.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hidden = jvm.org.apache.hadoop.fs.Path(f"{base}/_new-{uuid.uuid4().hex}")
    df.write.parquet(hidden.toString())
    fs = hidden.getFileSystem(conf)
    n = max(_versions(spark, base), default=0) + 1
    while not fs.rename(hidden, jvm.org.apache.hadoop.fs.Path(f"{base}/v{n:09d}")):
        n += 1  # another writer took the number
    return f"v{n:09d}"


def _versions(spark: SparkSession, base: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]


def current(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/v{max(_versions(spark, base)):09d}")


def remember(df: DataFrame, path: str, key: str = "subject_id") -> None:
    """Add rows to a cache by subject."""
    df.repartition(key).write.mode("append").partitionBy(key).parquet(path)


def ledger(failed: DataFrame, path: str) -> None:
    """Append failed requests with their reason as JSON lines."""
    failed.select("key", "reason").write.mode("append").json(path)


def staged(spark: SparkSession, path: str, stage: str, build) -> DataFrame:
    """The stored result of a stage, or the stage's own, stored first: a finished stage isn't run again."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{stage}/_SUCCESS")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        build().write.mode("overwrite").parquet(f"{path}/{stage}")
    return spark.read.parquet(f"{path}/{stage}")


def per_key(df: DataFrame, path: str, key: str, kind: str = "csv") -> None:
    """One folder per key; rows meet there first, so that a key doesn't get a file from every task."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder and read again, so that no later step runs it twice."""
    from .folders import scratch

    path = scratch(df.sparkSession, "pass")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A picture has a square of SIDE pixels for each cell, and MOST rows at most: its cells are gathered by the driver.
SIDE, MOST = 16, 500
#: Grey of a shade from 0 to 10; a cell without a value is white.
STEP, BLANK = 25, 255


def heatmap(cells: DataFrame, path: str) -> None:
    """Draw ``cells(rater_a, rater_b, shade)`` as a PNG file, the raters' names in order kept in its text chunk."""
    names = sorted(r[0] for r in cells.select("rater_a").union(cells.select("rater_b")).distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"a heat map has {MOST} rows at most")
    place, n = {x: i for i, x in enumerate(names)}, len(names)
    grey = [bytearray([BLANK]) * n for _ in names]
    for a, b, shade in cells.select("rater_a", "rater_b", "shade").collect():
        if shade is not None:
            grey[place[a]][place[b]] = STEP * int(shade)
    lines = b"".join((b"\0" + b"".join(bytes([g]) * SIDE for g in row)) * SIDE for row in grey)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", n * SIDE, n * SIDE, 8, 0, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"raters\0" + json.dumps(names).encode()) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    spark = cells.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(png))
    out.close()
