"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared folder; a local one only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/annalist-{name}-{uuid.uuid4().hex}"


def named_files(df: DataFrame, path: str, suffix: str, order: Column | None = None) -> None:
    """``df(name, value)`` to one text file ``<name><suffix>`` for each name, its lines in ``order``; the driver renames one file a name."""
    spark = df.sparkSession
    held = df.repartition("name").sortWithinPartitions("name", *([] if order is None else [order]))
    held.select("name", "value").write.partitionBy("name").text(f"{path}/_parts")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(f"{path}/_parts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        label = folder.getPath().getName()
        if label.startswith("name="):
            for i, part in enumerate(f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")):
                fs.rename(part.getPath(), fs_path(f"{path}/{label[5:]}{suffix if not i else f'.{i}{suffix}'}"))
    fs.delete(root, True)
