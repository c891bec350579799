"""Resumable and streaming forms of the keyed operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import pending


def score_new(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, keys: list[str], checkpoint: str, schema: str) -> StreamingQuery:
    """Score only keys the sink lacks, micro-batch by micro-batch; a replayed batch adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        done = spark.read.schema(schema).option("mode", "PERMISSIVE").json(sink)
        score(pending(batch.dropDuplicates(keys), done, keys)).write.mode("append").json(sink)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_requests(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeated ids within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_load(events: DataFrame, at: str, by: str, size: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests and size per window and key; works on streams, with late rows up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
