"""Operator 11: exact dedup by a content sort.

Texts compare after lower-casing A-Z only.  Splitters drawn from a sample
weighted by size cut the order of (first characters, hash, doc_id) into parts of
near-equal bytes; a sort within each part, which spills to disk, places equal
texts side by side; and one pass over the sorted texts compares each with the
one before it, whole, and keeps the smallest (or largest) doc_id of a run.

Splitters hold a doc_id, so a text with a third of all copies is spread over
several parts.  Its runs then meet at the borders of parts; only these border
runs, two a part at most, are added up, by the digest of the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text a part should hold, the most parts, sampled rows a part, and characters of a text in a splitter.
PART_BYTES, MOST_PARTS, SAMPLED, HEAD = 32_000_000, 20_000, 20, 64
#: What a row weighs besides its text, and the ids of a run held at once.
ROW_BYTES, RUN = 64, 1_000_000
_MARKS = "doc_id bigint, text_sha256 string, size bigint, keeps bigint, run bigint, first boolean, open boolean"


def normal(text: Column) -> Column:
    """A text with A-Z in lower case and nothing else changed; null is empty."""
    full = F.coalesce(text, F.lit(""))
    # the plain function is fast, and means the same where no other letter stands
    return F.when(F.octet_length(full) == F.char_length(full), F.lower(full)).otherwise(F.translate(full, UPPER, UPPER.lower()))


def _key(norm: Column) -> Column:
    return F.struct(F.substring(norm, 1, HEAD).alias("head"), F.xxhash64(norm).alias("hash"), F.col("doc_id").alias("id"))


def splitters(texts: DataFrame, parts: int, weight: float) -> list[dict]:
    """At most ``parts - 1`` keys that cut ``texts(doc_id, text, bytes)`` into parts of near-equal bytes.

    A row is drawn with a chance in proportion to its bytes, by a hash of its
    id and text, so the sample has about SAMPLED rows a part at every size.
    """
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id", F.xxhash64("text")), F.lit(1 << 30)) < F.col("bytes") * (parts * SAMPLED / weight * (1 << 30))
    sample = texts.where(drawn).select(_key(normal(F.col("text"))).alias("k")).orderBy("k").collect()
    every = max(1, len(sample) / parts)
    picked = [sample[int(i * every)]["k"].asDict() for i in range(1, parts) if int(i * every) < len(sample)]
    return [k for i, k in enumerate(picked) if i == 0 or k != picked[i - 1]]


def _part(key: Column, bounds: list[dict]) -> Column:
    """How many of the sorted ``bounds`` a key has reached, by binary search."""
    if not bounds:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps(bounds)), "array<struct<head:string,hash:bigint,id:bigint>>")  # a constant of the plan
    steps = F.lit([1 << b for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(held, at + step - 1) <= key), at + step).otherwise(at))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of each run of equal texts of a sorted part, whose first row has the doc_id that stays."""
    names = ("doc_id", "text_sha256", "size", "keeps", "run", "first", "open")
    number = TaskContext.get().partitionId() << 32
    out: dict[str, list] = {c: [] for c in names}
    last, ids, starts = None, [], True  # starts: the run began before what is held of it, or may have begun in the part before

    def close(is_open: bool) -> None:
        size = len(ids)
        out["doc_id"] += ids
        for c, value in (("text_sha256", hashlib.sha256(last.encode("utf-8", "surrogatepass")).hexdigest()), ("size", size), ("keeps", ids[0]), ("run", number), ("open", is_open)):
            out[c] += [value] * size
        out["first"] += [True] + [False] * (size - 1)

    def ready() -> pd.DataFrame:
        frame = pd.DataFrame({c: pd.array(out[c], dtype="Int64") if c in ("doc_id", "keeps") else out[c] for c in names})
        for c in names:
            out[c] = []
        return frame

    for batch in batches:
        for text, doc in zip(batch["norm"], batch["doc_id"].astype("Int64").astype(object).where(batch["doc_id"].notna(), None)):
            if text != last or len(ids) >= RUN:
                if last is not None:
                    close(starts or text == last)
                    starts, number = text == last, number + 1
                last, ids = text, []
                if len(out["run"]) >= 20_000:
                    yield ready()
            ids.append(doc)
    if last is not None:
        close(True)
        yield ready()


def mark(docs: DataFrame, keep: str = "smallest", parts: int | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs(doc_id, text)``.

    keep_id is the ``smallest`` or ``largest`` doc_id of the rows with an equal
    text, kept says whether this row is the one that stays, and text_sha256 is
    of the normalised text.  Null and empty texts are equal.  Rows without a
    doc_id count in their group but stay only where no row of it has one; of
    rows that repeat both text and doc_id one stays.  Long texts are compared
    whole.  No rows give none; other columns, whatever their names, are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES)
    weight = texts.agg(F.sum("bytes")).first()[0] or 0
    parts = parts or min(MOST_PARTS, 1 + weight // PART_BYTES)
    bounds = splitters(texts, parts, weight) if parts > 1 and weight else []
    keyed = texts.select("doc_id", normal(F.col("text")).alias("norm"))
    dealt = keyed.select("doc_id", "norm", _part(_key(F.col("norm")), bounds).alias("part")).repartitionById(len(bounds) + 1, F.col("part"))
    last = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    norm = F.col("norm")
    marked = stored(dealt.sortWithinPartitions(F.substring(norm, 1, HEAD), F.xxhash64(norm), norm, last).select("doc_id", "norm").mapInPandas(_runs, _MARKS))
    # runs that may go on in another part: two a part at most, and one for every RUN rows of a run
    order = [F.col("keeps").isNull(), F.col("keeps") * (-1 if keep == "largest" else 1), F.col("run")]
    first = F.min_by(F.struct("keeps", "run"), F.struct(*order))
    spans = marked.where("open and first").groupBy("text_sha256").agg(F.sum("size").alias("all_size"), first.alias("best"))
    spans = spans.select("text_sha256", "all_size", F.col("best.keeps").alias("all_keeps"), F.col("best.run").alias("all_run"))
    out = marked.join(F.broadcast(spans), "text_sha256", "left")
    whole = F.col("all_size").isNull()
    return out.select(
        "doc_id",
        F.when(whole, F.col("keeps")).otherwise(F.col("all_keeps")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & (whole | (F.col("run") == F.col("all_run")))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, keep: str = "smallest", parts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat a doc_id and a text one stays, that with the least columns."""
    own_id, own_sha, n, row = fresh(docs.columns, "keep_id", "keep_sha", "n", "row")
    stays = mark(docs, keep, parts).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha))
    sha = F.sha2(normal(F.col("text")).cast("binary"), 256)
    hashed = docs.withColumn(own_sha, sha)
    left = hashed.join(cut(stays.withColumnRenamed(own_sha, n)), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(own_sha) == F.col(n)), "left_semi")
    twice = cut(left.groupBy("doc_id", own_sha).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col("doc_id").alias(own_id), F.col(own_sha).alias(row)))
    if not twice.take(1):
        return left.select(*docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(own_sha) == F.col(row))
    again = left.join(twice, same, "left_semi").groupBy("doc_id", own_sha).agg(F.min(F.struct(*docs.columns)).alias(n))
    return left.join(twice, same, "left_anti").select(*docs.columns).unionByName(again.select(f"{n}.*"))
