"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each changed until no column of ``taken`` has it, so that a caller's columns are never hidden."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is set and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="annalist-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut`` in compressed columnar files: for wide rows of which later steps read a few columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table; whatever is still needed of it must be written elsewhere by then."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if not folder.rsplit("/", 1)[1].startswith("table-"):
            raise ValueError(f"not a stored table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch: whole texts of so many documents are what a Python worker holds at once.
BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH rows if it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, so that case and punctuation don't hide a match."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles(tokens: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` tokens; a shorter text is one shingle, an empty one has none."""

    def hashed(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(t, i + j) for j in range(k)])))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(runs)

    return let(tokens, hashed)  # bound once: a text's words must not be cut anew for every shingle


def key128(*columns: Column) -> list[Column]:
    """Two 64-bit hashes, so that equal keys mean equal values even over 10**12 rows."""
    return [F.xxhash64(*columns).alias("key_a"), F.xxhash64(F.lit(0x5EED), *columns).alias("key_b")]


#: A key is hot if it holds more than this share of the rows that have a partner; so at most 1 / HOT keys are.
HOT, HOT_ROWS = 1 / 1000, 1000


def hot_join(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", count: str = "n") -> DataFrame:
    """``rows`` joined to ``one``, which has a row per key and ``count``, the number of ``rows`` of that key.

    A hot key may hold a third of all rows.  The few hot rows of ``one`` (1000
    at most, since each holds over a thousandth) are broadcast, so that the rows
    of a hot key stay where they are; all others meet in a shuffle.  Both sides
    are told apart by a filter on the keys' hashes: a key that shares the hash
    of a hot one goes the same way on both.  ``one`` should be materialised: it
    is read more than once.
    """
    least, any_hot = _hot_from(one, count)
    if not any_hot:
        return rows.join(one, keys, how)
    mark = F.xxhash64(*[F.col(k).cast(rows.schema[k].dataType) for k in keys])
    hot = mark.isin([r[0] for r in one.where(F.col(count) > least).select(mark).collect()])  # 1000 at most
    cold = rows.where(~hot).join(one.where(~hot), keys, how)
    return rows.where(hot).join(F.broadcast(one.where(hot)), keys).unionByName(cold)


def _hot_from(counted: DataFrame, count: str) -> tuple[float, bool]:
    """The number of rows beyond which a key is hot, and whether one is."""
    total, most = counted.agg(F.sum(count), F.max(count)).first()
    least = max((total or 0) * HOT, HOT_ROWS)
    return least, (most or 0) > least


def salted_join(rows: DataFrame, one: DataFrame, key: str, other: str, counted: DataFrame) -> DataFrame:
    """``rows`` joined to ``one``, which has a row per ``key``, where rows of ``one`` are too wide to broadcast.

    A hot key's rows are dealt by ``other`` to as many parts as they exceed the
    limit of ``hot_join``, and its row of ``one`` is copied to each part.
    ``counted`` has the keys of ``rows``, and should be materialised.
    """
    counts = cut(counted.groupBy(key).agg(F.count("*").alias("n")))
    least, any_hot = _hot_from(counts, "n")
    if not any_hot:
        return rows.join(one, key)
    hot = counts.where(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("parts"))
    few, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))  # 1000 keys at most
    left = rows.join(few, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    right = one.join(few, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [key, "salt"]).drop("salt")


def later_copies(posted: DataFrame, place: list[str], carried: list[str] = ()) -> DataFrame:
    """The rows of ``posted(key_a, key_b, ...)`` whose key stands earlier too, with ``source``, the first place and what it carries.

    Keys are counted by partial aggregation; places without an id are never
    cut.  ``posted`` should be materialised: it is read more than once.
    """
    keys = ["key_a", "key_b"]
    first = F.min_by(F.struct(*place, *carried), F.struct(*place))
    firsts = cut(posted.groupBy(*keys).agg(first.alias("source"), F.count("*").alias("n")).where("n > 1"))
    own = F.struct(*place)
    source = F.struct(*[F.col(f"source.{c}").alias(c) for c in place])
    return hot_join(posted, firsts, keys).where(~own.eqNullSafe(source)).where(F.col(place[0]).isNotNull())


def kept_pieces(pieces: Column, full: Column, gone: Column) -> Column:
    """``pieces`` without those that ``gone`` names, as indices into ``full``, the places of the pieces that hold a word; linear in both."""

    def kept(p: Column) -> Column:
        places = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        dropped = let(full, lambda at: F.transform(gone, lambda i: F.get(at, i)))
        return F.transform(F.array_except(places, dropped), lambda i: F.get(p, i))

    return let(pieces, kept)


#: Ids up to this number may be broadcast.
FEW_IDS = 500_000


def _distinct_ids(ids: DataFrame) -> DataFrame:
    ids = cut(ids.where("doc_id is not null").distinct())
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids(doc_id)``; whole texts are shuffled only if the ids are too many to broadcast."""
    return docs.join(_distinct_ids(ids), "doc_id", "left_anti").select(*docs.columns)


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids(doc_id)``, as narrow as ``without``."""
    return docs.join(_distinct_ids(ids), "doc_id", "left_semi").select(*docs.columns)
