"""Operator 10: license scans.

A text is cut into overlapping windows, of a size for each class of template
sizes: q is the power of two that holds the template (4 at least), a window has
2q shingles, and there is one every q shingles, so that a template that stands
in a text stands whole in some window of its class.

Windows and templates have MinHash signatures by one permutation: the hashes
are dealt to bins by their leading bits, and the least of each bin counts.  A
bin is a band of one row, and a template is retrieved for a window if they
agree in a band.  ``bits`` sets the bins so that a window that holds the asked
share of a template's shingles misses it with a probability of 1e-5 at most
(``miss``): for q up to 16 every hash is its own bin, so none is missed, and
above there are 256 bins.  Retrieved templates are verified by exact shingle
containment in the window.

Hashes that no template's signature holds can't make a band agree, so only
windows around the others are built; this loses nothing.  Everything is
built-in expressions: windows never leave their row or the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, plain_words, shingles
from .license_texts import NOTICES, TEXTS

SHINGLE, SHARE = 5, 0.8
TEMPLATES = NOTICES + TEXTS
#: Classes up to this size keep every hash; larger ones keep the least hash of 2 ** BITS bins.
EXACT, BITS = 16, 8


def size_class(n: int) -> int:
    """The class of a template of n different shingles."""
    return max(4, 1 << (n - 1).bit_length())


def bits(q: int) -> int:
    """Leading bits of a hash that name its bin in class q."""
    return 64 if q <= EXACT else BITS


def miss(n: int, share: float = SHARE) -> float:
    """A bound of the probability that no band of a template of n shingles agrees with a window that holds ``share`` of them.

    Of u different hashes in both, m are shared; a bin agrees if it isn't empty
    and its least hash is shared.
    """
    q = size_class(n)
    if q <= EXACT:
        return 0.0
    m = math.ceil(share * n)
    u, bins = 2 * q + n - m, 2**BITS
    return (1 - m / u * (1 - (1 - 1 / bins) ** u)) ** bins


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(rows), "license string, template string")


def signature(hashes: Column, q: Column) -> Column:
    """The least hash of every bin of class q that isn't empty, in order."""

    def least(s: Column) -> Column:
        first = F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, 64 - BITS) != F.shiftright(F.get(s, i - 1), 64 - BITS)))
        return F.when(q <= EXACT, s).otherwise(first)

    return let(F.sort_array(F.array_distinct(hashes)), least)


def _index(forms: DataFrame, shingle: int, share: float) -> list[tuple]:
    """Templates by class: ``(q, [(license, need, signature, set)])``."""
    rows = forms.select("license", F.sort_array(F.array_distinct(shingles(plain_words(F.col("template")), shingle))).alias("set")).where(F.size("set") > 0).collect()
    classes: dict[int, list] = {}
    for r in rows:
        hashes, q = r["set"], size_class(len(r["set"]))
        shift = 64 - bits(q)
        sign = [h for i, h in enumerate(hashes) if i == 0 or h >> shift != hashes[i - 1] >> shift]
        classes.setdefault(q, []).append((r["license"], -(-len(hashes) * round(share * 1000) // 1000), sign, hashes))
    return sorted(classes.items())


def scan(docs: DataFrame, forms: DataFrame, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """One row per (document, license) found: doc_id, license, n_shingles, n_shared, first_window.

    n_shared is the most distinct template shingles in one window, and
    first_window the first window, counted in the template's class, with at
    least ``share`` of them.  Templates under five words are one shingle and
    match texts of just those words.  Null and blank texts match nothing;
    repeated rows give one row; rows without a doc_id count as one document; no
    rows give none.  ``forms`` is a list that people write: it is collected
    and broadcast.
    """
    spark = docs.sparkSession
    index = _index(forms, shingle, share)
    if not index:
        return spark.createDataFrame([], "doc_id bigint, license string, n_shingles bigint, n_shared bigint, first_window bigint")
    bands = {q: sorted({h for _, _, sign, _ in found for h in sign}) for q, found in index}
    asked = sorted({h for hs in bands.values() for h in hs})

    def windows(hs: Column, hits: Column) -> Column:
        # a shingle at p lies in the windows p // q and p // q - 1 of class q
        def of_class(q: int) -> Column:
            near = F.transform(F.filter(hits, lambda x: x["h"].isin(*bands[q])), lambda x: F.array(F.floor(x["p"] / q), F.floor(x["p"] / q) - 1))
            numbers = F.filter(F.array_distinct(F.flatten(near)), lambda w: w >= 0)
            return F.transform(numbers, lambda w: F.struct(F.lit(q).alias("q"), w.alias("window"), F.slice(hs, (w * q + 1).cast("int"), 2 * q).alias("content")))

        return F.concat(*[of_class(q) for q in bands])

    hashed = docs.select("doc_id", shingles(plain_words(F.col("text")), shingle).alias("hs"))
    hits = F.filter(F.transform("hs", lambda h, p: F.struct(p.alias("p"), h.alias("h"))), lambda x: x["h"].isin(*asked))
    held = hashed.withColumn("hits", hits).where(F.size("hits") > 0)
    cut = held.select("doc_id", F.explode(windows(F.col("hs"), F.col("hits"))).alias("w")).select("doc_id", "w.*")
    signed = cut.withColumn("signature", signature(F.col("content"), F.col("q")))
    table = spark.createDataFrame(index, "q int, forms array<struct<license:string,need:int,signature:array<bigint>,set:array<bigint>>>")
    met = signed.join(F.broadcast(table), "q")
    retrieved = F.filter("forms", lambda f: F.arrays_overlap(f["signature"], F.col("signature")))
    verified = F.filter(
        F.transform(retrieved, lambda f: F.struct(f["license"].alias("license"), F.size(f["set"]).alias("n"), f["need"].alias("need"), F.size(F.array_intersect(f["set"], F.col("content"))).alias("shared"))),
        lambda f: f["shared"] >= f["need"],
    )
    return (
        met.select("doc_id", "window", F.explode(verified).alias("f"))
        .groupBy("doc_id", F.col("f.license").alias("license"), F.col("f.n").cast("bigint").alias("n_shingles"))
        .agg(F.max("f.shared").cast("bigint").alias("n_shared"), F.min("window").alias("first_window"))
    )
