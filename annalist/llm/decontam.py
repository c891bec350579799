"""Operator 8: benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so the Jaccard similarity of a leaked item
and its document is near zero and banded signatures of whole documents miss
it.  The small side is sketched instead: items are partitioned by size, and
each partition has an index of its own over the s smallest hashes of every
item's shingles, with s the least for which a document that holds the asked
share of the shingles must hold one of the s.  A document asks the partitions
whose items it is long enough to hold; candidates are verified by exact shingle
containment.

The items are a stated query set: they are cut into blocks of bounded size, and
each block meets all documents in one narrow pass that shuffles no text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SHINGLE, SHARE = 5, 0.8
#: Characters of the items in a block, which goes to every task.
BLOCK = 16_000_000
_WORD = re.compile(r"[^\W_]+")


def _runs(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k word numbers (a shorter text is one run); runs with an unknown word (0) are left out."""
    k = min(k, len(ids))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(ids) - k + 1
    h, known = np.full(n, k, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        known &= part > 0
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h[known]


def share_of(share: float, n: int) -> int:
    """The least whole number of at least this share (in thousandths) of n."""
    return -(-n * round(share * 1000) // 1000)


class Index:
    """The items of one block: word numbers, shingle sets, and the sketches of each size partition."""

    def __init__(self, items: dict[int, str | None], shingle: int, share: float):
        self.number: dict[str, int] = {}
        self.shingle, self.sets = shingle, {}
        partitions = defaultdict(lambda: defaultdict(list))
        for item, text in items.items():
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in _WORD.findall((text or "").lower())]
            runs = np.unique(_runs(np.array(ids, np.uint64), shingle))
            n = len(runs)
            if not n:
                continue
            top = 2 ** n.bit_length() - 1  # the largest size of the item's partition
            for h in runs[: min(n, top - share_of(share, top) + 1)]:  # what a document may miss, and one more
                partitions[n.bit_length()][int(h)].append(item)
            self.sets[item] = (runs, share_of(share, n))
        #: Size partitions: the least number of shingles that a match needs, the sketches' hashes in order, and whose they are.
        self.partitions = [(share_of(share, 2 ** (size - 1)), np.array(sorted(x), np.uint64), dict(x)) for size, x in sorted(partitions.items())]

    def found(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """The items that the text holds: item, its shingles, those shared."""
        get, words = self.number.get, _WORD.findall((text or "").lower())
        runs = np.unique(_runs(np.fromiter((get(w, 0) for w in words), np.uint64, len(words)), self.shingle))
        for least, keys, owners in self.partitions:
            if len(runs) < least:
                break
            met = runs[keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs]
            for item in sorted({i for h in met for i in owners[int(h)]}):
                own, need = self.sets[item]
                n = int(np.isin(own, runs, assume_unique=True).sum())
                if n >= need:
                    yield item, len(own), n


def indexes(items: DataFrame, shingle: int = SHINGLE, share: float = SHARE, block: int = BLOCK) -> Iterator:
    """Broadcast indexes of the items' blocks.  Of rows that repeat an item_id the least text counts."""
    small_batches(items.sparkSession)
    named = items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    n = 1 + (named.agg(F.sum(F.length("text"))).first()[0] or 0) // block
    for i in range(n):
        rows = named.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()  # one block
        yield items.sparkSession.sparkContext.broadcast(Index({r["item_id"]: r["text"] for r in rows}, shingle, share))


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """One row per (document, item) whose item has at least ``share`` of its distinct shingles in the document.

    Columns: doc_id, item_id, n_shingles, n_shared.  Words compare without case
    and punctuation.  Items or documents of fewer than five words are one
    shingle, the whole sequence.  Null and blank texts and null ids match
    nothing; repeated rows give one row; no rows on either side give none.
    """

    def search(index) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = index.value.found
            for batch in batches:
                out = [(doc, *x) for doc, text in zip(batch["doc_id"], batch["text"]) for x in found(text)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_shingles", "n_shared"], dtype="int64")

        return run

    asked, hits = docs.where("doc_id is not null").select("doc_id", "text"), None
    for index in indexes(items, shingle, share, block):
        part = asked.mapInPandas(search(index), "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint")
        hits = part if hits is None else hits.unionByName(part)
    return hits.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))


def clean(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the contaminated ones, in one narrow pass for each block; rows without a doc_id stay.

    Each row is judged by its own text, so of rows that repeat a doc_id only those that hold an item go.
    """
    for index in indexes(items, shingle, share, block):
        docs = docs.where(F.col("doc_id").isNull() | ~_holds(index)(F.col("text")))
    return docs


def _holds(index) -> Callable:
    def run(texts: pd.Series) -> pd.Series:
        found = index.value.found
        return pd.Series([next(found(t), None) is not None for t in texts], dtype=bool)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")
