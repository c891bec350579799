"""Operator 12: spelling variants by merging subtrees of a one-errata trie.

The words form a trie.  At each node the child with most words is heavy, the
others are light; a word that ends at the node is a light child by itself.  A
word lies in at most log2(words) light children, one for every light edge on its
path, so merging only light subtrees (small into large) makes few rows.

Two words one edit apart part at exactly one node, P.  With x the light
character there, s what follows it and h the heavy character, the word P x s is
merged into the trie
  with x replaced by h         at P h s,
  with x skipped               at P s,
  with h put in front of it    at P h x s (a word that ends at P: at P h),
and with the other light subtrees of P at P ? s, x being any character.  Where
terminals coincide the words are near.  Every near pair is found once: two
light children meet by the wildcard or by the skip of the longer word, a light
and the heavy one by one of the other merges.

Nodes are named by a rolling hash of their prefix, in linear time however long
a word is.  Two prefixes that share a hash only share the choice of a heavy
character, which costs nothing but work; terminals are compared as strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, small_batches, stored

#: A word is a maximal run of these characters.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST, TIMES, NOISE, RATIO = 5, 3, 97, 2
#: Words and characters of a partial count, and rows of a frame.
HELD, HELD_CHARS, ROWS = 200_000, 20_000_000, 50_000
END = -1


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def vocabulary(docs: DataFrame, least: int = LEAST, times: int = TIMES, noise: int | None = NOISE) -> DataFrame:
    """``docs(doc_id, text)`` to ``(word, n)``: words of ``least`` characters or more found ``times`` times or more in all texts.

    A word is a run of LETTERS with A-Z in lower case.  Where ``noise`` divides
    h, the crc32 of ``<doc_id>:<word>``, the character at h % length is deleted
    first (a stand-in for typing errors); rows without a doc_id have none.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, held, chars = re.compile(LETTERS).findall, Counter(), 0

        def ready() -> pd.DataFrame:
            return pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    continue
                base = zlib.crc32(f"{int(doc)}:".encode()) if noise and not pd.isna(doc) else None
                for word, n in Counter(find(lower_ascii(text))).items():
                    if len(word) < least:
                        continue
                    if base is not None and (h := zlib.crc32(word.encode(), base)) % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    if word not in held:
                        chars += len(word)
                    held[word] += n
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield ready()
                    held, chars = Counter(), 0
        if held:
            yield ready()

    found = docs.select("doc_id", "text").mapInPandas(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class Roller:
    """64-bit hashes of all prefixes of a word, the empty one included, from two sums modulo primes below 2**31."""

    PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 999_331)

    def __init__(self) -> None:
        self.powers = [np.ones(1, np.int64) for _ in self.PRIMES]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes) + 1, np.int64)
        for i, (p, b) in enumerate(zip(self.PRIMES, self.BASES)):
            while len(self.powers[i]) < len(codes):
                known = self.powers[i]
                self.powers[i] = np.concatenate([known, known * pow(b, len(known), p) % p])
            sums = np.cumsum((codes + 1) * self.powers[i][: len(codes)] % p) % p
            out[1:] = (out[1:] << 31) + sums
        return out


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _framed(words: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of words with, for every prefix of each, the word's place in the block, the prefix's node and the character that follows."""
    roll = Roller()
    for batch in words:
        block, nodes, follow, size = [], [], [], 0
        for word in batch["word"]:
            codes = _codes(word)
            block.append(word)
            nodes.append(roll(codes))
            follow.append(np.append(codes, END))
            size += len(codes) + 1
            if size >= ROWS:
                yield block, np.repeat(np.arange(len(block)), [len(x) for x in nodes]), np.concatenate(nodes), np.concatenate(follow)
                block, nodes, follow, size = [], [], [], 0
        if block:
            yield block, np.repeat(np.arange(len(block)), [len(x) for x in nodes]), np.concatenate(nodes), np.concatenate(follow)


def branches(words: DataFrame) -> DataFrame:
    """``(node, heavy, n)`` of the nodes of the trie with more than one child; n is the number of words below, heavy the child with most of them."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, node, follow in _framed(batches):
            frame = pd.DataFrame({"node": node, "follow": follow.astype(np.int32)})
            yield frame.groupby(["node", "follow"], sort=False).size().reset_index(name="n")

    children = words.select("word").mapInPandas(edges, "node bigint, follow int, n bigint").groupBy("node", "follow").agg(F.sum("n").alias("n"))
    # the end of a word is never the heavy child, so that the heavy one has a character
    heavy = F.max_by("follow", F.struct(F.col("follow") != END, "n", "follow"))
    return children.groupBy("node").agg(heavy.alias("heavy"), F.sum("n").alias("n"), F.count("*").alias("children")).where("children > 1").drop("children")


def light_edges(words: DataFrame, split: DataFrame) -> DataFrame:
    """``(id_a, id_b, at, heavy)``: the light edges on each word's path, by the word's two hashes, with the node's depth and heavy character."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = dict(zip(batch["word"], zip(batch["id_a"], batch["id_b"])))
            for block, owner, node, follow in _framed(iter([batch])):
                lengths = np.bincount(owner, minlength=len(block))
                at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                own = np.array([ids[w] for w in block], np.int64)[owner]
                yield pd.DataFrame({"node": node, "follow": follow.astype(np.int32), "at": at.astype(np.int32), "id_a": own[:, 0], "id_b": own[:, 1]})

    rows = stored(words.select("word", "id_a", "id_b").mapInPandas(paths, "node bigint, follow int, at int, id_a bigint, id_b bigint"))
    return hot_join(rows, split, ["node"]).where("follow <> heavy").select("id_a", "id_b", "at", "heavy")


def _pieces(word: Column, at: Column, heavy: Column) -> tuple[Column, Column, Column, Column, Column]:
    """P, x, s, h and whether the word ends at P."""
    return F.substring(word, F.lit(1), at), F.substring(word, at + 1, F.lit(1)), F.substring(word, at + 2, F.length(word)), F.chr(heavy), F.length(word) == at


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, n)`` to ``(word, n_near, best)`` for words with a near one; best is the struct (minus n, word) of the near word that comes first.

    Words with a wildcard in common are counted, not paired: a group holds one
    word a character at most, and each gets the group's first two.
    """
    named = stored(words.select("word", "n", F.xxhash64("word").alias("id_a"), F.xxhash64(F.lit(12), "word").alias("id_b")))
    light = light_edges(named, cut(branches(named)))
    merged = stored(light.join(named, ["id_a", "id_b"]).select("word", "n", "at", "heavy"))
    before, x, after, h, ends = _pieces(F.col("word"), F.col("at"), F.col("heavy"))
    replaced = F.when(~ends, F.concat(before, h, after))
    # a skipped character that the next one repeats parts the two words further down
    skipped = F.when(~ends & (F.substring(after, 1, 1) != x), F.concat(before, after))
    longer = F.concat(before, h, F.when(ends, F.lit("")).otherwise(F.concat(x, after)))
    asked = merged.select(F.explode(F.array(replaced, skipped, longer)).alias("to"), "word", "n").where("`to` is not null")
    pairs = asked.join(named.select(F.col("word").alias("to"), F.col("n").alias("to_n")), "to")
    best = lambda n, w: F.struct((-F.col(n)).alias("less"), F.col(w).alias("word"))
    both = F.array(F.struct("word", F.lit(1).alias("k"), best("to_n", "to").alias("best")), F.struct(F.col("to").alias("word"), F.lit(1).alias("k"), best("n", "word").alias("best")))
    wild = merged.where(~ends).select(before.alias("before"), after.alias("after"), "word", "n")
    same = wild.groupBy("before", "after").agg(F.array_sort(F.collect_list(best("n", "word"))).alias("all")).where(F.size("all") > 1)
    third = same.select(F.explode("all").alias("own"), (F.size("all") - 1).alias("k"), F.col("all")[0].alias("a"), F.col("all")[1].alias("b")).select(F.col("own.word").alias("word"), "k", F.when(F.col("own") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("best"))
    return pairs.select(F.inline(both)).unionByName(third).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _followed(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` to ``(word, root)``, the last word along the forms, by pointer doubling; counts grow along them, so there is no circle."""
    current = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        used = current.groupBy("root").agg(F.count("*").alias("n"))
        ahead = cut(current.select(F.col("word").alias("at"), F.col("root").alias("next")).join(used.withColumnRenamed("root", "at"), "at").select(F.col("at").alias("root"), "next", "n"))
        if not ahead.take(1):
            return current
        current = cut(hot_join(current, ahead, ["root"], "left").select("word", F.coalesce("next", "root").alias("root")))


def group_variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, noise: int | None = NOISE, ratio: int = RATIO) -> DataFrame:
    """``docs(doc_id, text)`` to ``(word, form, root, n, n_near, form_n)``, one row a word of ``vocabulary``.

    n_near counts the words one inserted, deleted or replaced character away.
    form is the one of largest n among them (ties: the first in code-point
    order) if its n is ``ratio`` times the word's or more, else null; root
    follows forms to the last, and is the word itself without a form.  Null and
    empty texts have no words, repeated rows count as often as they stand, very
    long words are words like others.  No rows give none; other columns,
    whatever their names, are ignored.
    """
    words = stored(vocabulary(docs, least, times, noise))
    near = stored(words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.word").alias("first"), (-F.col("best.less")).alias("first_n")))
    fits = F.col("first_n") >= F.col("n") * ratio
    formed = near.select("word", "n", "n_near", F.when(fits, F.col("first")).alias("form"), F.when(fits, F.col("first_n")).alias("form_n"))
    roots = _followed(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
