"""Operator 6: packing along a Hilbert curve.

Token ids are counted into a small hashed vector, projected to three dimensions
and numbered along a Hilbert curve.  Documents are range-sorted by that number;
laid end to end along the curve and cut every ``length`` ids, they fill every
sequence but the last.  Neighbours on the curve share sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

LENGTH, END = 2048, 1
DIMS, BITS, HASHED, SEED = 3, 13, 64, 42
TIE = 20  # low bits of the sort key that spread documents at one point of the curve
#: Bytes of ids that a partition along the curve should hold, the most partitions, and bounds looked at for each.
PART_BYTES, MOST_PARTS, FINE = 32_000_000, 20_000, 8


#: Long runs of the characters with Unicode's White_Space property.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100,}")


def _check_kind(file: dict) -> None:
    """Whether splitting by the pattern of byte-level BPE and merging by least id is what the file says."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not file.get("normalizer")
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(o) for o in options):
        raise ValueError("only byte-level BPE without a normalizer or options is supported")
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][t] for t in merged]
    if any(a >= b for a, b in zip(ids, ids[1:])) or len(ids) + 256 + len(file.get("added_tokens", [])) < len(model["vocab"]):
        raise ValueError("the merges don't follow the order of the ids")


def load_encoder(path: str, special: bool = False, deep: int = 100_000):
    """tiktoken over the vocabulary of a byte-level BPE file of the tokenizers library: equal ids, four times as fast.

    A file that splits text in another way, or whose merges don't follow the order of its ids, raises ValueError.
    The file's added tokens in a text get their own ids if ``special``, as the library does by default; else they are ordinary text.
    Texts from ``deep`` characters on are cut at long runs of white space first, over which the pattern's look-ahead runs out of stack; the ids are the same.
    """
    import tiktoken

    # The rule of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    _check_kind(file)
    vocab, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    ranks = {bytes(code[c] for c in token): i for token, i in vocab.items() if all(c in code for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if special and any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file.get("added_tokens", [])):
        raise ValueError("only added tokens that match literally are supported")
    known = added if special else {}
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=known)
    blanks = tiktoken.Encoding("blanks", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})
    marks = re.compile("(" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + ")") if known else None

    def whole(text: str) -> list[int]:
        return encoding.encode(text, allowed_special="all") if special else encoding.encode_ordinary(text)

    def encode(text: str) -> list[int]:
        if len(text) < deep:
            return whole(text)
        out = []
        for part in marks.split(text) if marks else [text]:
            if part in known:
                out.append(known[part])
                continue
            at = 0
            for run in _BLANKS.finditer(part):
                # the last blank before a word belongs to the word
                end = run.end() - (run.end() < len(part))
                out += whole(part[at : run.start()]) + blanks.encode_ordinary(part[run.start() : end])
                at = end
            out += whole(part[at:])
        return out

    return encode


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points (rows of integers below 2**bits), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_place(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert number of each document's hashed, projected vector."""
    rng = np.random.RandomState(SEED)
    sign, plane = rng.choice([-1.0, 1.0], 1 << 16), rng.normal(size=(HASHED, DIMS))
    vectors = np.zeros((len(ids), HASHED))
    for k, x in enumerate(ids):
        vectors[k] = np.bincount((x.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % HASHED, sign[x & 0xFFFF], HASHED)
    at = (vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))) @ plane
    return hilbert(np.clip((np.tanh(at) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def tokenised(docs: DataFrame, path: str, end: int = END, special: bool = False) -> DataFrame:
    """``(doc_id, place, n, ids)``; ids is little-endian unsigned 32-bit and ends with ``end``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder(path, special)
        for batch in batches:
            ids = [np.array(array("I", encode(t or "") + [end]), dtype="<u4") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "place": curve_place(ids), "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, place bigint, n bigint, ids binary")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(held, at + step - 1) < key), at + step).otherwise(at))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, parts: int | None = None, special: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tokens (binary).

    Every document, null and empty texts too, is at least its end id.  Repeated
    rows and null ids are packed as rows of their own.  Only the last sequence
    may be short.  No documents give no rows.
    """
    small_batches(docs.sparkSession)
    tied = F.shiftleft(F.col("place"), TIE).bitwiseOR(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << TIE)))
    ids = stored(tokenised(docs, path, end, special).withColumn("key", tied))
    parts = parts or min(MOST_PARTS, 1 + 4 * (ids.agg(F.sum("n")).first()[0] or 0) // PART_BYTES)
    # fine bounds by number, then neighbours together up to the bytes of a part: long documents lie close on the curve
    fine = parts * FINE if parts > 1 else 1
    cuts = ids.select(F.percentile_approx("key", [i / fine for i in range(1, fine)] or [0.5], max(10_000, 4 * fine)).alias("q")).first()["q"] or []
    small = sorted({int(x) for x in cuts})
    sizes = {r["part"]: r["n"] for r in ids.select(_place(F.col("key"), small).alias("part"), "n").groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per bound
    mean = sum(sizes.values()) / parts
    bounds, start, base, held = [], [0], 0, 0
    for p in range(len(small) + 1):
        n = sizes.get(p, 0)
        if held and held + n > mean:
            bounds.append(small[p - 1])
            start.append(base)
            held = 0
        base, held = base + n, held + n
    part = _place(F.col("key"), bounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for p, doc, raw in zip(batch["part"], batch["doc_id"], batch["ids"]):
                if p != now:
                    now, at = p, start[p]
                n = len(raw) // 4
                done = 0
                while done < n:
                    take = min(n - done, length - at % length)
                    piece = raw[4 * done : 4 * (done + take)]
                    out.append((doc, done, take, zlib.crc32(piece), n, at // length, at % length, piece))
                    done, at = done + take, at + take
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    ordered = ids.select(part.alias("part"), "key", "doc_id", "ids").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "doc_id", F.crc32("ids"))
    return ordered.select("part", "doc_id", "ids").mapInPandas(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tokens binary"
    )
