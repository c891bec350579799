"""Scalar functions: parsing of model output, chunking, spans, prompts and lexical metrics."""

from __future__ import annotations

import ast

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


def parse_list(s: Column) -> Column:
    """A serialised list of strings: JSON or a simple Python literal; anything else is empty."""
    return F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))


def lenient_json(s: Column) -> Column:
    """JSON as a variant: the whole text, else a fenced block, else the outermost braces."""
    fence = F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1)
    span = F.regexp_extract(s, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(s), F.try_parse_json(F.nullif(fence, F.lit(""))), F.try_parse_json(F.nullif(span, F.lit(""))))


def parse_winner(s: Column) -> Column:
    """A, B or TIE from a judgment; an unknown winner is a TIE, no judgment is null."""
    w = F.upper(F.trim(F.get_json_object(s, "$.winner")))
    return F.when(s.isNull(), None).when(w.isin("A", "B"), w).otherwise("TIE")


def normal_label(s: Column) -> Column:
    u = F.upper(F.trim(s))
    return F.when(u.isin("A", "B", "TIE"), u).when(u.isin("T", "TIED"), "TIE").otherwise("")


def trailing_date(s: Column) -> Column:
    return F.regexp_extract(s, r"\((\d{4}-\d{2}-\d{2})\)\s*$", 1)


def timestamp(s: Column) -> Column:
    """ISO 8601 to a timestamp, naive ones in UTC; anything else is null."""
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    return F.when(iso, F.try_to_timestamp(F.regexp_replace(s, r"Z$", "+00:00")))


def record_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def span_of(text: Column, part: Column) -> Column:
    """[start, end) of the first occurrence, or null; an empty part has no span."""
    at = F.position(part, text)
    return F.when((at > 0) & (F.length(part) > 0), F.array(at - 1, at - 1 + F.length(part)))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def fill(template: str, **values: Column) -> Column:
    """``{name}`` placeholders of a fixed template filled with columns."""
    import re

    parts = [F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)


def model_base(s: Column) -> Column:
    return F.regexp_replace(s, r"_(batch|sandbox)$", "")


def source_parts(s: Column) -> Column:
    """Provider and retrieval method of a source name."""
    pattern = r"^(.*)_(recent200|recent|dense|agent|bm25|late)$"
    return F.struct(F.regexp_extract(s, pattern, 1).alias("provider"), F.regexp_extract(s, pattern, 2).alias("method"))


def fixed_chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters without overlap; a short text is one piece."""
    n = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))


#: Texts that a worker holds as Python strings at once, and bytes of an Arrow batch.
FEW, BYTES = 64, 2 << 20
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _split_text(text: str, size: int, overlap: int) -> list[str]:
    """Pieces between the first separator that occurs, each with the separator behind it, packed greedily."""
    sep = next((x for x in SEPARATORS if x in text), None)
    if sep is None:
        cuts = (text[i : i + size].strip() for i in range(0, len(text), size - overlap))
        return [x for x in cuts if x]
    out, held, n = [], [], 0  # the open chunk as a list of parts, so that packing is linear
    for piece in text.split(sep):
        piece += sep
        if n + len(piece) > size:
            whole = "".join(held)
            if whole.strip():
                out.append(whole.strip())
            tail = whole[max(0, n - overlap) :]
            held, n = [tail], len(tail)
        held.append(piece)
        n += len(piece)
    last = "".join(held).strip()
    return [*out, last] if last else out


def small_batches() -> None:
    """Lower the session's Arrow batches to BYTES if they are larger, so that a worker's share doesn't grow with its rows."""
    spark = SparkSession.active()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("bB")) <= BYTES:
        spark.conf.set(name, str(BYTES))


def split_chunks(text: Column, size: int = 4000, overlap: int = 400) -> Column:
    """Greedy chunks at the first separator that occurs; a new chunk starts with the end of the last one.

    Every piece keeps a separator behind it, the last one too, and chunks are
    stripped of all white space at their ends.  Texts without a separator, and
    those that hold nothing else, are cut hard every ``size - overlap``
    characters.  Null texts have no chunk.
    """

    small_batches()

    @F.arrow_udf(ArrayType(StringType()))
    def chunks(texts: pa.Array) -> pa.Array:
        # a few texts at a time as Python strings, whatever the size of a batch
        parts = [pa.array([_split_text(t, size, overlap) for t in texts.slice(at, FEW).to_pylist()], pa.list_(pa.string())) for at in range(0, len(texts), FEW)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return chunks(F.coalesce(text, F.lit("")))


def ngrams(words: Column, n: int) -> Column:
    def runs(w: Column) -> Column:
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))

    return F.transform(F.array(words), runs)[0]  # bound once: the words must not be cut anew for every run


@F.pandas_udf(IntegerType())
def _shared_ngrams(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    from collections import Counter

    def grams(w, k: int) -> Counter:
        w = [] if w is None else list(w)
        return Counter(zip(*(w[i:] for i in range(k))))

    return pd.Series([(grams(x, k) & grams(y, k)).total() for x, y, k in zip(a, b, n)], dtype="int32")


def shared_ngrams(a: Column, b: Column, n: int) -> Column:
    """Size of the multiset intersection of the n-grams of two word arrays, linear in both."""
    return _shared_ngrams(a, b, F.lit(n))


def n_grams_of(words: Column, n: int) -> Column:
    return F.greatest(F.size(words) - (n - 1), F.lit(0))


def rouge_n(candidate: Column, reference: Column, n: int) -> Column:
    """F-measure of shared n-grams of two word arrays."""
    total = (n_grams_of(candidate, n) + n_grams_of(reference, n)).cast("double")
    return F.coalesce(F.try_divide(2.0 * shared_ngrams(candidate, reference, n), total), F.lit(0.0))


@F.arrow_udf(IntegerType())
def _common_subsequence(a: pa.Array, b: pa.Array) -> pa.Array:
    import numpy as np

    def places(lists: pa.Array) -> np.ndarray:
        return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))

    # words as numbers, so that none becomes a Python string
    numbers = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    of_a, of_b = places(a), places(b)
    of_b = of_b + of_a[-1]
    out = np.zeros(len(a), np.int32)
    for i in range(len(a)):
        u, v = numbers[of_a[i] : of_a[i + 1]], numbers[of_b[i] : of_b[i + 1]]
        row = np.zeros(len(v) + 1, np.int64)
        for w in u:  # a row at a time: memory stays linear
            up = np.where(v == w, row[:-1] + 1, row[1:])
            row[1:] = np.maximum.accumulate(np.maximum(up, row[1:]))
        out[i] = row[-1]
    return pa.array(out)


def rouge_l(candidate: Column, reference: Column) -> Column:
    """F-measure of the longest common subsequence of two word arrays."""
    return F.coalesce(F.try_divide(2.0 * _common_subsequence(candidate, reference), (F.size(candidate) + F.size(reference)).cast("double")), F.lit(0.0))


@F.pandas_udf(ArrayType(StringType()))
def _literal(s: pd.Series) -> pd.Series:
    def read(x):
        try:
            out = ast.literal_eval(x)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [str(v) for v in out] if isinstance(out, (list, tuple)) else None

    return s.map(read, na_action="ignore")


def parse_literals(s: Column) -> Column:
    """Like ``parse_list``, with any Python literal; only strings that aren't JSON are sent to Python."""
    json = F.from_json(s, "array<string>")
    return F.coalesce(json, _literal(F.when(json.isNull(), s)), F.array().cast("array<string>"))


def parse_atoms(s: Column) -> Column:
    """Atomic facts as structs: objects need a text and a source_idx, else null; plain strings have no source; [] is empty."""
    kind = "array<struct<text:string,source_idx:bigint>>"
    flat, pairs = F.from_json(s, "array<string>"), F.from_json(s, kind)
    plain = F.transform(flat, lambda x: F.struct(x.alias("text"), F.lit(None).cast("bigint").alias("source_idx")))
    whole = F.forall(pairs, lambda x: x["text"].isNotNull() & x["source_idx"].isNotNull())
    return F.when(F.forall(flat, lambda x: x.isNotNull() & ~x.startswith("{")), plain).when(whole, pairs)


def bleu(candidate: Column, reference: Column, n: int) -> Column:
    """Sentence BLEU of two word arrays up to ``n``-grams; an order without a match counts 0.1, no shared word is 0."""
    logs = []
    for k in range(1, n + 1):
        hits = F.greatest(shared_ngrams(candidate, reference, k).cast("double"), F.lit(0.1))
        logs.append(F.log(hits / F.greatest(n_grams_of(candidate, k), F.lit(1))))
    short = F.least(F.lit(0.0), 1 - F.size(reference) / F.size(candidate))
    score = F.exp(short + sum(logs[1:], logs[0]) / n)
    return F.when(F.arrays_overlap(candidate, reference), score).otherwise(0.0)


def stopped(said: Column) -> Column:
    """A stop flag given as a boolean or a string."""
    return F.coalesce(F.lower(F.trim(said.cast("string"))) == "true", F.lit(False))


def note_block(title: Column, day: Column, text: Column) -> Column:
    """A note as prompts show it."""
    shown = F.coalesce(day.cast("string"), F.lit(""))
    return F.concat(F.lit("Note Title: "), title, F.lit("\nNote Date: "), shown, F.lit("\nText: "), text, F.lit("\n"))


def token_count(text: Column) -> Column:
    """The offline token counter: words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("bigint")


def annotation_kind(record: Column) -> Column:
    """Fact or pairwise annotation, by the keys a record has."""
    keys = F.json_object_keys(record)
    facts = F.arrays_overlap(keys, F.lit(["recall_items", "precision_items"]))
    pair = F.arrays_overlap(keys, F.lit(["completeness", "relevancy", "concision"]))
    return F.when(facts, "fact").when(pair, "pairwise").otherwise("unknown")


def prompt_assets(text: str) -> dict[str, str]:
    """Prompt templates by name from a mapping in JSON; anything but a mapping of strings fails."""
    import json

    found = json.loads(text)
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()):
        raise ValueError("prompt assets must be a mapping of names to texts")
    return found
