"""Counts of model tokens by byte-pair vocabularies.

A vocabulary file is read once in each Python worker and kept there; texts cross
to it in Arrow batches.  The file must lie where every worker can read it.
"""

from __future__ import annotations

import base64
import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts from here on are encoded in pieces, cut where the pattern always cuts.
LONG = 100_000
#: The pieces that byte-level vocabularies are merged within, and the characters they take as white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a named vocabulary lies on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _whole(text: str) -> str:
    """Lone surrogates, which no vocabulary has, as replacement characters."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def count(text: str, path: str) -> int:
    """How many tokens a text is; the empty text is none."""
    encoder = _encoder(path)
    if len(text) < LONG:
        return len(encoder.encode_ordinary(_whole(text)))
    # the pattern looks ahead through a run of white space, and takes all of it but the last before a word as one piece
    total, at = 0, 0
    for m in re.finditer(BLANKS, text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += _plain(encoder, text[at : m.start()]) + len(encoder._core_bpe.encode_single_piece(text[m.start() : end].encode()))
        at = end
    return total + _plain(encoder, text[at:])


def _plain(encoder, text: str) -> int:
    """Tokens of a text, in pieces cut between a letter and the single blank or line feed before another letter, where the pattern always cuts."""
    total, at = 0, 0
    for m in re.finditer(r"(?<=[^\W\d_])(?=[ \n][^\W\d_])", text):
        if m.start() - at >= LONG // 2:
            total += len(encoder.encode_ordinary(_whole(text[at : m.start()])))
            at = m.start()
    return total + len(encoder.encode_ordinary(_whole(text[at:])))


def model_tokens(text: Column, path: str | None = None) -> Column:
    """The number of tokens of a text in a vocabulary; null texts have none."""
    where = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t, where) for t in texts], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))
