"""The Porter stemmer with its author's later rules, for ROUGE."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import small_batches

#: Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes of steps 2 to 4; the first that fits counts.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """``v`` for a vowel and ``c`` for a consonant; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _kinds(stem)))


def _short_end(word: str) -> bool:
    k = _kinds(word)
    return k == "vc" or (k.endswith("cvc") and word[-1] not in "wxy")


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            s = w[: -len(end)]
            if "v" not in _kinds(s):
                return w  # only the first suffix that fits is tried
            if s.endswith(("at", "bl", "iz")):
                return s + "e"
            if len(s) > 1 and s[-1] == s[-2] and _kinds(s)[-1] == "c":
                return s if s[-1] in "lsz" else s[:-1]
            return s + "e" if _measure(s) == 1 and _short_end(s) else s
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-2])
    for end, new in STEP_2:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w[:-1] if w.endswith("logi") and _measure(w[:-3]) > 0 else w


def _third(w: str) -> str:
    for end, new in STEP_3:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w


def _fourth(w: str) -> str:
    for end in STEP_4:
        if w.endswith(end):
            s = w[: -len(end)]
            return s if _measure(s) > 1 and (end != "ion" or s[-1:] in ("s", "t")) else w
    return w


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _fourth(_third(_second(w)))
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.arrow_udf(ArrayType(StringType()))
def _stems(words: pa.Array) -> pa.Array:
    """Only a batch's different words become Python strings."""
    found = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) if len(w) > 3 else w for w in found.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), stems.take(found.indices), mask=words.is_null())


def rouge_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; those of more than three characters are stemmed.  No text gives none."""
    small_batches()
    return _stems(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0)))
