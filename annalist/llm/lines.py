"""Operator 4: line dedup by winnowing over line hashes.

The lines of a document that hold a word form a sequence.  A window is the
shortest run of lines from one on that holds ``words`` words; it selects the
line with the least hash (the first of equals), whatever the lengths of its
lines.  A text without a whole window selects the least of all its lines.  Only
the selected fingerprints are posted, with the hashes of the lines beside them.
Positions of equal fingerprints are joined to the first one, matches are
extended both ways while the neighbours agree, and all later runs go.

Guarantees:

* of a run of lines with ``words`` words or more that stands earlier too, every
  later copy goes whole: the window at its start lies in both copies and selects
  the same line, and neighbours reach as far as two selected lines can lie apart;
* boilerplate: of a line of any length that stands in ``copies`` places or more,
  every later copy goes, also between lines that no other text has.  Winnowing
  alone can't promise that of a short line whose hash is seldom the least, so
  these lines are counted;
* a line's first copy in (doc_id, line) order stays: whatever goes has an equal
  line before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_IDS, SPACE, cut, fresh, hot_join, key128, kept_pieces, later_copies, let, stored

#: Words of a window, and copies from which a line is boilerplate.
WORDS, COPIES = 50, 8
#: Lines looked at first.
NEAR = 6


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE, " "))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _lines(text: Column) -> Column:
    """The words of each line that has any, joined by single blanks."""
    return F.filter(F.transform(_split(text), _norm), lambda x: x != "")


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _fitting(counts: Column, words: int, whole: bool) -> Column:
    """How many of the first lines hold ``words`` words (null if all hold fewer), or, unless ``whole``, how many hold fewer."""
    state = lambda total, n: F.struct(total.alias("total"), n.alias("n"))
    full = lambda a: a["total"] >= words
    if whole:
        return F.aggregate(counts, state(F.lit(0), F.lit(0)), lambda a, x: F.when(full(a), a).otherwise(state(a["total"] + x, a["n"] + 1)), lambda a: F.when(full(a), a["n"]))
    return F.aggregate(counts, state(F.lit(0), F.lit(0)), lambda a, x: state(a["total"] + x, F.when(a["total"] + x < words, a["n"] + 1).otherwise(a["n"])), lambda a: a["n"])


def _run(values: Column, first: Column, last: Column) -> Column:
    """The elements from one place to another, either way, in time linear in their number (a slice copies the whole array)."""
    return F.transform(F.sequence(first, last), lambda j: F.get(values, j))


def selected(hashes: Column, counts: Column, words: int) -> Column:
    """Places of the lines with the least hash of a window, in the order of their windows."""

    def least(start: Column, n: Column) -> Column:
        return let(_run(hashes, start, start + n - 1), lambda w: start + F.array_position(w, F.array_min(w)).cast("int") - 1)

    def window(i: Column) -> Column:
        within = lambda most: _fitting(_run(counts, i, F.least(i + most, F.size(counts)) - 1), words, True)
        # few lines do as a rule, and the second look is only taken where they don't
        return let(F.coalesce(within(min(NEAR, words)), within(words)), lambda n: F.when(n.isNotNull(), least(i, n)))

    each = F.transform(F.sequence(F.lit(0), F.size(counts) - 1), window)
    found = F.array_distinct(F.filter(each, lambda x: x.isNotNull()))
    picked = let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(least(F.lit(0), F.size(counts)))))
    return F.when(F.size(counts) > 0, picked).otherwise(F.array().cast("array<int>"))


def line_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, first, key_a, key_b, chosen, before, after)``: a row a line with a word, ``first`` its number from 0, and one more, chosen, a selected fingerprint.

    before and after are the hashes of the lines beside it, the nearest first,
    as many as hold fewer than ``words`` words.
    """

    # all of a text's rows are built inside one expression, so that an exploded row never carries the text's lines
    def rows(s: Column, counts: Column, chosen: Column) -> Column:
        none = F.array().cast("array<bigint>")

        def beside(first: Column, last: Column) -> Column:
            step = F.when(last < first, -1).otherwise(1)
            near = F.when(F.abs(last - first) < NEAR, last).otherwise(first + step * (NEAR - 1))
            few = _fitting(_run(counts, first, near), words, False)
            n = let(few, lambda k: F.when((k < NEAR) | (near == last), k).otherwise(_fitting(_run(counts, first, last), words, False)))
            return let(n, lambda k: F.when(k > 0, F.transform(_run(s, first, first + (k - 1) * step), lambda x: F.xxhash64(x))).otherwise(none))

        def fingerprint(i: Column) -> Column:
            before = F.when(i > 0, beside(i - 1, F.greatest(i - words + 1, F.lit(0)))).otherwise(none)
            after = F.when(i < F.size(s) - 1, beside(i + 1, F.least(i + words, F.size(s)) - 1)).otherwise(none)
            return row(i, F.get(s, i), F.lit(True), before, after)

        def row(i: Column, x: Column, is_chosen: Column, before: Column, after: Column) -> Column:
            return F.struct(i.alias("first"), *key128(x), is_chosen.alias("chosen"), before.alias("before"), after.alias("after"))

        null = F.lit(None).cast("array<bigint>")
        return F.concat(F.transform(s, lambda x, i: row(i, x, F.lit(False), null, null)), F.transform(chosen, fingerprint))

    chosen = lambda s, n: let(F.transform(s, lambda x: F.md5(x)), lambda h: selected(h, n, words))
    found = let(_lines(F.col("text")), lambda s: let(F.transform(s, _n_words), lambda n: let(chosen(s, n), lambda c: rows(s, n, c))))
    # a plain inline lets the optimizer ask for the size of the array first, which builds it twice
    return docs.select("doc_id", found.alias("f")).select("doc_id", F.inline_outer("f")).where("first is not null")


def postings(table: DataFrame) -> DataFrame:
    """The selected fingerprints of a ``line_table``."""
    return table.where("chosen").drop("chosen")


def _agreeing(own: Column, other: Column) -> Column:
    """How many of the first elements agree."""
    same = F.zip_with(own, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(F.array_append(same, F.lit(False)), False).cast("int") - 1


def repeated(posted: DataFrame) -> DataFrame:
    """``(doc_id, first, length)``: the later runs, each extended both ways along the first place of its fingerprint."""
    later = later_copies(posted, ["doc_id", "first"], ["before", "after"])
    left, right = _agreeing(F.col("before"), F.col("source.before")), _agreeing(F.col("after"), F.col("source.after"))
    return later.select("doc_id", (F.col("first") - left).alias("first"), (1 + left + right).alias("length"))


def boilerplate(table: DataFrame, copies: int = COPIES) -> DataFrame:
    """``(doc_id, first, length)`` of the later copies of lines that stand in ``copies`` places or more, counted over all lines of a ``line_table``."""
    keys = ["key_a", "key_b"]
    lines = table.where("not chosen").select("doc_id", "first", *keys)
    known = cut(lines.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= copies))
    held = lines.join(F.broadcast(known.select(*keys)), keys, "left_semi") if known.count() <= FEW_IDS else hot_join(lines, known, keys).select("doc_id", "first", *keys)
    return later_copies(stored(held), ["doc_id", "first"]).select("doc_id", "first", F.lit(1).alias("length"))


def dedup_lines(docs: DataFrame, words: int = WORDS, copies: int = COPIES) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines``, ``n_removed`` (lines with a word).

    Lines compare by their words.  Lines without a word are never matched and
    stay.  Null texts stay null, with 0 lines.  Rows that repeat a doc_id count
    as one document: all get the same deletions, and none removes the other.
    Rows without a doc_id are never cut.  Very long texts and texts of one very
    long line are handled whole.  No rows give none; other columns stay,
    whatever their names (n_lines and n_removed are replaced).
    """
    table = stored(line_table(docs, words))
    hits = repeated(postings(table)).unionByName(boilerplate(table, copies))
    gone, full = fresh(docs.columns, "gone", "full")
    cuts = hits.select("doc_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("at")).groupBy("doc_id").agg(F.collect_set("at").alias(gone))
    joined = docs.join(cuts, "doc_id", "left")
    lines = _split(F.col("text"))
    places = F.filter(F.transform(lines, lambda s, i: F.when(s.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept_pieces(lines, F.col(full), F.col(gone))))
    out = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.withColumn(full, places).select(*out, text.alias("text"), F.size(full).cast("bigint").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_removed"))
