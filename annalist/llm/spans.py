"""Operator 2: substring dedup by sliding sentence spans.

A text is cut into pieces, each a sentence or line with the white space after
it.  Every run of ``span`` consecutive sentences with at least ``min_words``
words is hashed, and so is each single sentence of ``long_words`` words, which
is a passage by itself.  Spans meet globally by hash, and the sentences covered
by any span but the first in (doc_id, sentence) order go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, key128, kept_pieces, later_copies, let, stored

#: A piece ends behind a full stop, ! or ? with white space, or behind a line feed and the white space that follows.
END = r"([.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*)"
MARK = "\x01\x02"
SPAN, MIN_WORDS, LONG_WORDS = 3, 20, 20


def pieces(text: Column) -> Column:
    """The pieces of a text in order; the last may be empty.  The pair of control characters U+0001 U+0002 ends a piece too."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), END, "$1" + MARK), MARK, -1)


def _norm(piece: Column) -> Column:
    return F.trim(F.regexp_replace(piece, SPACE, " "))


def _n_words(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def postings(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``(doc_id, first, length, key_a, key_b)`` of all spans; first counts sentences with a word from 0."""
    # all of a text's spans are built inside one expression, so that an exploded row never carries the text's sentences
    def all_spans(s: Column, w: Column, m: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            total = F.aggregate(F.slice(w, i + 1, span), F.lit(0), lambda a, n: a + n)
            # a text of fewer sentences is one run
            run = F.when(((m >= i + span) | ((i == 0) & (m > 1))) & (total >= min_words), F.least(m, F.lit(span)))
            single = F.when(F.get(w, i) >= long_words, F.lit(1))

            def one(n: Column) -> Column:
                content = F.concat_ws(" ", F.slice(s, i + 1, n))
                return F.when(n.isNotNull(), let(content, lambda c: F.struct(i.alias("first"), n.alias("length"), *key128(c, n))))

            return F.array(one(run), one(single))

        return F.filter(F.flatten(F.transform(s, at)), lambda x: x.isNotNull())

    sentences = F.filter(F.transform(pieces(F.col("text")), _norm), lambda x: x != "")
    found = let(sentences, lambda s: let(F.transform(s, _n_words), lambda w: let(F.size(s), lambda m: all_spans(s, w, m))))
    return docs.select("doc_id", found.alias("f")).select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*")


def dedup_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_sentences``, ``n_removed``.

    Sentences compare by their words; those without a word are never matched
    and stay.  A text of fewer than ``span`` sentences is one span; a text
    without sentence marks and line feeds is one sentence, and never cut
    inside.  Null texts stay null.  Rows that repeat a doc_id count as one
    document and get the same cuts; rows without a doc_id are never cut.  No
    rows give none; other columns stay, whatever their names (n_sentences and
    n_removed are replaced).
    """
    later = later_copies(stored(postings(docs, span, min_words, long_words)), ["doc_id", "first"])
    gone, parts, full = fresh(docs.columns, "gone", "pieces", "full")
    cuts = later.select("doc_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("at")).groupBy("doc_id").agg(F.collect_set("at").alias(gone))
    joined = docs.join(cuts, "doc_id", "left").withColumn(parts, pieces(F.col("text")))
    places = F.filter(F.transform(parts, lambda s, i: F.when(s.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat_ws("", kept_pieces(F.col(parts), F.col(full), F.col(gone))))
    out = [F.col(c) for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    return joined.withColumn(full, places).select(
        *out, text.alias("text"), F.size(full).cast("bigint").alias("n_sentences"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_removed")
    )
