"""Stems by their published examples; ROUGE over stems; pictures of agreement."""

import pytest

from annalist.functions import stem as ST
from annalist.functions import text as T
from annalist.operators import retrieval as R
from annalist.sources import readers, sinks
from pyspark.sql import functions as F

#: Examples of each step and of later rules.
EXAMPLES = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky enjoy enjoy
relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
dies die died die spied spi dying die news news proceed proceed generalizations gener oscillators oscil by by""".split()


@pytest.mark.parametrize("word,want", list(zip(EXAMPLES[::2], EXAMPLES[1::2])))
def test_examples(word, want):
    assert ST.stem(word) == want


def test_rouge_over_stems(spark):
    df = spark.createDataFrame([("The patients were treated.", "the patient was treated"), (None, "x"), ("", "")], "c string, r string")
    df = df.select(ST.rouge_words(F.col("c")).alias("c"), ST.rouge_words(F.col("r")).alias("r"))
    assert df.first()["c"] == ["the", "patient", "were", "treat"]
    got = [tuple(round(v, 6) for v in x) for x in df.select(T.rouge_n(F.col("c"), F.col("r"), 1), T.rouge_n(F.col("c"), F.col("r"), 2), T.rouge_l(F.col("c"), F.col("r"))).collect()]
    assert got == [(0.75, 0.333333, 0.75), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_heatmap_round_trip(spark, tmp_path):
    rows = [("a", "b", 10), ("b", "a", 10), ("a", "ü", 0), ("ü", "a", 0), ("b", "ü", None)]
    path = f"file://{tmp_path}/m.png"
    sinks.heatmap(spark.createDataFrame(rows, "rater_a string, rater_b string, shade int"), path)
    assert sorted(map(tuple, readers.heatmap(spark, path).collect())) == sorted(r for r in rows if r[2] is not None)
    many = spark.range(sinks.MOST + 1).select(F.col("id").cast("string").alias("rater_a"), F.lit("0").alias("rater_b"), F.lit(1).alias("shade"))
    with pytest.raises(ValueError):
        sinks.heatmap(many, path)


def test_rerank(spark):
    rows = [("q", 1, "red fox", "a fox"), ("q", 2, "red fox", "Red FOX!"), ("q", 3, "red fox", None), ("p", 1, None, "x")]
    df = spark.createDataFrame(rows, "question_id string, note_idx bigint, natural_query string, text string")
    assert sorted(map(tuple, R.rerank(df, R.word_share, 2).collect())) == [("p", 1, 0.0, 1), ("q", 1, 0.5, 2), ("q", 2, 1.0, 1)]
