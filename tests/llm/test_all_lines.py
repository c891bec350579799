"""The pipeline's line stage against brute force."""

import random

import pytest

pytest.importorskip("annalist.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stage_cuts_later_equal_lines(spark):
    """Every line here is posted more than once or stands once, so of equal lines only the first stays."""
    r = random.Random(12)
    pool = ["ok", "share this", "all rights reserved here", " ".join("abcdefghi"), " ".join("abcdefghijklmn")]
    texts = [None, "", "\n \n", "nine words in a one line document as whole", "nine words in a one line document as whole"]
    texts += ["\n".join([f"head {i}", r.choice(pool), f"middle {i}", r.choice([*pool, " "]), f"end  {i}"]) for i in range(40)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        kept, full = [], 0
        for line in (t or "").split("\n"):
            key = " ".join(line.split())
            full += bool(key)
            if key not in seen:
                kept.append(line)
            if key:
                seen.add(key)
        if not full or any(x.strip() for x in kept):
            want[i] = None if t is None else "\n".join(kept)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t or "") for t, n in got.values()) and 4 not in got
