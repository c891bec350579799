"""Packing's ids on texts that hold an added token, against the tokenizers library at its defaults."""

import json
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import packing, queries  # noqa: E402


def test_query_has_the_ids_of_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> \n y", "<|endoftext|", "plain  text 's 12a", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    got = {r["doc_id"]: r for r in queries.op6_packing(spark, str(tmp_path)).collect()}
    assert {i: (r["doc_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    # and the split is that of the library on long texts too
    encode = packing.load_encoder(queries.tokenizer_path(), special=True)
    assert encode("word <|endoftext|>" * 500) == t.encode("word <|endoftext|>" * 500, add_special_tokens=False).ids


@pytest.mark.parametrize("change", ["split", "normalizer", "prefix", "order", "unmerged"])
def test_another_kind_of_file_is_refused(tmp_path, change):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f)
    packing._check_kind(file)
    model = file["model"]
    if change == "split":
        file["pre_tokenizer"] = {"type": "Whitespace"}
    elif change == "normalizer":
        file["normalizer"] = {"type": "Lowercase"}
    elif change == "prefix":
        file["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "order":
        model["merges"][5], model["merges"][900] = model["merges"][900], model["merges"][5]
    else:
        del model["merges"][-9:]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    with pytest.raises(ValueError):
        packing.load_encoder(str(path), special=True)


def test_cuts_at_blanks_change_no_id():
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(queries.tokenizer_path()), random.Random(3)
    cut, plain = (packing.load_encoder(queries.tokenizer_path(), special=True, deep=deep) for deep in (0, 10**9))
    parts = [" ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", "　", "'s", "<|endoftext|>", "12", "Ⅷ", "\xe9", "é", "_", "\x00", "\U0001f600", "ab", "Z!"]
    for _ in range(3000):
        text = "".join(r.choice(parts[:6] if r.random() < 0.5 else parts) * (r.randrange(90, 120) if r.random() < 0.2 else 1) for _ in range(r.randrange(1, 12)))
        assert cut(text) == plain(text) == t.encode(text, add_special_tokens=False).ids


def test_runs_of_a_million_blanks():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(queries.tokenizer_path()), packing.load_encoder(queries.tokenizer_path(), special=True)
    ordinary = packing.load_encoder(queries.tokenizer_path())
    for blank in (" ", "\n", "　"):
        for end in ("", "x", "<|endoftext|> y"):
            text = "a b" + blank * 1_200_000 + end
            assert encode(text) == t.encode(text, add_special_tokens=False).ids and len(ordinary(text)) > 1000
    for long in ("a", "7", "^", "日", "ab 1\n"):
        assert len(encode(long * 1_200_000)) > 1000
