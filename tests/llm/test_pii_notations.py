"""Valid private values beside other digits, in other notations and in any case."""

import pytest

pytest.importorskip("annalist.llm")
from annalist.llm import pii  # noqa: E402

CARD = "4041894974608795"


def rewritten(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


def test_cards_beside_other_digits(spark):
    texts = [CARD, f"card {CARD} 123", "card 4041-8949-7460-8795 12/27", f"order 12 {CARD}", f"{CARD} {CARD}", f"{CARD} 2024-02-29", f"12 70.123.182.155 {CARD}", "1 " * 30000, "7" * 30000]
    got = rewritten(spark, texts)
    new = got[0]
    assert new != CARD and new[0] == "4" and len(new) == 16
    assert got[1] == f"card {new} 123" and got[2].replace("-", "") == f"card {new} 12/27" and got[3] == f"order 12 {new}" and got[4] == f"{new} {new}"
    assert got[5].startswith(new + " ") and "2024-02-29" not in got[5] and got[6].endswith(" " + new) and "70.123.182.155" not in got[6]
    assert [len(t) for t in got[7:]] == [60000, 30000]


def test_secrets_in_any_case_and_quotes(spark):
    secret = "9233A8EC51b7db7aa4a5"
    texts = [f'TOKEN = "{secret}"', f"PASSWORD={secret}", f"Password: {secret}", f'{{"password": "{secret}"}}', f"api-key='{secret}'"]
    got = rewritten(spark, texts)
    assert not any(secret in t for t in got)
    heads = [t.split(secret)[0] for t in texts]
    assert all(g.startswith(h) and g.endswith(t.split(secret)[1]) and len(g) == len(t) for g, h, t in zip(got, heads, texts))


def test_dates_and_phones_in_other_notations(spark):
    dates = ["2024/02/29", "2024.02.29", "02/29/2024", "29/02/2024", "29.02.2024", "9.2.2024", "29 February 2024", "29 Feb 2024", "February 29, 2024", "Feb 29, 2024", "5 May 2024"]
    phones = ["555.123.4567", "555 123 4567", "(555)123-4567", "+1-555-123-4567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+4930123456"]
    stay = ["31/31/2024", "2024.13.40", "30 February 2024", "version 1.2.3"]
    got = rewritten(spark, [f"a {x} b" for x in dates + phones + stay])
    for x, g in zip(dates + phones, got):
        assert x not in g and g.startswith("a ") and g.endswith(" b")
    for x, g in zip(phones, got[len(dates) :]):
        assert [c for c in g if not c.isdigit()] == [c for c in f"a {x} b" if not c.isdigit()]
    assert got[len(dates + phones) :] == [f"a {x} b" for x in stay]
