"""Pseudonyms against a plain reading of what should and should not change, on hostile and random texts."""

import random
import time

import pytest

pytest.importorskip("annalist.llm")
from pyspark.sql import functions as F  # noqa: E402

from annalist.llm import pii  # noqa: E402


def rewritten(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


def test_hostile_texts_end_and_leak_nothing(spark):
    n = 240_000
    texts = [
        "a@" + "b." * (n // 2) + "c",
        "a" * n,
        "a" * 80 + "@mail.example.com",
        "x" * n + "@mail.example.com",
        "password" + " " * n,
        "token=" + "A1" * (n // 2),
        "1-" * (n // 2),
        "1 " * (n // 2),
        "1" * n,
        "1." * (n // 2),
        "+1 (" * (n // 4),
        "January " * (n // 8),
        "\"" * n,
    ]
    started = time.time()
    got = rewritten(spark, texts)
    assert time.time() - started < 120
    assert got[0].startswith("user") and "b.b" not in got[0]
    assert got[2].startswith("user") and got[3].startswith("user") and "aaaa" not in got[2] and "xxxx" not in got[3]
    assert len(got[5]) == len(texts[5]) and "A1A1" not in got[5]
    for i in (1, 4, 8, 10, 11, 12):
        assert got[i] == texts[i]


def luhn(body):
    d = [int(c) for c in reversed(body)]
    return str(-(sum(d[1::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::2])) % 10)


def test_planted_values_change_and_all_else_stays(spark):
    r = random.Random(21)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def value():
        kind = r.randrange(8)
        if kind == 0:
            body = "4" + digits(14)
            return body + luhn(body)
        if kind == 1:
            return f"{r.randint(1900, 2090)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
        if kind == 2:
            return f"+{r.choice([1, 44, 351])} ({r.randint(200, 999)}) {digits(3)}-{digits(4)}"
        if kind == 3:
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if kind == 4:
            return f"u{digits(3)}.x@m{digits(2)}.example.org"
        if kind == 5:
            return f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        if kind == 6:
            return "AKIA" + "".join(r.choice("ABCDEFGH1234") for _ in range(16))
        return f"secret: {digits(12)}"

    plain = ["word", "12", "000-00-0000", "666-12-3456", "1.2.3", "2024-13-01", "x@y", "été", "3,14", "a:b", "4041894974608796"]
    texts, made = [], []
    for _ in range(150):
        parts = [(value(), True) if r.random() < 0.4 else (r.choice(plain), False) for _ in range(r.randint(1, 12))]
        made.append(parts)
        texts.append(" | ".join(p for p, _ in parts))
    seen = {}
    for parts, g in zip(made, rewritten(spark, texts)):
        new = g.split(" | ")
        assert len(new) == len(parts)
        for (old, private), now in zip(parts, new):
            assert (now != old) == private, (old, now)
            assert seen.setdefault(old, now) == now
            if private and "@" not in old:
                assert len(now) == len(old) or old.count(".") == 3
            if old.startswith("+"):
                assert now.split(" ")[0] == old.split(" ")[0]
    values = [v for v in seen if v not in plain and not v.startswith("secret")]
    assert len({seen[v] for v in values}) == len(values)  # different values stay different


def test_social_security_numbers_are_permuted_within_the_valid_ones(spark):
    old = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in (1, 5000, 9999)]
    got = rewritten(spark, old)
    assert len(set(got)) == len(old)
    for x in got:
        a, g, s = map(int, x.split("-"))
        assert 1 <= a <= 899 and a != 666 and 1 <= g <= 99 and 1 <= s <= 9999
    perm = spark.range(0, 898 * 11).select(pii.permute(F.col("id"), 898, 11, "k", "t").alias("x"))
    assert perm.distinct().count() == 898 * 11
