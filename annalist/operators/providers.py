"""Model calls as data: prompt tables in, response tables out.

A provider is any function of a list of prompts to a list of texts (None for a
failure).  Answers are stored before they are read, since Spark may run a stage
again, and a model may then answer otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]


def echo(prompts: list[str]) -> list[str | None]:
    """The stub of the tests: a fixed function of the prompt."""
    return [f"answer:{len(p)}" if p.strip() else None for p in prompts]


def complete(prompts: DataFrame, provider: Provider, key: str, tries: int = 3, accept: Callable[[str], bool] = lambda _: True, fallback: str | None = None) -> DataFrame:
    """``(key, prompt)`` to ``(key, text)``; an answer that isn't accepted is asked for again, and at last replaced by ``fallback``.

    A provider that raises has answered none of its prompts; they are asked for
    one by one, so that one bad prompt doesn't cost the others their answers.
    """

    def ask_all(prompts: list[str]) -> list[str | None]:
        try:
            return provider(prompts)
        except Exception:
            if len(prompts) == 1:
                return [None]
            return [ask_all([p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ask, texts = batch["prompt"].fillna("").tolist(), [None] * len(batch)
            left = list(range(len(batch)))
            for _ in range(tries):
                if not left:
                    break
                for i, text in zip(left, ask_all([ask[i] for i in left])):
                    if text is not None and accept(text):
                        texts[i] = text
                left = [i for i in left if texts[i] is None]
            yield pd.DataFrame({key: batch[key], "text": [fallback if x is None else x for x in texts]})

    return prompts.select(F.col(key).cast("string").alias(key), "prompt").mapInPandas(run, f"`{key}` string, text string")


def rolling_answers(batches: DataFrame, provider: Provider, key: str, template: str) -> DataFrame:
    """Carry an answer from batch to batch of a key: ``(key, batch, text)`` to ``(key, batch, answer)``; a failure ends the key.

    A key's batches stream through one task in order; only the last answer is
    held.  Null texts are empty, rows without a key are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, answer = None, None
        for rows in frames:
            out = []
            for k, batch, text in zip(rows[key], rows["batch"], rows["text"]):
                if k != now:
                    now, answer = k, ""
                if answer is None:
                    continue
                answer = provider([template.format(answer=answer, text=text)])[0]
                if answer is not None:
                    out.append((k, batch, answer))
            yield pd.DataFrame(out, columns=[key, "batch", "answer"])

    rows = batches.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.col("batch").cast("bigint").alias("batch"), F.coalesce("text", F.lit("")).alias("text"))
    # equal batch numbers go by their text, so that a rerun gives the same answers
    return rows.repartition(key).sortWithinPartitions(key, "batch", "text").mapInPandas(run, f"`{key}` string, batch bigint, answer string")


def turns(subjects: DataFrame, provider: Provider, key: str, n: int = 5, save: Callable[[DataFrame, int], DataFrame] = lambda df, _: df) -> DataFrame:
    """Turn-synchronous dialogue: every pass asks all subjects once; ``save`` stores a pass and reads it again."""
    state = subjects.select(F.col(key).cast("string").alias(key), "prompt", F.array().cast("array<struct<role:string,text:string>>").alias("history"))
    for i in range(n):
        asked = state.select(key, F.concat_ws("\n", "prompt", F.array_join(F.transform("history", lambda h: h["text"]), "\n")).alias("prompt"))
        said = complete(asked, provider, key)
        grown = F.concat("history", F.array(F.struct(F.lit("assistant").alias("role"), F.col("text"))))
        state = save(state.join(said, key).select(key, "prompt", F.when(F.col("text").isNull(), F.col("history")).otherwise(grown).alias("history")), i)
    return state


def failing(prompts: list[str]) -> list[str | None]:
    """A stub that raises if any prompt says so."""
    if any(p == "raise" for p in prompts):
        raise RuntimeError("a bad prompt")
    return echo(prompts)


class moody:
    """A stub that answers a prompt that is a number n > 0 at the n-th time of asking, and never for 0."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out = []
        for p in prompts:
            self.asked[p] = self.asked.get(p, 0) + 1
            out.append(f"try {p}" if int(p) > 0 else None)
        return out


def juror(j: int) -> Provider:
    """A stub that says yes unless the prompt's number plus its own is a multiple of three."""
    return lambda prompts: [f'{{"entailed": {"true" if (int(p) + j) % 3 else "false"}}}' for p in prompts]


def rubric(prompts: list[str]) -> list[str | None]:
    """A stub that writes three criteria, or something that isn't JSON."""
    import json

    return [json.dumps({"criteria": [{"id": i, "points": (int(p) + i) % 9 - 4} for i in range(3)]}) if int(p) % 6 else "sorry" for p in prompts]


def repeats(key: str) -> Callable[[DataFrame], DataFrame]:
    """A stub judge: within a group, a fact equal to an earlier one is redundant."""

    def judge(groups: DataFrame) -> DataFrame:
        first = groups.groupBy(key, "group", "fact").agg(F.min("fact_idx").alias("first"))
        return groups.join(first, [key, "group", "fact"]).where("fact_idx > first").select(key, "fact_idx")

    return judge


def hashed(texts: list[str], dims: int = 8) -> list[list[float]]:
    """The stub encoder: the first value is the number of the text's first six hex digits, the others follow from its hash."""
    import hashlib

    out = []
    for t in texts:
        h = hashlib.md5(t.encode()).hexdigest()
        out.append([float(int(h[:6], 16)), *[float(int(h[i], 16) - 7.5) for i in range(6, 5 + dims)]])
    return out


def encode(rows: DataFrame, keys: list[str], encoder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """``(keys, text)`` to ``(keys, vec)``, in batches of the encoder."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame["text"].fillna("").tolist()
            vecs = [v for at in range(0, len(texts), batch) for v in encoder(texts[at : at + batch])]
            yield frame[keys].assign(vec=vecs)

    return rows.select(*keys, "text").mapInPandas(run, f"{kinds}, vec array<double>")


def answer_jobs(jobs: DataFrame, path: str, fails) -> None:
    """The stub of a batch service: one shard folder a job, with a result or an error for each key."""
    text = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("answer:"), "key").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = F.when(fails, F.to_json(F.struct("key", F.lit("quota").alias("status")))).otherwise(F.to_json(F.struct("key", text.alias("response"))))
    jobs.select(line.alias("value")).write.text(path)


def token_match(rows: DataFrame, keys: list[str], encoder: Callable[[list[str]], list[list[float]]] = hashed) -> DataFrame:
    """Precision, recall and F1 of greedy matching: each token takes its best cosine on the other side."""
    import numpy as np

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def unit(words: list[str]) -> np.ndarray:
        v = np.array(encoder(words))[:, 1:]
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for c, r in zip(frame["c"].fillna(""), frame["r"].fillna("")):
                a, b = c.split(), r.split()
                if not a or not b:
                    out.append((0.0, 0.0, 0.0))
                    continue
                s = unit(a) @ unit(b).T
                p, q = float(s.max(axis=1).mean()), float(s.max(axis=0).mean())
                out.append((p, q, 2 * p * q / (p + q) if p + q else 0.0))
            yield frame[keys].assign(**{n: [round(x[i], 6) for x in out] for i, n in enumerate(("precision", "recall", "f1"))})

    return rows.mapInPandas(run, f"{kinds}, precision double, recall double, f1 double")
