"""Agents over rows: every pass asks all open questions at once, and their tool calls are joins.

A question is a row of state: its last draft, the call it made, the recent steps,
and a summary into which older steps are folded.  No task holds a subject's
records: calls meet them by the joins of each tool.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof
from .agent import KEEP, STEPS
from .providers import Provider, complete

ANSWER = "draft string, stop string, tool struct<name:string,note_id:bigint,keywords:array<string>,note_ids:array<bigint>>"
STEP = "struct<call:string,draft:string>"


def compact(history: Column, summary: Column, keep: int = KEEP) -> tuple[Column, Column]:
    """The ``keep`` recent steps, and the summary with the drafts of the older ones folded in."""
    older = F.slice(history, 1, F.greatest(F.size(history) - keep, F.lit(0)))
    folded = F.filter(F.concat(F.array(summary), F.transform(older, lambda s: s["draft"])), lambda x: x != "")
    return F.when(F.size(history) > keep, F.slice(history, -keep, keep)).otherwise(history), F.array_join(folded, "; ")


def prompt(question: Column, summary: Column, history: Column, seen: Column) -> Column:
    steps = F.transform(history, lambda s: F.concat(s["call"], F.lit(" -> "), s["draft"]))
    return F.array_join(F.filter(F.concat(F.array(question, summary), steps, F.array(seen)), lambda x: x.isNotNull() & (x != "")), "\n")


def observe(calls: DataFrame, notes: DataFrame) -> DataFrame:
    """``calls(question_id, subject_id, cutoff, tool)`` to ``(question_id, seen)``: what each tool says of the notes visible at the cutoff.

    search lists the matches of any keyword by number, with a preview of 100
    characters; note gives a text; summary joins whole texts; meta counts.
    What can't be done is said as text too.
    """
    kind = F.col("tool.name")
    base = calls.select("question_id", "subject_id", "cutoff", "tool")
    held = notes.select("subject_id", "note_idx", "note_date", "note_title", "text")

    search = asof.as_of_rows(base.where(kind == "search"), held)
    hay = F.lower(F.concat_ws(" ", "note_title", "text"))
    found = search.where(F.exists("tool.keywords", lambda w: F.contains(hay, F.lower(w))))
    line = F.translate(F.concat(F.lit("["), F.col("note_idx"), F.lit("] "), F.col("note_title"), F.lit(" ("), F.col("note_date").cast("string"), F.lit(") "), F.substring("text", 1, 100)), "\n", " ")
    lists = found.groupBy("question_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("note_idx", line.alias("line")))).alias("lines"))
    listed = lists.select("question_id", F.concat_ws("\n", F.concat(F.col("n"), F.lit(" matched")), F.transform("lines", lambda x: x["line"])).alias("seen"))

    named = base.where(kind.isin("note", "summary")).select("question_id", "subject_id", "cutoff", F.posexplode(F.coalesce("tool.note_ids", F.array("tool.note_id"))).alias("place", "note_idx"))
    read = named.join(held, ["subject_id", "note_idx"]).where("note_date <= cutoff").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("texts"))
    texts = read.select("question_id", F.array_join(F.transform("texts", lambda x: x["text"]), " | ").alias("seen"))

    meta = asof.as_of_summary(base.where(kind == "meta"), held.select("subject_id", "note_idx", "note_date"))
    counted = meta.select("question_id", F.concat(F.col("n"), F.lit(" notes, "), F.coalesce(F.col("first_date").cast("string"), F.lit("?")), F.lit(" to "), F.coalesce(F.col("last_date").cast("string"), F.lit("?"))).alias("seen"))

    said = listed.unionByName(texts).unionByName(counted)
    nothing = F.when(kind == "search", "nothing matched").when(kind.isin("note", "summary"), "no such note is visible").otherwise(F.concat(F.lit("unknown tool: "), F.coalesce(kind, F.lit(""))))
    return base.join(said, "question_id", "left").select("question_id", F.coalesce("seen", nothing).alias("seen"))


def scripted(prompts: list[str]) -> list[str]:
    """The stub of the tests: search, read the first match, answer with the length of what was seen."""
    said = []
    for p in prompts:
        if "reading " in p or "nothing matched" in p:
            said.append({"draft": f"read {len(p)}", "stop": "True"})
        elif " matched\n[" in p:
            first = int(p.split(" matched\n[", 1)[1].split("]", 1)[0])
            said.append({"draft": f"reading {first}", "tool": {"name": "note", "note_id": first}})
        else:
            said.append({"draft": "searching", "tool": {"name": "search", "keywords": ["license", "token"]}})
    return [json.dumps(x) for x in said]


def run(questions: DataFrame, notes: DataFrame, provider: Provider, save: Callable[[DataFrame], DataFrame], steps: int = STEPS, keep: int = KEEP) -> DataFrame:
    """``questions(question_id, subject_id, cutoff, question)`` to ``(question_id, answer, n_steps, summary, history)``.

    The provider gets prompts and returns JSON of ANSWER.  A question ends when
    it says stop, names no tool, or has no answer that parses; the others go on
    in the next pass, up to ``steps``.  ``save`` stores a pass, so a question is
    asked once a turn and a lost executor costs a pass at most.
    """
    asked = questions.select("question_id", "subject_id", "cutoff", "question")
    state = save(asked.select("*", F.lit("").alias("answer"), F.lit("").alias("seen"), F.lit("").alias("call"), F.array().cast(f"array<{STEP}>").alias("history"), F.lit("").alias("summary"), F.lit(-1).cast("bigint").alias("n_steps")))
    ended = None
    for _ in range(steps + 1):
        asks = state.select("question_id", prompt(F.col("question"), F.col("summary"), F.col("history"), F.col("seen")).alias("prompt"))
        said = complete(asks, provider, "question_id").select("question_id", F.from_json("text", ANSWER).alias("a"))
        told = state.join(said, "question_id", "left").withColumns({"answer": F.coalesce("a.draft", "answer"), "n_steps": F.col("n_steps") + 1})
        history, summary = compact(F.concat("history", F.array(F.struct("call", F.coalesce("a.draft", F.lit("")).alias("draft")))), F.col("summary"), keep)
        stops = F.coalesce(F.lower("a.stop") == "true", F.lit(False)) | F.col("a.tool").isNull()
        now = save(told.withColumns({"new": history, "folded": summary}).select("question_id", "subject_id", "cutoff", "question", "answer", F.col("new").alias("history"), F.col("folded").alias("summary"), "n_steps", F.col("a.tool").alias("tool"), stops.alias("done")))
        last = now.where("done").select("question_id", "answer", "n_steps", "summary", "history")
        ended = last if ended is None else ended.unionByName(last)
        going = now.where("not done")
        if not going.take(1):
            return ended
        seen = observe(going.select("question_id", "subject_id", "cutoff", "tool"), notes)
        state = save(going.join(seen, "question_id").withColumn("call", F.to_json("tool")).select("question_id", "subject_id", "cutoff", "question", "answer", "seen", "call", "history", "summary", "n_steps"))
    return ended.unionByName(state.select("question_id", "answer", "n_steps", "summary", "history"))
