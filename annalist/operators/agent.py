"""A tool-using agent over a subject's records, with a compacted history, and the text forms it exchanges."""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fill
from .lexical import top_k
from .providers import Provider, complete, echo

#: What a model is asked for a summary of some notes, how a note is shown to it, and what comes between two of them.
SUMMARY = "Summarize the following notes concisely, preserving key facts, dates and names.\n\n{notes}\n\nSummary:"
NOTE, BETWEEN = "Note ID: {i}\nNote Title: {title}\nNote Date: {day}\nText:\n{text}", "\n\n---\n\n"
ABSENT, SILENT = "note_id {i} is not in 0..{last}", "tool error (summary): no answer"
#: Steps kept as they are; older ones are folded into a summary.
KEEP, STEPS = 10, 300
Policy = Callable[[str], dict]


def meta(notes: list[dict]) -> str:
    if not notes:
        return "No notes available."
    days = sorted(n["note_date"] for n in notes if n["note_date"])
    kinds = Counter(n["note_title"] for n in notes)
    return f"{len(notes)} notes, {days[0] if days else '?'} to {days[-1] if days else '?'}; " + ", ".join(f"{t}: {c}" for t, c in sorted(kinds.items(), key=lambda x: (-x[1], x[0])))


def find(notes: list[dict], start: str = "", end: str = "", keywords: list[str] = (), types: list[str] = (), match: str = "any") -> list[int]:
    test = all if match == "all" else any
    out = []
    for i, n in enumerate(notes):
        hay, title, day = f"{n['note_title']} {n['text']}".lower(), n["note_title"].lower(), n["note_date"] or ""
        if (not start or day >= start) and (not end or day <= end) and (not keywords or test(k.lower() in hay for k in keywords)) and (not types or test(k.lower() in title for k in types)):
            out.append(i)
    return out


def shown(notes: list[dict], i: int) -> str:
    if not 0 <= i < len(notes):
        return ABSENT.format(i=i, last=len(notes) - 1)
    return NOTE.format(i=i, title=notes[i]["note_title"], day=notes[i]["note_date"] or "", text=notes[i]["text"])


def call(notes: list[dict], name: str, args: dict, provider: Provider = echo) -> str:
    """One tool call; whatever goes wrong comes back as text.  A summary is the provider's answer to a prompt with the whole notes."""
    try:
        if name == "meta":
            return meta(notes)
        if name == "search":
            found = find(notes, **args)
            lines = [f"[{i}] {notes[i]['note_title']} ({notes[i]['note_date'] or ''}) {notes[i]['text'][:100]}".replace("\n", " ") for i in found]
            return "\n".join([f"{len(found)} matched", *lines]) if found else "nothing matched"
        if name == "note":
            i = int(args["note_id"])
            return notes[i]["text"] if 0 <= i < len(notes) else ABSENT.format(i=i, last=len(notes) - 1)
        if name == "summary":
            ids = [int(i) for i in args.get("note_ids", [])]
            if not ids:
                return "no note ids"
            said = provider([SUMMARY.format(notes=BETWEEN.join(shown(notes, i) for i in ids))])[0]
            return SILENT if said is None else said
        return f"unknown tool: {name}"
    except Exception as e:  # a tool's failure is an observation for the agent
        return f"tool error ({name}): {e}"


def entry(step: dict) -> str:
    return f"{json.dumps(step['tool'], sort_keys=True)} -> {step['draft']}"


def compacted(history: list[dict], summary: str, keep: int = KEEP) -> tuple[list[dict], str]:
    """The recent steps, and the summary with the older ones folded in."""
    if len(history) <= keep:
        return history, summary
    return history[-keep:], "; ".join(x for x in (summary, *[s["draft"] for s in history[:-keep]]) if x)


def stops(answer: dict) -> bool:
    said = answer.get("stop", False)
    return said.lower() == "true" if isinstance(said, str) else bool(said)


def run(question: str, notes: list[dict], policy: Policy, steps: int = STEPS, keep: int = KEEP, provider: Provider = echo) -> dict:
    """Ask the policy, call the tool it names, and go on until it stops or names none.  The provider writes summaries of notes."""
    answer = policy(f"{question}\n{meta(notes)}")
    recent, summary, tools = [{"tool": None, "draft": answer.get("draft", "")}], "", []
    for _ in range(steps):
        tool = answer.get("tool")
        if stops(answer) or tool is None:
            break
        seen = call(notes, tool["name"], tool.get("args", {}), provider)
        recent, summary = compacted(recent, summary, keep)
        answer = policy("\n".join([question, summary, *map(entry, recent), seen]))
        tools.append(tool["name"])
        recent.append({"tool": tool, "draft": answer.get("draft", "")})
    return {"answer": answer.get("draft", ""), "n_steps": len(tools), "tools": json.dumps(tools)}


def scripted(prompt: str) -> dict:
    """The stub of the tests: look at the notes, search, read the first match, answer with its length."""
    last = prompt.rsplit("\n", 1)[-1]
    if "reading " in prompt or "nothing matched" in prompt:
        return {"draft": f"read {len(prompt)}", "stop": "True"}
    if "matched" in prompt:
        first = prompt.split("matched\n[", 1)[1].split("]", 1)[0]
        return {"draft": f"reading {first}", "tool": {"name": "note", "args": {"note_id": first}}}
    return {"draft": f"searching after {len(last)}", "tool": {"name": "search", "args": {"keywords": ["license", "token"]}}}


def answers(visible: DataFrame, policy: Policy, steps: int = STEPS, provider: Provider = echo) -> DataFrame:
    """``visible(question_id, question, note_idx, note_date, note_title, text)`` to one answer a question; questions run in parallel.

    A task holds the notes one question may see, as its agent needs them at hand.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("note_idx")
        notes = [{"note_date": d, "note_title": t or "", "text": x or ""} for d, t, x in zip(rows["note_date"], rows["note_title"], rows["text"])]
        out = run(rows["question"].iloc[0], notes, policy, steps, provider=provider)
        return pd.DataFrame([{"question_id": rows["question_id"].iloc[0], **out}])

    return visible.groupBy("question_id").applyInPandas(one, "question_id string, answer string, n_steps bigint, tools string")


def tool_outputs(notes: DataFrame, provider: Provider | None = None) -> DataFrame:
    """What each tool says about each subject's notes: (subject_id, tool, output).

    The tools of ``call`` over a whole table: their answers are aggregated, and
    no task holds the texts of a subject.  Summaries need a provider; it gets
    the prompts of all subjects as a table.
    """
    key, day = "subject_id", F.col("note_date")
    rows = notes.select(key, "note_idx", "note_date", F.coalesce("note_title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))

    def said(df: DataFrame, name: str, args: dict, output: Column) -> DataFrame:
        return df.select(key, F.lit(f"{name} {json.dumps(args, sort_keys=True)}").alias("tool"), output.alias("output"))

    known = F.when(day != "", day)
    titles = rows.groupBy(key, "title").agg(F.count("*").alias("n"), F.min(known).alias("first"), F.max(known).alias("last"))
    held = titles.groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "title"))).alias("kinds"))
    kinds = F.array_join(F.transform("kinds", lambda x: F.concat(x["title"], F.lit(": "), -x["m"])), ", ")
    span = F.concat("n", F.lit(" notes, "), F.coalesce("first", F.lit("?")), F.lit(" to "), F.coalesce("last", F.lit("?")), F.lit("; "), kinds)
    absent = lambda i: fill(ABSENT, i=F.lit(i), last=F.col("n") - 1)
    # only the previews of matching notes are put in order
    line = F.concat("title", F.lit(" ("), F.coalesce(day, F.lit("")), F.lit(") "), F.substring("text", 1, 100))
    match = F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.lit("license"))
    narrow = rows.select(key, "note_idx", F.when(match, F.translate(line, "\n", " ")).alias("line"))
    placed = narrow.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("note_idx")) - 1)
    found = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("i", "line")))).alias("m"))
    lines = F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), x["i"], F.lit("] "), x["line"])), "\n")
    second = top_k(rows.select(key, "note_idx", "text"), [key], [F.asc("note_idx")], 2).groupBy(key).agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 2, F.col("text"))).alias("text"))
    out = [
        said(held, "meta", {}, span),
        said(found, "search", {"keywords": ["license"], "match": "all"}, F.when(F.size("m") > 0, F.concat(F.size("m"), F.lit(" matched\n"), lines)).otherwise("nothing matched")),
        said(second, "note", {"note_id": 1}, F.coalesce("text", absent(1))),
        said(held, "note", {"note_id": 10**9}, absent(10**9)),
        said(held, "note", {}, F.lit(call([], "note", {}))),
        said(held, "other", {}, F.lit(call([], "other", {}))),
    ]
    if provider is not None:
        asked = {"note_ids": [1, 0, 10**9]}
        note = fill(NOTE, i=F.col("rank") - 1, title=F.col("title"), day=F.coalesce(day, F.lit("")), text=F.col("text"))
        read = top_k(rows, [key], [F.asc("note_idx")], 2).groupBy(F.col(key).alias("of")).agg(*[F.max(F.when(F.col("rank") == i + 1, note)).alias(f"note_{i}") for i in (0, 1)])
        whole = held.select(key, "n").join(read, F.col(key).eqNullSafe(F.col("of")))
        shows = [F.coalesce(F.col(f"note_{i}"), absent(i)) if i < 2 else absent(i) for i in asked["note_ids"]]
        said_by = complete(whole.select(key, fill(SUMMARY, notes=F.concat_ws(BETWEEN, *shows)).alias("prompt")), provider, key, fallback=SILENT)
        out += [said(said_by, "summary", asked, F.col("text")), said(held, "summary", {}, F.lit(call([], "summary", {})))]
    return functools.reduce(DataFrame.unionByName, out)
