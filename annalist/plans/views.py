"""The engine's relations, derived from the supplied tables by arithmetic that Spark and DuckDB share.

Every view is narrow over its table: no shuffle.  ``CTE`` holds the same
definitions in DuckDB SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


START = "DATE'2024-01-01'"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id % 20 as string) subject_id",
        "doc_id div 20 note_idx",
        f"case when doc_id % 17 = 0 then null else date_add({START}, cast(doc_id * 7 % 365 as int)) end note_date",
        "source note_title",
        "text",
        "doc_id",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").selectExpr(
        "concat(item_id % 20, '_', item_id) question_id",
        "cast(item_id % 20 as string) subject_id",
        "text natural_query",
        f"date_add({START}, cast(item_id * 11 % 365 as int)) cutoff",
        "text reference",
        "item_id",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "documents")
        .selectExpr("doc_id", f"case when doc_id % 17 = 0 then null else date_add({START}, cast(doc_id * 7 % 365 as int)) end fact_date", r"posexplode(split(text, '[.] ')) as (fact_idx, sentence)")
        .selectExpr("doc_id", "cast(fact_idx as bigint) fact_idx", "case when fact_date is null then sentence else concat(sentence, ' (', cast(fact_date as string), ')') end fact", "fact_date")
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).selectExpr("doc_id", "fact_idx", "explode(array(0, 1, 2)) juror").selectExpr("doc_id", "fact_idx", "cast(juror as bigint) juror", "(doc_id * (2 * juror + 3) + fact_idx * (juror + 5)) % 7 < 4 vote")


def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = "element_at(array('A', 'B', 'TIE'), cast((item_id * {m} + a * 7 + b * 3 + pos * {p}) % 3 + 1 as int)) {name}"
    return (
        read(spark, sf_dir, "benchmark")
        .selectExpr("item_id", "explode(array(struct(0 a, 1 b), struct(0 a, 2 b), struct(0 a, 3 b), struct(1 a, 2 b), struct(1 a, 3 b), struct(2 a, 3 b))) p")
        .selectExpr("item_id", "p.a", "p.b", "explode(array(0, 1)) pos")
        .selectExpr(
            "concat(item_id % 20, '_', item_id) question_id",
            "concat('m', if(pos = 0, a, b)) model_a",
            "concat('m', if(pos = 0, b, a)) model_b",
            "if(pos = 0, 'ab', 'ba') position",
            label.format(m=31, p=1, name="completeness"),
            label.format(m=17, p=2, name="relevancy"),
            label.format(m=13, p=1, name="concision"),
            "(item_id * 16 + a * 4 + b) * 2 + pos ord",
        )
    )


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy binary ratings: unit, direction, rater, label (null: unmarked)."""
    return read(spark, sf_dir, "labels").selectExpr(
        "doc_id unit",
        "if(doc_id % 2 = 0, 'precision', 'recall') direction",
        "explode(map('r0', quality, 'r1', toxic, 'r2', cast(doc_id % 3 > 0 as int), 'r3', if(doc_id % 11 = 0, null, cast(doc_id * 7 % 5 < 3 as int)))) as (rater, label)",
    )


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy A/B/TIE ratings: unit, rater, label."""
    pick = "element_at(array('A', 'B', 'TIE'), cast((unit * {m} + unit div {d}) % 3 + 1 as int))"
    return read(spark, sf_dir, "documents").selectExpr("doc_id unit").selectExpr(
        "unit", f"explode(map('human', {pick.format(m=5, d=3)}, 'j1', {pick.format(m=5, d=4)}, 'j2', {pick.format(m=7, d=2)})) as (rater, label)"
    )


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved notes of a response: subject, date (null: undated), and the subject's cutoff."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "case when event_id % 13 = 0 then null else to_date(ts) end note_date", "date_add(DATE'2024-01-01', cast(user_id * 7 % 365 as int)) cutoff", "value"
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "concat('m', conv_id % 4) model", "concat(conv_id % 40 % 20, '_', conv_id % 40, '_', turn) response_id", "concat(conv_id % 40 % 20, '_', conv_id % 40) question_id", "text response"
    )


CTE = {
    "v_notes": """v_notes AS (SELECT CAST(doc_id % 20 AS VARCHAR) AS subject_id, doc_id // 20 AS note_idx,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id * 7 % 365 AS INTEGER) END AS note_date,
        source AS note_title, text, doc_id FROM documents)""",
    "v_questions": """v_questions AS (SELECT (item_id % 20) || '_' || item_id AS question_id, CAST(item_id % 20 AS VARCHAR) AS subject_id,
        text AS natural_query, DATE '2024-01-01' + CAST(item_id * 11 % 365 AS INTEGER) AS cutoff, text AS reference, item_id FROM benchmark)""",
    "v_facts": """v_facts AS (SELECT doc_id, i - 1 AS fact_idx, CASE WHEN fact_date IS NULL THEN s[i] ELSE s[i] || ' (' || CAST(fact_date AS VARCHAR) || ')' END AS fact, fact_date
        FROM (SELECT doc_id, s, fact_date, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, '. ') AS s,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id * 7 % 365 AS INTEGER) END AS fact_date FROM documents)))""",
    "v_verdicts": """v_verdicts AS (SELECT doc_id, fact_idx, juror, (doc_id * (2 * juror + 3) + fact_idx * (juror + 5)) % 7 < 4 AS vote
        FROM v_facts, (SELECT unnest(range(3)) AS juror))""",
    "v_pairwise": """v_pairwise AS (SELECT (item_id % 20) || '_' || item_id AS question_id, 'm' || CASE WHEN pos = 0 THEN a ELSE b END AS model_a,
        'm' || CASE WHEN pos = 0 THEN b ELSE a END AS model_b, CASE WHEN pos = 0 THEN 'ab' ELSE 'ba' END AS position,
        ['A', 'B', 'TIE'][(item_id * 31 + a * 7 + b * 3 + pos * 1) % 3 + 1] AS completeness, ['A', 'B', 'TIE'][(item_id * 17 + a * 7 + b * 3 + pos * 2) % 3 + 1] AS relevancy,
        ['A', 'B', 'TIE'][(item_id * 13 + a * 7 + b * 3 + pos * 1) % 3 + 1] AS concision, (item_id * 16 + a * 4 + b) * 2 + pos AS ord
        FROM benchmark, (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b), (SELECT unnest(range(2)) AS pos) WHERE a < b)""",
    "v_raters": """v_raters AS (SELECT doc_id AS unit, CASE WHEN doc_id % 2 = 0 THEN 'precision' ELSE 'recall' END AS direction, rater,
        CASE rater WHEN 'r0' THEN quality WHEN 'r1' THEN toxic WHEN 'r2' THEN CAST(doc_id % 3 > 0 AS INTEGER)
        ELSE CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id * 7 % 5 < 3 AS INTEGER) END END AS label FROM labels, (SELECT unnest(['r0', 'r1', 'r2', 'r3']) AS rater))""",
    "v_choices": """v_choices AS (SELECT doc_id AS unit, rater, ['A', 'B', 'TIE'][CASE rater WHEN 'human' THEN (doc_id * 5 + doc_id // 3) % 3 WHEN 'j1' THEN (doc_id * 5 + doc_id // 4) % 3
        ELSE (doc_id * 7 + doc_id // 2) % 3 END + 1] AS label FROM documents, (SELECT unnest(['human', 'j1', 'j2']) AS rater))""",
    "v_retrieved": """v_retrieved AS (SELECT user_id, event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS note_date,
        DATE '2024-01-01' + CAST(user_id * 7 % 365 AS INTEGER) AS cutoff, value FROM events)""",
    "v_responses": """v_responses AS (SELECT conv_id, turn, 'm' || (conv_id % 4) AS model, (conv_id % 40 % 20) || '_' || (conv_id % 40) || '_' || turn AS response_id,
        (conv_id % 40 % 20) || '_' || (conv_id % 40) AS question_id, text AS response FROM conversations WHERE role = 'assistant')""",
}
NEEDS = {"v_verdicts": ["v_facts"]}


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names in front."""
    import re

    used: list[str] = []
    for name in re.findall(r"\bv_[a-z]+\b", sql):
        for n in (*NEEDS.get(name, []), name):
            if n in CTE and n not in used:
                used.append(n)
    head = ", ".join(CTE[n] for n in used)
    if not head:
        return sql
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


__all__ = ["CTE", "choices", "facts", "notes", "pairwise", "questions", "raters", "read", "responses", "retrieved", "verdicts", "with_views"]
