"""The registered queries, named after the blueprint's operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stem as ST
from .functions import text as T
from .functions import tokens as K
from .operators import agreement as A
from .operators import asof as O
from .operators import matching as B
from .operators import facts as X
from .operators import pairwise as P
from .operators import retrieval as R
from .operators import tables as S
from .operators import timeline as L
from .operators import vectors as N
from .plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = V.with_views(sql)
        return f

    return register


# Scans, filters, projections


@query("val_01", "SELECT question_id, 'no notes' AS problem FROM v_questions WHERE subject_id NOT IN (SELECT subject_id FROM v_notes) UNION ALL SELECT question_id, 'bad timestamp' FROM v_questions WHERE cutoff IS NULL")
def _(spark, d):
    return L.violations(V.questions(spark, d), V.notes(spark, d))


@query("flt_01", "SELECT question_id, note_idx, note_date FROM v_questions JOIN v_notes USING (subject_id) WHERE note_date <= cutoff")
def _(spark, d):
    return R.as_of(V.questions(spark, d), V.notes(spark, d)).select("question_id", "note_idx", "note_date")


@query("flt_02", "SELECT DISTINCT subject_id, cutoff FROM v_questions")
def _(spark, d):
    return V.questions(spark, d).select("subject_id", "cutoff").distinct()


@query("flt_03", "SELECT subject_id, note_idx FROM v_notes WHERE COALESCE(CAST(note_date AS VARCHAR), '') >= '2024-02-01' AND COALESCE(CAST(note_date AS VARCHAR), '') <= '2024-09-30' AND (contains(lower(note_title || ' ' || text), 'license') OR contains(lower(note_title || ' ' || text), 'token')) AND (contains(lower(note_title), 'src1') OR contains(lower(note_title), 'src3'))")
def _(spark, d):
    return R.search(V.notes(spark, d), "2024-02-01", "2024-09-30", ["License", "token"], ["src1", "src3"]).select("subject_id", "note_idx")


@query("flt_04", "SELECT response_id, regexp_replace(model || '_batch', '_(batch|sandbox)$', '') AS base FROM v_responses WHERE model IN ('m1', 'm2')")
def _(spark, d):
    return V.responses(spark, d).withColumn("base", T.model_base(F.concat("model", F.lit("_batch")))).where(F.col("base").isin("m1", "m2")).select("response_id", "base")


@query("flt_05", "SELECT doc_id, fact_idx FROM v_facts WHERE fact_date BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'")
def _(spark, d):
    return L.date_window(V.facts(spark, d), "2024-03-01", "2024-06-30").select("doc_id", "fact_idx")


@query("flt_06", "SELECT conv_id, turn, regexp_matches(trim(text), '^([{]|\\[|```)') AS json_like FROM conversations")
def _(spark, d):
    return V.read(spark, d, "conversations").select("conv_id", "turn", F.trim("text").rlike(r"^(\{|\[|```)").alias("json_like"))


@query("flt_07", "SELECT doc_id, count(*) AS n FROM v_facts GROUP BY doc_id HAVING count(*) <= 10")
def _(spark, d):
    return V.facts(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).where("n <= 10")


@query("flt_08", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND role <> 'system'")
def _(spark, d):
    return V.read(spark, d, "conversations").where("trim(text) <> '' and role <> 'system'").select("conv_id", "turn")


@query("prj_02", "SELECT doc_id, string_agg(fact_idx || ':' || length(fact), ',' ORDER BY fact_idx) AS items FROM v_facts GROUP BY doc_id")
def _(spark, d):
    g = V.facts(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("fact_idx", "fact"))).alias("f"))
    return g.select("doc_id", F.array_join(F.transform("f", lambda x: F.concat(x["fact_idx"], F.lit(":"), F.length(x["fact"]))), ",").alias("items"))


@query("prj_03", "SELECT DISTINCT model || '__' || role AS tagged, model, role AS tag FROM (SELECT 'm' || (conv_id % 4) AS model, role FROM conversations)")
def _(spark, d):
    t = V.read(spark, d, "conversations").selectExpr("concat('m', conv_id % 4, '__', role) tagged").distinct()
    return t.select("tagged", F.split_part("tagged", F.lit("__"), F.lit(1)).alias("model"), F.split_part("tagged", F.lit("__"), F.lit(2)).alias("tag"))


@query("prj_04", "SELECT DISTINCT source, regexp_extract(source || '_bm25', '^(.*)_(recent200|recent|dense|agent|bm25|late)$', 1) AS provider, 'bm25' AS method FROM documents")
def _(spark, d):
    p = T.source_parts(F.concat("source", F.lit("_bm25")))
    return V.read(spark, d, "documents").select("source").distinct().select("source", p["provider"].alias("provider"), p["method"].alias("method"))


# Joins


@query("join_01", "SELECT question_id, count(*) AS n FROM v_questions JOIN v_notes USING (subject_id) GROUP BY question_id")
def _(spark, d):
    return V.questions(spark, d).join(V.notes(spark, d), "subject_id").groupBy("question_id").agg(F.count("*").alias("n"))


@query("join_02", "SELECT question_id, count(note_idx) AS n, min(note_date) AS first_date, max(note_date) AS last_date FROM v_questions q LEFT JOIN v_notes n ON q.subject_id = n.subject_id AND note_date <= cutoff GROUP BY question_id")
def _(spark, d):
    return O.as_of_summary(V.questions(spark, d).select("question_id", "subject_id", "cutoff"), V.notes(spark, d)).select("question_id", "n", "first_date", "last_date")


@query("join_02_rows", "SELECT question_id, note_idx, note_date FROM v_questions JOIN v_notes USING (subject_id) WHERE note_date <= cutoff")
def _(spark, d):
    """The visible notes themselves, one row a question and note."""
    q, n = V.questions(spark, d), V.notes(spark, d).select("subject_id", "note_idx", "note_date")
    return O.as_of_rows(q.select("question_id", "subject_id", "cutoff"), n).select("question_id", "note_idx", "note_date")


@query("join_03", "SELECT question_id, model FROM v_questions, (SELECT unnest(['m0', 'm1', 'm2', 'm3']) AS model) WHERE (question_id, model) NOT IN (SELECT question_id, model FROM v_responses)")
def _(spark, d):
    return S.pending(S.cross_models(V.questions(spark, d).select("question_id"), ["m0", "m1", "m2", "m3"]), V.responses(spark, d), ["question_id", "model"])


@query("join_04", "SELECT response_id, model, cutoff FROM v_responses LEFT JOIN (SELECT question_id, any_value(cutoff) AS cutoff FROM v_questions GROUP BY question_id) USING (question_id)")
def _(spark, d):
    q = V.questions(spark, d).select("question_id", "cutoff").dropDuplicates(["question_id"])
    return V.responses(spark, d).join(q, "question_id", "left").select("response_id", "model", "cutoff")


@query("join_06", "SELECT r.response_id, q.question_id FROM v_responses r JOIN v_questions q ON q.question_id = string_split(r.response_id, '_')[1] || '_' || string_split(r.response_id, '_')[2]")
def _(spark, d):
    r = V.responses(spark, d).select("response_id", F.array_join(F.slice(F.split("response_id", "_"), 1, 2), "_").alias("question_id"))
    return r.join(V.questions(spark, d).select("question_id"), "question_id").select("response_id", "question_id")


@query("join_07", "SELECT response_id, q.reference FROM v_responses r JOIN v_questions q ON q.question_id = regexp_replace(r.response_id, '_[^_]*$', '')")
def _(spark, d):
    r = V.responses(spark, d).select("response_id", F.regexp_replace("response_id", "_[^_]*$", "").alias("question_id"))
    return r.join(V.questions(spark, d).select("question_id", "reference"), "question_id").select("response_id", "reference")


@query("join_08", "SELECT g.doc_id AS gold_id, c.doc_id AS cand_id, g.n AS gold_facts, c.n AS cand_facts FROM (SELECT doc_id, count(*) AS n FROM v_facts WHERE doc_id % 2 = 0 GROUP BY doc_id) g JOIN (SELECT doc_id, count(*) AS n FROM v_facts WHERE doc_id % 2 = 1 GROUP BY doc_id) c ON c.doc_id = g.doc_id + 1")
def _(spark, d):
    n = V.facts(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    gold = n.where("doc_id % 2 = 0").selectExpr("doc_id gold_id", "n gold_facts", "doc_id + 1 cand_id")
    return gold.join(n.where("doc_id % 2 = 1").selectExpr("doc_id cand_id", "n cand_facts"), "cand_id")


@query("join_09", "SELECT a.l_orderkey, unnest([a.s || '>' || b.s, b.s || '>' || a.s]) AS pair FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.s < b.s")
def _(spark, d):
    r = V.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().withColumn("ord", F.col("l_suppkey"))
    return P.all_pairs(r, "l_orderkey", "l_suppkey", "ord").select("l_orderkey", F.concat_ws(">", "model_a", "model_b").alias("pair"))


@query("join_10", "SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n FROM v_raters a JOIN v_raters b ON a.unit = b.unit AND a.rater < b.rater WHERE a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return A.pairs(V.raters(spark, d), ["unit"]).groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"))


@query("join_11", "SELECT c.doc_id // 2 AS k, c.fact_idx AS cand_idx, r.fact_idx AS ref_idx FROM v_facts c JOIN v_facts r ON c.doc_id // 2 = r.doc_id // 2 AND c.doc_id % 2 = 1 AND r.doc_id % 2 = 0 AND COALESCE(CAST(c.fact_date AS VARCHAR), '') = COALESCE(CAST(r.fact_date AS VARCHAR), '')")
def _(spark, d):
    f = V.facts(spark, d).withColumn("k", F.expr("doc_id div 2")).withColumn("fact_date", F.col("fact_date"))
    return X.same_date_pairs(f.where("doc_id % 2 = 1"), f.where("doc_id % 2 = 0"), "k").select("k", "cand_idx", "ref_idx")


@query("join_12", "SELECT question_id, arg_min(model, CASE model WHEN 'm2' THEN 0 WHEN 'm0' THEN 1 ELSE 2 END * 10 + CAST(substr(model, 2) AS INTEGER)) AS model FROM v_responses GROUP BY question_id")
def _(spark, d):
    rank = F.when(F.col("model") == "m2", 0).when(F.col("model") == "m0", 1).otherwise(2)
    return V.responses(spark, d).groupBy("question_id").agg(F.min_by("model", F.struct(rank, "model")).alias("model"))


@query("join_15", "SELECT doc_id, fact_idx FROM v_facts f WHERE EXISTS (SELECT 1 FROM v_notes n WHERE n.doc_id = f.doc_id AND n.note_date IS NOT NULL)")
def _(spark, d):
    return V.facts(spark, d).join(V.notes(spark, d).where("note_date is not null").select("doc_id"), "doc_id", "left_semi").select("doc_id", "fact_idx")


@query("join_16", "SELECT question_id FROM v_questions WHERE question_id NOT IN (SELECT question_id FROM v_responses WHERE trim(response) <> '')")
def _(spark, d):
    return S.pending(V.questions(spark, d).select("question_id"), V.responses(spark, d), ["question_id"], "response")


@query("join_17", "SELECT q.question_id, CASE WHEN r.question_id IS NULL THEN 'missing' WHEN r.n % 3 = 0 THEN 'error' END AS reason FROM v_questions q LEFT JOIN (SELECT question_id, count(*) AS n FROM v_responses GROUP BY question_id) r USING (question_id)")
def _(spark, d):
    lines = V.responses(spark, d).groupBy("question_id").agg(F.count("*").alias("n")).select("question_id", F.when(F.col("n") % 3 == 0, "failed").alias("status"), F.lit("x").alias("text"))
    return S.keyed_results(V.questions(spark, d).select("question_id"), lines, ["question_id"]).select("question_id", "reason")


@query("join_18", "SELECT question_id, CASE WHEN bool_and(model_a > model_b) THEN least(any_value(model_a), any_value(model_b)) ELSE greatest(any_value(model_a), any_value(model_b)) END AS model_a FROM v_pairwise WHERE ord % 5 <> 0 GROUP BY question_id, least(model_a, model_b), greatest(model_a, model_b) HAVING count(*) = 1")
def _(spark, d):
    return P.missing_orders(V.pairwise(spark, d).where("ord % 5 <> 0"), ["question_id"]).select("question_id", "model_a")


# Chunking and budgets


@query("chk_01")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.posexplode(T.split_chunks(F.col("text"), 4000, 400)).alias("chunk_idx", "text"))


@query("chk_03")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.posexplode(T.split_chunks(F.col("text"), 800, 80)).alias("chunk_idx", "text"))


@query("chk_04", "SELECT doc_id, i AS chunk_idx, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 2000.0) AS BIGINT)))) AS i FROM documents)")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"), 2000)).alias("chunk_idx", "chunk")).withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


_BATCHES = "SELECT subject, ordinal // {k} AS batch, count(*) AS n FROM (SELECT doc_id % 20 AS subject, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id, fact_idx) - 1 AS ordinal FROM v_facts) GROUP BY ALL"


def _batches(spark, d, k):
    """Fact ordinals of a subject from running counts of its documents, so that no task orders all facts of a subject."""
    f = V.facts(spark, d).selectExpr("doc_id % 20 subject", "doc_id", "fact_idx")
    starts = S.running_ordinal(f.groupBy("subject", "doc_id").agg(F.count("*").alias("n")), "subject", "doc_id", "n").select("doc_id", "start")
    return f.join(starts, "doc_id").groupBy("subject", F.expr(f"(start + fact_idx) div {k}").alias("batch")).agg(F.count("*").alias("n"))


@query("chk_05", _BATCHES.format(k=500))
def _(spark, d):
    return _batches(spark, d, 500)


@query("chk_08", "SELECT subject_id, note_idx, CAST(used AS BIGINT) AS used FROM (SELECT subject_id, note_idx, sum(len([x FOR x IN string_split_regex('Note Title: ' || note_title || chr(10) || 'Note Date: ' || COALESCE(CAST(note_date AS VARCHAR), '') || chr(10) || 'Text: ' || text || chr(10), '\\s+') IF x <> ''])) OVER (PARTITION BY subject_id ORDER BY note_date DESC NULLS LAST, note_idx) AS used FROM v_notes) WHERE used <= 5000")
def _(spark, d):
    """Newest first, as prompts show the notes, until the next one would pass the budget."""
    shown = T.note_block(F.col("note_title"), F.col("note_date"), F.col("text"))
    n = V.notes(spark, d).select("subject_id", "note_idx", "note_date", T.token_count(shown).alias("tokens"))
    return S.budget_prefix(n, ["subject_id"], [F.desc_nulls_last("note_date"), F.asc("note_idx")], F.col("tokens"), 5000).select("subject_id", "note_idx", "used")


@query("chk_08_tokens")
def _(spark, d):
    """The same in tokens of a byte-pair vocabulary, months beyond the budget left out before any note is put in order."""
    shown = T.note_block(F.col("note_title"), F.col("note_date"), F.col("text"))
    return O.newest_within(V.notes(spark, d), K.model_tokens(shown), 20_000).select("subject_id", "note_idx", "used")


@query("chk_10")
def _(spark, d):
    return S.rolling_batches(V.notes(spark, d), "subject_id", F.col("note_idx"), F.length("text"), 8000)


@query("chk_11", "SELECT doc_id, len([x FOR x IN string_split_regex(text, '\\s+') IF x <> '']) AS n_tokens FROM documents")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("chk_11_tokens")
def _(spark, d):
    """Tokens of a byte-pair vocabulary."""
    return V.read(spark, d, "documents").select("doc_id", K.model_tokens(F.col("text")).alias("n_tokens"))


# Retrieval


@query("ret_01", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.size(R.tokens(F.col("text"))).cast("bigint").alias("n"))


_BM25 = """tok AS (SELECT subject_id, note_idx, note_date, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM v_notes WHERE note_date IS NOT NULL),
tf AS (SELECT subject_id, note_idx, note_date, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT subject_id, note_idx, note_date, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS DOUBLE) AS dl FROM v_notes WHERE note_date IS NOT NULL),
qt AS (SELECT question_id, subject_id, cutoff, term, count(*) AS qtf FROM (SELECT question_id, subject_id, cutoff, unnest(regexp_extract_all(lower(natural_query), '[\\p{L}\\p{N}_]+')) AS term FROM v_questions) GROUP BY ALL),
seen AS (SELECT question_id, note_idx, dl FROM v_questions JOIN dl USING (subject_id) WHERE note_date <= cutoff),
corpus AS (SELECT question_id, count(*) AS n, avg(dl) AS avgdl FROM seen GROUP BY question_id),
idf AS (SELECT question_id, term, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT question_id, term, count(*) AS df FROM v_questions JOIN tf USING (subject_id) WHERE note_date <= cutoff GROUP BY ALL) JOIN corpus USING (question_id)),
fl AS (SELECT question_id, avg(idf) * 0.25::DOUBLE AS fl FROM idf GROUP BY question_id),
hit AS (SELECT question_id, note_idx, sum(qtf * CASE WHEN idf < 0 THEN fl ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN tf USING (subject_id, term) JOIN idf USING (question_id, term) JOIN fl USING (question_id) JOIN seen USING (question_id, note_idx) WHERE note_date <= cutoff GROUP BY ALL),
ranked AS (SELECT question_id, note_idx, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, note_idx) AS rank FROM (SELECT question_id, note_idx, round(COALESCE(score, 0.0::DOUBLE), 6) AS score FROM seen LEFT JOIN hit USING (question_id, note_idx)))"""


@query("ret_02", f"WITH /* v_notes v_questions */ {_BM25} SELECT question_id, note_idx, score, rank FROM ranked WHERE rank <= 10")
def _(spark, d):
    return R.bm25(V.questions(spark, d), V.notes(spark, d), 10)


@query("ret_03", f"WITH /* v_notes v_questions */ {_BM25} SELECT question_id, note_idx, rank FROM ranked WHERE score > 0 AND rank <= 50")
def _(spark, d):
    return R.bm25(V.questions(spark, d), V.notes(spark, d), 50).where("score > 0").select("question_id", "note_idx", "rank")


_DENSE = """q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS item_id, embedding AS b FROM embeddings),
s AS (SELECT query_id, item_id, round(list_sum([CAST(x[1] AS DOUBLE) * x[2] FOR x IN list_zip(a, b)]) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN a])) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN b])), 6) AS score FROM q, c)"""


def _vectors(spark, d):
    e = V.read(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").selectExpr("vec_id query_id", "embedding vec"), e.selectExpr("vec_id item_id", "embedding vec")


@query("ret_04", f"WITH {_DENSE} SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10")
def _(spark, d):
    return N.search(*_vectors(spark, d), 10)


@query("ret_04_probed")
def _(spark, d):
    """The same in the cells nearest to each query, as many as find 0.95 within the index's sample: recall is measured in the tests."""
    return N.search(*_vectors(spark, d), 10, recall=0.95)


@query("ret_05", f"WITH {_DENSE} SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score >= 0.4::DOUBLE QUALIFY rank <= 50")
def _(spark, d):
    return N.search(*_vectors(spark, d), 50, 0.4)


def _rankings(spark, d):
    s = V.read(spark, d, "labels").selectExpr("doc_id % 40 query_id", "doc_id item_id", "doc_id * 31 % 1009 x", "doc_id * 17 % 1013 y")
    return R.top_k(s, ["query_id"], [F.desc("x"), F.asc("item_id")], None), R.top_k(s, ["query_id"], [F.desc("y"), F.asc("item_id")], None)


_RANKS = """r AS (SELECT doc_id % 40 AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id * 31 % 1009 DESC, doc_id) AS r1, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id * 17 % 1013 DESC, doc_id) AS r2 FROM labels)"""


@query("ret_06", f"WITH {_RANKS}, u AS (SELECT query_id, item_id, min(p) AS p FROM (SELECT query_id, item_id, r1 AS p FROM r WHERE r1 <= 3 UNION ALL SELECT query_id, item_id, 1000 + r2 FROM r WHERE r2 <= 3) GROUP BY ALL) SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY p, item_id) AS rank FROM u QUALIFY rank <= 5")
def _(spark, d):
    a, b = _rankings(spark, d)
    return R.candidates(a.where("rank <= 3"), b.where("rank <= 3"), key="query_id", item="item_id", k=5)


@query("ret_07", f"WITH {_RANKS} SELECT query_id, item_id, round(1 / CAST(59 + r1 AS DOUBLE) + 1 / CAST(59 + r2 AS DOUBLE), 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / CAST(59 + r1 AS DOUBLE) + 1 / CAST(59 + r2 AS DOUBLE), 8) DESC, item_id) AS rank FROM r QUALIFY rank <= 100")
def _(spark, d):
    return R.fuse(*_rankings(spark, d), "query_id", "item_id", 100)


def _token_vectors(spark, d):
    """Four vectors of 16 out of each of 64; every twentieth row asks."""
    e = V.read(spark, d, "embeddings")
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding"), i * 16 + 1, F.lit(16)))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), cut.alias("q")), e.select(F.col("vec_id").alias("item_id"), cut.alias("c"))


@query("ret_09")
def _(spark, d):
    return N.late_search(*_token_vectors(spark, d), 10)


@query("ret_09_probed")
def _(spark, d):
    """The same among the items of the cells nearest to each vector of a query: recall is measured in the tests."""
    return N.late_search(*_token_vectors(spark, d), 10, recall=0.95)


@query("ret_11", f"WITH /* v_notes v_questions */ {_BM25} SELECT question_id, string_agg('[' || rank || '] Note Title: ' || note_title || chr(10) || 'Note Date: ' || COALESCE(CAST(note_date AS VARCHAR), '') || chr(10) || 'Text: ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN v_questions USING (question_id) JOIN v_notes USING (subject_id, note_idx) WHERE rank <= 10 GROUP BY question_id")
def _(spark, d):
    q, n = V.questions(spark, d), V.notes(spark, d)
    found = R.bm25(q, n, 10).join(q.select("question_id", "subject_id"), "question_id")
    return R.context(R.with_notes(found, n), "question_id")


@query("ret_12", "WITH t AS (SELECT subject_id, note_title, count(*) AS n FROM v_notes GROUP BY ALL) SELECT s.subject_id, n_notes, first_date, last_date, titles FROM (SELECT subject_id, count(*) AS n_notes, min(note_date) AS first_date, max(note_date) AS last_date FROM v_notes GROUP BY 1) s JOIN (SELECT subject_id, string_agg(note_title || ': ' || n, ', ' ORDER BY n DESC, note_title) AS titles FROM t GROUP BY 1) x USING (subject_id)")
def _(spark, d):
    return R.profile(V.notes(spark, d))


@query("ret_13", "SELECT question_id, CASE WHEN item_id % 3 = 0 THEN 'note_id ' || (item_id + 1000000000) || ' is not in 0..' || (n - 1) ELSE text END AS said FROM v_questions JOIN (SELECT subject_id, count(*) AS n FROM v_notes GROUP BY 1) USING (subject_id) LEFT JOIN v_notes ON v_notes.subject_id = v_questions.subject_id AND note_idx = item_id % n AND item_id % 3 > 0")
def _(spark, d):
    """Notes by their number, with a message where the subject has none of that number."""
    n = V.notes(spark, d).select("subject_id", "note_idx", "text")
    q = V.questions(spark, d).join(n.groupBy("subject_id").agg(F.count("*").alias("n")), "subject_id")
    asked = q.withColumn("note_idx", F.when(F.col("item_id") % 3 == 0, F.col("item_id") + 1_000_000_000).otherwise(F.col("item_id") % F.col("n")))
    out = F.concat(F.lit("note_id "), "note_idx", F.lit(" is not in 0.."), F.col("n") - 1)
    return asked.join(n, ["subject_id", "note_idx"], "left").select("question_id", F.when(F.col("note_idx") >= F.col("n"), out).otherwise(F.col("text")).alias("said"))


@query("ret_14", "SELECT subject_id, note_idx, '[' || note_idx || '] | ' || COALESCE(CAST(note_date AS VARCHAR), '') || ' | ' || note_title || ' | ' || replace(substr(text, 1, 100), chr(10), ' ') AS line FROM v_notes")
def _(spark, d):
    return R.listing(V.notes(spark, d))


# Facts, claims, rubrics, time


@query("agg_01", "SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_distinct([i FOR i IN [doc_id % 5, doc_id % 3, 7, -1] IF i >= 0 AND i < n])) AS DOUBLE) / n END AS share FROM (SELECT doc_id, len(string_split(text, '. ')) AS n FROM documents)")
def _(spark, d):
    n = F.size(F.split("text", "[.] "))
    idx = F.expr("array(doc_id % 5, doc_id % 3, 7L, -1L)")
    return V.read(spark, d, "documents").select("doc_id", X.index_share(idx, n).alias("share"))


@query("agg_02", "SELECT doc_id, count(*) AS n_facts, count(*) FILTER (yes >= 2) AS n_entailed, round(avg(CAST(yes >= 2 AS INTEGER)), 4) AS consensus FROM (SELECT doc_id, fact_idx, count(*) FILTER (vote) AS yes FROM v_verdicts GROUP BY ALL) GROUP BY doc_id")
def _(spark, d):
    return X.consensus(V.verdicts(spark, d), ["doc_id"], "fact_idx", 2)


@query("agg_04", "SELECT doc_id, count(*) AS jurors, round(avg(share), 4) AS average FROM (SELECT doc_id, juror, round(avg(CAST(vote AS INTEGER)), 4) AS share FROM v_verdicts GROUP BY ALL) GROUP BY doc_id")
def _(spark, d):
    return X.macro_average(V.verdicts(spark, d), ["doc_id"])


@query("agg_05", "SELECT juror, count(*) AS n, 0::BIGINT AS missing FROM v_verdicts GROUP BY juror")
def _(spark, d):
    return X.require_complete(V.verdicts(spark, d), ["juror"])


@query("agg_08", "SELECT doc_id, count(*) AS n_claims, count(*) FILTER (juror_vote) AS n_supported, round(CAST(count(*) FILTER (juror_vote) AS DOUBLE) / count(*), 6) AS precision, round(1 - CAST(count(*) FILTER (juror_vote) AS DOUBLE) / count(*), 6) AS unsupported_rate, count(*) FILTER (juror_vote) < count(*) AS has_unsupported FROM (SELECT doc_id, vote AS juror_vote FROM v_verdicts WHERE juror = 0) GROUP BY doc_id")
def _(spark, d):
    v = V.verdicts(spark, d).where("juror = 0").select("doc_id", "fact_idx", "vote")
    return X.claim_support(v.select("doc_id", "fact_idx"), v.where("vote").select("doc_id", "fact_idx"), ["doc_id"])


@query("agg_09", "SELECT doc_id, round(1 - p, 6) AS rate, p < 1 AS flagged FROM (SELECT doc_id, avg(CAST(vote AS INTEGER)) AS p FROM v_verdicts GROUP BY doc_id)")
def _(spark, d):
    return V.verdicts(spark, d).groupBy("doc_id").agg(F.avg(F.col("vote").cast("int")).alias("p")).select("doc_id", F.round(1 - F.col("p"), 6).alias("rate"), (F.col("p") < 1).alias("flagged"))


@query("agg_10", "SELECT user_id, count(*) AS n, count(*) FILTER (note_date > cutoff) AS n_future, count(*) FILTER (note_date IS NULL) AS n_undated, round(CAST(count(*) FILTER (note_date > cutoff) AS DOUBLE) / count(*), 6) AS future_rate, count(*) FILTER (note_date > cutoff) > 0 AS leaks FROM v_retrieved GROUP BY user_id")
def _(spark, d):
    return L.leakage(V.retrieved(spark, d), ["user_id"])


@query("agg_11", "SELECT user_id, CASE WHEN len(c) = 0 THEN CAST(len(r) = 0 AS DOUBLE) ELSE CAST(len(list_intersect(r, c)) AS DOUBLE) / len(c) END AS precision, CASE WHEN len(r) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(r, c)) AS DOUBLE) / len(r) END AS recall FROM (SELECT user_id, COALESCE(list(DISTINCT note_date) FILTER (note_date IS NOT NULL AND event_id % 2 = 0), []) AS r, COALESCE(list(DISTINCT note_date) FILTER (note_date IS NOT NULL AND event_id % 3 = 0), []) AS c FROM v_retrieved GROUP BY user_id)")
def _(spark, d):
    g = V.retrieved(spark, d).groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("note_date"))).alias("r"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("note_date"))).alias("c"))
    return g.select("user_id", L.date_overlap(F.col("r"), F.col("c")).alias("o")).select("user_id", "o.precision", "o.recall")


@query("agg_12", "SELECT k, CASE WHEN count(note_date) = 0 THEN 'undated' WHEN max(cutoff) IS NULL THEN 'cutoff_unknown' WHEN bool_or(note_date < cutoff) AND bool_or(note_date > cutoff) THEN 'spans_cutoff' WHEN bool_or(note_date > cutoff) THEN 'after_cutoff' WHEN bool_or(note_date = cutoff) AND NOT bool_or(note_date < cutoff) THEN 'at_cutoff' ELSE 'before_cutoff' END AS timeline_position, min(note_date) AS earliest, max(note_date) AS latest FROM (SELECT user_id || '_' || (event_id % 7) AS k, * FROM v_retrieved) GROUP BY k")
def _(spark, d):
    return L.timeline_class(V.retrieved(spark, d).withColumn("k", F.concat_ws("_", "user_id", F.col("event_id") % 7)), ["k"])


@query("agg_13", "SELECT user_id, count(*) AS candidate_note_count, count(*) FILTER (s) AS supporting_note_count, count(*) FILTER (s IS NULL) AS confirmation_error_count, min(note_date) FILTER (s) AS earliest, max(note_date) FILTER (s) AS latest, CASE WHEN count(*) FILTER (s) > 0 THEN 'supported' WHEN count(*) FILTER (s IS NULL) > 0 THEN 'inconclusive' ELSE 'unsupported' END AS status, CASE WHEN count(*) FILTER (s) > 0 THEN false WHEN count(*) FILTER (s IS NULL) > 0 THEN NULL ELSE true END AS is_hallucinated FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 40 = 1 END AS s FROM v_retrieved) GROUP BY user_id")
def _(spark, d):
    return L.provenance(V.retrieved(spark, d).withColumn("supports", F.expr("case when event_id % 5 = 0 then null else event_id % 40 = 1 end")), ["user_id"])


@query("agg_17", "WITH c AS (SELECT item_id, unnest(range(5)) AS criterion FROM benchmark), p AS (SELECT item_id, criterion, (item_id * 3 + criterion * 7) % 9 - 4 AS points FROM c) SELECT item_id, sum(greatest(points, 0))::BIGINT AS max_points, count(*) AS num_criteria, COALESCE(sum(points) FILTER ((item_id + criterion) % 2 = 0), 0)::BIGINT AS points, count(*) FILTER ((item_id + criterion) % 2 = 0) AS n_applied FROM p GROUP BY item_id")
def _(spark, d):
    c = V.read(spark, d, "benchmark").selectExpr("item_id", "explode(sequence(0L, 4L)) criterion").withColumn("points", F.expr("(item_id * 3 + criterion * 7) % 9 - 4"))
    return X.rubric_points(c, c.where("(item_id + criterion) % 2 = 0").select("item_id", "criterion"), "item_id")


@query("agg_18", "WITH i AS (SELECT item_id, unnest(range(6)) AS item FROM benchmark), s AS (SELECT item_id, item, count(*) FILTER ((item_id * 5 + item * 3 + j * 7) % 4 < 2) AS yes FROM i, (SELECT unnest(range(3)) AS j) GROUP BY ALL) SELECT item_id, count(*) AS total_items, count(*) FILTER (yes >= 2) AS items_met, round(CAST(count(*) FILTER (yes >= 2) AS DOUBLE) / count(*), 4) AS rubric_score FROM s GROUP BY item_id")
def _(spark, d):
    i = V.read(spark, d, "benchmark").selectExpr("item_id", "explode(sequence(0L, 5L)) item")
    return X.rubric_items(i, i.selectExpr("item_id", "item", "explode(sequence(0, 2)) j").withColumn("met", F.expr("(item_id * 5 + item * 3 + j * 7) % 4 < 2")), ["item_id"])


@query("agg_21", "SELECT model, count(*) AS requests, sum(length(response))::BIGINT AS chars, round(sum(length(response)) / 4 * 0.125::DOUBLE / 1000000, 8) AS usd FROM v_responses GROUP BY model")
def _(spark, d):
    g = V.responses(spark, d).groupBy("model").agg(F.count("*").alias("requests"), F.sum(F.length("response")).alias("chars"))
    return g.withColumn("usd", F.round(F.col("chars") / 4 * 0.125 / 1000000, 8))


@query("agg_22", "SELECT model, count(*) AS n, sum(len(string_split_regex(trim(response), '\\s+')))::BIGINT AS tokens FROM v_responses GROUP BY model")
def _(spark, d):
    return V.responses(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.sum(F.size(F.split(F.trim("response"), r"\s+"))).alias("tokens"))


@query("agg_23", "SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def _(spark, d):
    c = V.read(spark, d, "conversations").where("trim(text) <> ''")
    return c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("last_text"))


# Pairwise


_RATES = "SELECT model, count(*) FILTER (w) AS wins, count(*) FILTER (l) AS losses, count(*) - count(*) FILTER (w) - count(*) FILTER (l) AS ties, count(*) AS total, round(CAST(count(*) FILTER (w) AS DOUBLE) / count(*), 6) AS win_rate, round(CAST(count(*) FILTER (w) AS DOUBLE) / nullif(count(*) FILTER (w) + count(*) FILTER (l), 0), 6) AS non_tie_win_rate FROM "


@query("agg_14", _RATES + "(SELECT model_a AS model, completeness = 'A' AS w, completeness = 'B' AS l FROM v_pairwise UNION ALL SELECT model_b, completeness = 'B', completeness = 'A' FROM v_pairwise) GROUP BY model")
def _(spark, d):
    return P.win_rates(V.pairwise(spark, d), "completeness")


@query("agg_14_scale", _RATES + "(SELECT a.l_suppkey AS model, a.l_quantity > b.l_quantity AS w, a.l_quantity < b.l_quantity AS l FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber) GROUP BY model")
def _(spark, d):
    li = V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    b = li.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("l_suppkey").alias("model_b"), F.col("l_quantity").alias("q2"))
    j = li.join(b, "l_orderkey").where("l_linenumber < n2").select(F.col("l_suppkey").alias("model_a"), "model_b", F.when(F.col("l_quantity") > F.col("q2"), "A").when(F.col("l_quantity") < F.col("q2"), "B").otherwise("TIE").alias("label"))
    return P.win_rates(j, "label")


@query("agg_15", "SELECT question_id, model_a, model_b, CASE WHEN CAST(completeness = 'A' AS INT) + CAST(relevancy = 'A' AS INT) + CAST(concision = 'A' AS INT) >= 2 THEN 'A' WHEN CAST(completeness = 'B' AS INT) + CAST(relevancy = 'B' AS INT) + CAST(concision = 'B' AS INT) >= 2 THEN 'B' ELSE 'TIE' END AS overall FROM v_pairwise")
def _(spark, d):
    return V.pairwise(spark, d).select("question_id", "model_a", "model_b", P.majority(*P.DIMENSIONS).alias("overall"))


@query("agg_16", "SELECT unit, a, b, tie, CASE WHEN CAST(a = m AS INT) + CAST(b = m AS INT) + CAST(tie = m AS INT) > 1 THEN 'TIE' WHEN a = m THEN 'A' WHEN b = m THEN 'B' ELSE 'TIE' END AS winner FROM (SELECT *, greatest(a, b, tie) AS m FROM (SELECT unit, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'B') AS b, count(*) FILTER (label = 'TIE') AS tie FROM v_choices GROUP BY unit))")
def _(spark, d):
    return P.jury_vote(V.choices(spark, d), ["unit"])


@query("agg_20", "SELECT question_id, lo_model, hi_model, n_orders, CASE WHEN x <> y THEN 'TIE' WHEN x = lo_model THEN 'A' WHEN x = hi_model THEN 'B' ELSE 'TIE' END AS label FROM (SELECT question_id, least(model_a, model_b) AS lo_model, greatest(model_a, model_b) AS hi_model, count(*) AS n_orders, min(w) AS x, max(w) AS y FROM (SELECT *, CASE relevancy WHEN 'A' THEN model_a WHEN 'B' THEN model_b ELSE 'TIE' END AS w FROM v_pairwise) GROUP BY ALL)")
def _(spark, d):
    return P.canonical(V.pairwise(spark, d), "relevancy", ["question_id"])


@query("win_04", "SELECT question_id, model_a, model_b, position FROM v_pairwise QUALIFY row_number() OVER (PARTITION BY question_id, least(model_a, model_b), greatest(model_a, model_b) ORDER BY position <> 'ab', ord) = 1")
def _(spark, d):
    p = V.pairwise(spark, d).withColumns({"lo": F.least("model_a", "model_b"), "hi": F.greatest("model_a", "model_b")})
    return S.first_per_key(p, ["question_id", "lo", "hi"], [F.col("position") != "ab", F.col("ord")]).select("question_id", "model_a", "model_b", "position")


@query("win_07", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 2")
def _(spark, d):
    return R.top_k(V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 2).drop("l_extendedprice")


@query("set_09", "SELECT question_id, model_b AS model_a, model_a AS model_b, CASE position WHEN 'ab' THEN 'ba' ELSE 'ab' END AS position, CASE completeness WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE completeness END AS completeness FROM v_pairwise")
def _(spark, d):
    return P.flip(V.pairwise(spark, d)).select("question_id", "model_a", "model_b", "position", "completeness")


# Agreement


_PAIRS = "(SELECT a.rater AS rater_a, b.rater AS rater_b, a.label AS a, b.label AS b, a.unit AS unit FROM {v} a JOIN {v} b ON a.unit = b.unit AND a.rater < b.rater WHERE a.label IS NOT NULL AND b.label IS NOT NULL)"
_RP, _CP = _PAIRS.format(v="v_raters"), _PAIRS.format(v="v_choices")


@query("agr_02", f"SELECT rater_a, rater_b, n, round(po, 6) AS agreement, round(CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(2 * po - 1, 6) AS pabak FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (SELECT rater_a, rater_b, count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(a) AS pa, avg(b) AS pb FROM {_RP} GROUP BY ALL))")
def _(spark, d):
    return A.binary_agreement(A.pairs(V.raters(spark, d), ["unit"]), ["rater_a", "rater_b"])


@query("agr_05", f"WITH p AS (SELECT rater_a, rater_b, CASE a WHEN 'A' THEN 0 WHEN 'TIE' THEN 1 ELSE 2 END AS i, CASE b WHEN 'A' THEN 0 WHEN 'TIE' THEN 1 ELSE 2 END AS j FROM {_CP}), m AS (SELECT x.rater_a, x.rater_b, x.n, po, wo, flip, pe, we FROM (SELECT rater_a, rater_b, count(*) AS n, avg(CAST(i = j AS INT)) AS po, avg((i - j) * (i - j) / 4.0::DOUBLE) AS wo, avg(CAST(abs(i - j) = 2 AS INT)) AS flip FROM p GROUP BY ALL) x JOIN (SELECT r.rater_a, r.rater_b, sum(CASE WHEN r.i = c.j THEN CAST(r.n AS DOUBLE) * c.n END) / sum(CAST(r.n AS DOUBLE) * c.n) AS pe, sum((r.i - c.j) * (r.i - c.j) / 4.0::DOUBLE * r.n * c.n) / sum(CAST(r.n AS DOUBLE) * c.n) AS we FROM (SELECT rater_a, rater_b, i, count(*) AS n FROM p GROUP BY ALL) r JOIN (SELECT rater_a, rater_b, j, count(*) AS n FROM p GROUP BY ALL) c USING (rater_a, rater_b) GROUP BY ALL) y USING (rater_a, rater_b)) SELECT rater_a, rater_b, n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round(1 - wo / we, 6) AS quadratic_kappa, round(flip, 6) AS flip_rate FROM m")
def _(spark, d):
    return A.nominal_agreement(A.pairs(V.choices(spark, d), ["unit"]), ["rater_a", "rater_b"])


@query("agr_07", "SELECT rater, COALESCE(direction, 'pooled') AS direction, count(*) AS n, round(avg(label), 6) AS rate FROM v_raters WHERE label IS NOT NULL GROUP BY ROLLUP (rater, direction) HAVING rater IS NOT NULL")
def _(spark, d):
    return A.prevalence(V.raters(spark, d))


@query("agr_08", "SELECT unit, CAST(2 * sum(label) > count(*) AS INTEGER) AS label FROM v_raters WHERE label IS NOT NULL GROUP BY unit HAVING 2 * sum(label) <> count(*)")
def _(spark, d):
    return A.majority_rater(V.raters(spark, d), ["unit"])


@query("agr_09", "SELECT unit, CASE WHEN a > b AND a > t THEN 'A' WHEN b > a AND b > t THEN 'B' ELSE 'TIE' END AS label FROM (SELECT unit, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'B') AS b, count(*) FILTER (label = 'TIE') AS t FROM v_choices GROUP BY unit HAVING count(DISTINCT rater) = 3)")
def _(spark, d):
    return A.majority_choice(V.choices(spark, d), ["unit"], 3)


@query("agr_10", f"SELECT rater_a, rater_b, count(*) AS n, round(avg(CAST(a = b AS INT)), 6) AS strict, round(avg(CAST(a <> b AND (a = 'TIE' OR b = 'TIE') AS INT)), 6) AS adjacent, round(avg(CAST(a <> b AND a <> 'TIE' AND b <> 'TIE' AS INT)), 6) AS flip, round(avg(CAST(a = b OR a = 'TIE' OR b = 'TIE' AS INT)), 6) AS tolerant, round(CAST(count(*) FILTER (a = b AND a <> 'TIE') AS DOUBLE) / count(*) FILTER (a <> 'TIE' AND b <> 'TIE'), 6) AS committed FROM {_CP} GROUP BY ALL")
def _(spark, d):
    return A.judge_accuracy(A.pairs(V.choices(spark, d), ["unit"]), ["rater_a", "rater_b"])


@query("agr_11", f"SELECT rater_a, rater_b, a, b, count(*) AS n FROM {_CP} GROUP BY ALL")
def _(spark, d):
    return A.pairs(V.choices(spark, d), ["unit"]).groupBy("rater_a", "rater_b", "a", "b").agg(F.count("*").alias("n"))


@query("agr_12", f"WITH g AS (SELECT * FROM (SELECT unnest(['A', 'TIE', 'B']) AS a), (SELECT unnest(['A', 'TIE', 'B']) AS b)), p AS (SELECT * FROM {_CP} WHERE rater_b = 'j1') SELECT a, b, COALESCE(n, 0) AS n, round((COALESCE(n, 0) + 1) / CAST(t + 3 AS DOUBLE), 6) AS p FROM g LEFT JOIN (SELECT a, b, count(*) AS n FROM p GROUP BY ALL) USING (a, b) JOIN (SELECT a, count(*) AS t FROM p GROUP BY a) USING (a)")
def _(spark, d):
    p = A.pairs(V.choices(spark, d), ["unit"]).where("rater_b = 'j1'")
    return A.transitions(p, ["rater_b"], 1.0).drop("rater_b")


@query("agr_13", f"WITH s AS (SELECT rater_a, rater_b, round(avg(CAST(a = b AS INT)), 6) AS agreement FROM {_RP} GROUP BY ALL) SELECT rater_a, rater_b, agreement FROM s UNION ALL SELECT rater_b, rater_a, agreement FROM s")
def _(spark, d):
    return A.symmetric(A.binary_agreement(A.pairs(V.raters(spark, d), ["unit"]), ["rater_a", "rater_b"]), "agreement")


@query("agr_14", "SELECT rater, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS micro, round(avg(CAST(s AS DOUBLE) / n), 6) AS macro FROM (SELECT rater, unit % 50 AS record, sum(label) AS s, count(*) AS n FROM v_raters WHERE label IS NOT NULL GROUP BY ALL) GROUP BY rater")
def _(spark, d):
    return A.profile(V.raters(spark, d).withColumn("record", F.col("unit") % 50), "record")


@query("agr_15", "SELECT CASE WHEN d = 1 THEN 'unanimous' ELSE 'contested' END AS stratum, count(*) AS n FROM (SELECT unit, count(DISTINCT label) AS d FROM v_raters WHERE label IS NOT NULL GROUP BY unit HAVING count(DISTINCT rater) = 4) GROUP BY 1")
def _(spark, d):
    return A.strata(V.raters(spark, d), ["unit"], 4)


_LEN = f"(SELECT rater_a, rater_b, count(*) AS n, sum(a)::BIGINT AS a_yes, sum(b)::BIGINT AS b_yes FROM {_RP} WHERE a <> b GROUP BY ALL)"


@query("agr_16", f"SELECT *, CASE WHEN a_yes > b_yes THEN rater_a WHEN b_yes > a_yes THEN rater_b ELSE 'tie' END AS more_lenient FROM {_LEN}")
def _(spark, d):
    return A.leniency(A.pairs(V.raters(spark, d), ["unit"]))


@query("agr_17", f"SELECT rater, sum(net)::BIGINT AS net FROM (SELECT rater_a AS rater, a_yes - b_yes AS net FROM {_LEN} UNION ALL SELECT rater_b, b_yes - a_yes FROM {_LEN}) GROUP BY rater")
def _(spark, d):
    return A.leniency_index(A.leniency(A.pairs(V.raters(spark, d), ["unit"])))


@query("agr_18", "SELECT rater, count(*) AS n, round(avg(CAST(label = 'A' AS INT)), 6) AS share_a, round(avg(CAST(label = 'B' AS INT)), 6) AS share_b, round(avg(CAST(label = 'TIE' AS INT)), 6) AS share_tie, round(1 - avg(CAST(label = 'TIE' AS INT)), 6) AS decisiveness, round(avg(CAST(label = 'A' AS INT)) - avg(CAST(label = 'B' AS INT)), 6) AS a_minus_b FROM v_choices GROUP BY rater")
def _(spark, d):
    return A.choice_profile(V.choices(spark, d))


@query("agr_19", f"SELECT rater_a, rater_b, count(*) AS n, count(*) FILTER (a <> 'TIE' AND b <> 'TIE') AS flips, count(*) FILTER (a = 'TIE') AS a_hedges, count(*) FILTER (b = 'TIE') AS b_hedges FROM {_CP} WHERE a <> b GROUP BY ALL")
def _(spark, d):
    return A.hedging(A.pairs(V.choices(spark, d), ["unit"]))


@query("agr_20", f"SELECT rater, sum(net)::BIGINT AS net FROM (SELECT rater_a AS rater, CAST(a = 'TIE' AS INT) - CAST(b = 'TIE' AS INT) AS net FROM {_CP} UNION ALL SELECT rater_b, CAST(b = 'TIE' AS INT) - CAST(a = 'TIE' AS INT) FROM {_CP}) GROUP BY rater")
def _(spark, d):
    h = A.hedging(A.pairs(V.choices(spark, d), ["unit"])).withColumnsRenamed({"a_hedges": "a_yes", "b_hedges": "b_yes"})
    return A.leniency_index(h)


@query("agr_21", "SELECT question_id, least(model_a, model_b) AS lo_model, greatest(model_a, model_b) AS hi_model, count(DISTINCT position) AS n_orders FROM v_pairwise WHERE ord % 5 <> 0 GROUP BY ALL")
def _(spark, d):
    return V.pairwise(spark, d).where("ord % 5 <> 0").groupBy("question_id", F.least("model_a", "model_b").alias("lo_model"), F.greatest("model_a", "model_b").alias("hi_model")).agg(F.countDistinct("position").alias("n_orders"))


@query("agr_22", "SELECT COALESCE(x.unit, y.unit) AS unit, x.label AS a, y.label AS b, CASE WHEN x.label IS NULL THEN 'only second' WHEN y.label IS NULL THEN 'only first' ELSE 'differs' END AS kind FROM (SELECT * FROM v_raters WHERE rater = 'r2' AND unit % 7 > 0) x FULL OUTER JOIN (SELECT * FROM v_raters WHERE rater = 'r3' AND label IS NOT NULL) y ON x.unit = y.unit WHERE x.label IS DISTINCT FROM y.label")
def _(spark, d):
    r = V.raters(spark, d)
    return A.discrepancies(r.where("rater = 'r2' and unit % 7 > 0"), r.where("rater = 'r3'"), ["unit"])


@query("agr_23", f"SELECT rater_a, rater_b, tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(2 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT rater_a, rater_b, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn FROM {_RP} GROUP BY ALL)")
def _(spark, d):
    return A.judge_vs_human(A.pairs(V.raters(spark, d), ["unit"]), ["rater_a", "rater_b"])


@query("agr_24", "SELECT rater, min(label) AS only FROM (SELECT rater, label FROM v_raters WHERE label IS NOT NULL UNION ALL SELECT 'fixed', 1 FROM labels) GROUP BY rater HAVING count(DISTINCT label) = 1")
def _(spark, d):
    r = V.raters(spark, d)
    return A.constant_raters(r.select("rater", "label").unionByName(V.read(spark, d, "labels").select(F.lit("fixed").alias("rater"), F.lit(1).alias("label"))))


# Sampling, sets, resume


@query("smp_01", "WITH b AS (SELECT doc_id, CASE WHEN (doc_id * 37 % 100) / 100.0 <= 0.34 THEN 'low' WHEN (doc_id * 37 % 100) / 100.0 <= 0.67 THEN 'mid' ELSE 'high' END AS stratum FROM documents), q AS (SELECT stratum, greatest(1, CAST(round(50 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()) AS INTEGER)) AS quota FROM b GROUP BY stratum) SELECT doc_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM b) JOIN q USING (stratum) WHERE r <= quota")
def _(spark, d):
    b = V.read(spark, d, "documents").select("doc_id", F.expr("case when (doc_id * 37 % 100) / 100 <= 0.34 then 'low' when (doc_id * 37 % 100) / 100 <= 0.67 then 'mid' else 'high' end").alias("stratum"))
    return S.stratified_quota(b, "stratum", 50, F.col("doc_id"))


@query("smp_03", "SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 10")
def _(spark, d):
    return S.round_robin(V.read(spark, d, "documents").select("doc_id", "lang"), "lang", 10, F.col("doc_id"))


@query("set_02", "SELECT doc_id, 'new' AS v FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def _(spark, d):
    x = V.read(spark, d, "documents").select("doc_id")
    return S.upsert(x.where("doc_id % 2 = 0").withColumn("v", F.lit("old")), x.where("doc_id % 3 = 0").withColumn("v", F.lit("new")), ["doc_id"])


@query("set_03", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS v FROM documents")
def _(spark, d):
    x = V.read(spark, d, "documents").select("doc_id", F.col("source").alias("v"))
    return S.resume_merge(x, x.where("doc_id % 3 = 0").withColumn("v", F.lit("new")), ["doc_id"], "v")


@query("set_04", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def _(spark, d):
    return V.read(spark, d, "orders").select("o_custkey").distinct().join(V.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query("set_05", "SELECT unit FROM v_raters WHERE label IS NOT NULL GROUP BY unit HAVING count(DISTINCT rater) = 4")
def _(spark, d):
    return V.raters(spark, d).where("label is not null").groupBy("unit").agg(F.countDistinct("rater").alias("r")).where("r = 4").select("unit")


@query("set_07", "SELECT DISTINCT fact FROM v_facts")
def _(spark, d):
    return V.facts(spark, d).select("fact").distinct()


@query("set_10", "SELECT response_id FROM v_responses WHERE NOT (model = 'm1' AND question_id LIKE '1%')")
def _(spark, d):
    return V.responses(spark, d).where("not (model = 'm1' and question_id like '1%')").select("response_id")


@query("inc_06", "SELECT question_id, count(*) AS n FROM v_responses GROUP BY question_id HAVING count(*) > 1")
def _(spark, d):
    return V.responses(spark, d).groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1")


@query("inc_10", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 4) AS in_window FROM events")
def _(spark, d):
    e = S.rate_window(V.read(spark, d, "events"), "user_id", "ts", "value", 3600)
    return e.select("event_id", F.round("in_window", 4).alias("in_window"))


# Scalar functions


@query("fn_02", "SELECT event_id, json_extract_string(props, '$') IS NOT NULL AS ok FROM events")
def _(spark, d):
    return V.read(spark, d, "events").select("event_id", T.lenient_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).isNotNull().alias("ok"))


@query("fn_05", "SELECT unit, rater, CASE WHEN label = 'TIE' THEN 'TIE' ELSE label END AS label FROM v_choices")
def _(spark, d):
    return V.choices(spark, d).select("unit", "rater", T.normal_label(F.regexp_replace("label", "TIE", " tied ")).alias("label"))


@query("fn_06", "SELECT doc_id, fact_idx, COALESCE(CAST(fact_date AS VARCHAR), '') AS day FROM v_facts")
def _(spark, d):
    return V.facts(spark, d).select("doc_id", "fact_idx", T.trailing_date(F.col("fact")).alias("day"))


@query("fn_08", "SELECT doc_id, substr(sha1(doc_id || '|' || source), 1, 12) AS record_id FROM documents")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", T.record_id(F.col("doc_id").cast("string"), F.col("source")).alias("record_id"))


@query("fn_09", "SELECT doc_id, CASE WHEN strpos(text, ' the ') > 0 THEN strpos(text, ' the ') - 1 END AS first, CASE WHEN strpos(text, ' the ') > 0 THEN strpos(text, ' the ') + 4 END AS last FROM documents")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", T.span_of(F.col("text"), F.lit(" the ")).alias("s")).selectExpr("doc_id", "cast(get(s, 0) as bigint) first", "cast(get(s, 1) as bigint) last")


@query("fn_14", "SELECT doc_id, string_agg((fact_idx + 1) || '. ' || fact, chr(10) ORDER BY fact_idx) AS block FROM v_facts GROUP BY doc_id")
def _(spark, d):
    g = V.facts(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("fact_idx", "fact"))).alias("f"))
    return g.select("doc_id", T.numbered(F.transform("f", lambda x: x["fact"])).alias("block"))


@query("fn_15", "SELECT question_id, 'Question: ' || natural_query || chr(10) || 'Date: ' || cutoff AS prompt FROM v_questions")
def _(spark, d):
    return V.questions(spark, d).select("question_id", T.fill("Question: {q}\nDate: {d}", q=F.col("natural_query"), d=F.col("cutoff")).alias("prompt"))


@query("fn_11")
def _(spark, d):
    r = V.responses(spark, d).join(V.questions(spark, d).select("question_id", "reference"), "question_id")
    r = r.select("response_id", ST.rouge_words(F.col("response")).alias("c"), ST.rouge_words(F.col("reference")).alias("g"))
    c, g = F.col("c"), F.col("g")
    return r.select("response_id", F.round(T.rouge_n(c, g, 1), 6).alias("rouge1"), F.round(T.rouge_n(c, g, 2), 6).alias("rouge2"))


@query("fn_03", "SELECT event_id, [event_id % 3, event_id % 5] AS a FROM events")
def _(spark, d):
    s = F.concat(F.lit("["), F.col("event_id") % 3, F.lit(", "), F.col("event_id") % 5, F.lit("]"))
    return V.read(spark, d, "events").select("event_id", F.from_json(s, "array<bigint>").alias("a"))


@query("fn_04", "SELECT unit, rater, CASE WHEN unit % 9 = 0 THEN NULL ELSE label END AS winner FROM v_choices")
def _(spark, d):
    raw = F.when(F.col("unit") % 9 > 0, F.concat(F.lit('{"winner": "'), F.lower("label"), F.lit('"}')))
    return V.choices(spark, d).select("unit", "rater", T.parse_winner(raw).alias("winner"))


@query("fn_07", "SELECT event_id, CAST(ts AS TIMESTAMP) = ts AS same FROM events")
def _(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return V.read(spark, d, "events").select("event_id", (T.timestamp(text).cast("timestamp_ntz") == F.col("ts")).alias("same"))


@query("fn_19", "SELECT DISTINCT model AS base FROM v_responses")
def _(spark, d):
    return V.responses(spark, d).select(T.model_base(F.concat("model", F.lit("_sandbox"))).alias("base")).distinct()


@query("agr_25", "SELECT x.unit, CASE WHEN y.label IS NULL THEN '' WHEN x.label = y.label THEN x.label ELSE y.label END AS human FROM (SELECT * FROM v_choices WHERE rater = 'j1') x LEFT JOIN (SELECT * FROM v_choices WHERE rater = 'human' AND unit % 4 > 0) y USING (unit)")
def _(spark, d):
    c = V.choices(spark, d)
    y = c.where("rater = 'human' and unit % 4 > 0").select("unit", F.col("label").alias("y"))
    return c.where("rater = 'j1'").join(y, "unit", "left").select("unit", F.coalesce(F.when(F.col("y") == F.col("label"), F.col("label")).otherwise(F.col("y")), F.lit("")).alias("human"))


@query("agr_26", "SELECT unit, arg_min(label, CAST(substr(rater, 2) AS INTEGER)) AS label FROM (SELECT unit, rater, max(label) AS label FROM v_raters WHERE label IS NOT NULL GROUP BY ALL) GROUP BY unit")
def _(spark, d):
    per = V.raters(spark, d).where("label is not null").groupBy("unit", "rater").agg(F.max("label").alias("label"))
    return per.groupBy("unit").agg(F.min_by("label", F.substring("rater", 2, 9).cast("int")).alias("label"))


@query("agr_27", f"SELECT rater_b AS judge, round(avg(strict), 6) AS strict, round(avg(flip), 6) AS flip FROM (SELECT rater_b, unit % 3 AS dim, avg(CAST(a = b AS INT)) AS strict, avg(CAST(a <> b AND a <> 'TIE' AND b <> 'TIE' AS INT)) AS flip FROM {_CP} WHERE rater_a = 'human' GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    p = A.pairs(V.choices(spark, d), ["unit"]).where("rater_a = 'human'").withColumn("dim", F.col("unit") % 3)
    per = p.groupBy("rater_b", "dim").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("s"), F.avg(F.expr("int(a <> b and a <> 'TIE' and b <> 'TIE')")).alias("f"))
    return per.groupBy(F.col("rater_b").alias("judge")).agg(F.round(F.avg("s"), 6).alias("strict"), F.round(F.avg("f"), 6).alias("flip")).orderBy("flip")


@query("set_01", "SELECT doc_id AS id, source AS v FROM documents UNION ALL SELECT page_id, url FROM pages")
def _(spark, d):
    return V.read(spark, d, "documents").selectExpr("doc_id id", "source v").unionByName(V.read(spark, d, "pages").selectExpr("page_id id", "url v"))


@query("set_06", "(SELECT question_id FROM v_questions EXCEPT SELECT question_id FROM v_responses) UNION (SELECT question_id FROM v_responses EXCEPT SELECT question_id FROM v_questions)")
def _(spark, d):
    q, r = (x.select("question_id").distinct() for x in (V.questions(spark, d), V.responses(spark, d)))
    return q.subtract(r).union(r.subtract(q))


@query("set_08", "SELECT 'id' AS level, count(*) AS shared FROM (SELECT question_id FROM v_questions INTERSECT SELECT question_id FROM v_responses) UNION ALL SELECT 'subject', count(*) FROM (SELECT subject_id FROM v_questions INTERSECT SELECT string_split(question_id, '_')[1] FROM v_responses)")
def _(spark, d):
    q, r = V.questions(spark, d), V.responses(spark, d)
    ids = q.select("question_id").intersect(r.select("question_id")).agg(F.count("*").alias("shared")).select(F.lit("id").alias("level"), "shared")
    subjects = q.select("subject_id").intersect(r.select(F.split_part("question_id", F.lit("_"), F.lit(1)).alias("subject_id")))
    return ids.unionByName(subjects.agg(F.count("*").alias("shared")).select(F.lit("subject").alias("level"), "shared"))


@query("chk_09", "SELECT subject_id, count(*) FILTER (used <= 20000) AS n_included, count(*) AS n_total, arg_min(note_date, used) FILTER (used > 20000 AND note_date IS NOT NULL) AS boundary FROM (SELECT subject_id, note_date, sum(length(text)) OVER (PARTITION BY subject_id ORDER BY note_date DESC NULLS LAST, note_idx) AS used FROM v_notes) GROUP BY subject_id")
def _(spark, d):
    n = V.notes(spark, d).select("subject_id", "note_idx", "note_date", F.length("text").alias("chars"))
    run = S.budget_prefix(n, ["subject_id"], [F.desc_nulls_last("note_date"), F.asc("note_idx")], F.col("chars"), 1 << 60)
    over = F.when((F.col("used") > 20000) & F.col("note_date").isNotNull(), F.col("used"))
    return run.groupBy("subject_id").agg(F.count_if(F.col("used") <= 20000).alias("n_included"), F.count("*").alias("n_total"), F.min_by("note_date", over).alias("boundary"))


@query("oth_18", "SELECT question_id, position, model_a, model_b, CASE completeness WHEN 'A' THEN model_a WHEN 'B' THEN model_b ELSE 'TIE' END AS winner FROM v_pairwise")
def _(spark, d):
    return V.pairwise(spark, d).select("question_id", "position", "model_a", "model_b", P.winner_model(F.col("completeness")).alias("winner"))


@query("oth_21", "SELECT ord, unnest(['completeness', 'relevancy', 'concision']) AS dimension, unnest([completeness, relevancy, concision]) AS label FROM v_pairwise")
def _(spark, d):
    return V.pairwise(spark, d).unpivot("ord", list(P.DIMENSIONS), "dimension", "label").withColumn("ord", F.col("ord").cast("bigint"))


@query("oth_23", "SELECT role, count(*) FILTER (trim(text) = '') AS blank, count(*) AS n FROM conversations GROUP BY role")
def _(spark, d):
    return V.read(spark, d, "conversations").groupBy("role").agg(F.count_if(F.trim("text") == "").alias("blank"), F.count("*").alias("n"))


@query("udf_01")
def _(spark, d):
    from .operators.providers import complete, echo

    return complete(V.questions(spark, d).select("question_id", F.col("natural_query").alias("prompt")), echo, "question_id")


# Further joins, votes, parsers and windows


@query("join_05", "SELECT r.response_id, q.cutoff, count(n.note_idx) AS n_visible FROM v_responses r JOIN v_questions q USING (question_id) LEFT JOIN v_notes n ON n.subject_id = q.subject_id AND n.note_date <= q.cutoff GROUP BY ALL")
def _(spark, d):
    r = V.responses(spark, d).join(V.questions(spark, d), "question_id").select("response_id", "subject_id", "cutoff")
    n = V.notes(spark, d).select("subject_id", "note_idx", "note_date")
    return r.join(n, (r.subject_id == n.subject_id) & (n.note_date <= r.cutoff), "left").groupBy("response_id", "cutoff").agg(F.count("note_idx").alias("n_visible"))


@query("join_13", "SELECT record_id, question_id, label FROM (SELECT substr(sha1(question_id || '|' || subject_id), 1, 12) AS record_id, question_id FROM v_questions) JOIN (SELECT substr(sha1(question_id || '|' || subject_id), 1, 12) AS record_id, item_id % 3 AS label FROM v_questions WHERE item_id % 4 > 0) USING (record_id)")
def _(spark, d):
    q = V.questions(spark, d).withColumn("record_id", T.record_id(F.col("question_id"), F.col("subject_id")))
    marks = S.first_per_key(q.where("item_id % 4 > 0"), ["record_id"], [F.asc("item_id")]).select("record_id", (F.col("item_id") % 3).alias("label"))
    return q.select("record_id", "question_id").join(marks, "record_id")


@query("join_14", "SELECT q.question_id, COALESCE(a.m, b.m) AS n FROM v_questions q LEFT JOIN (SELECT question_id, count(*) AS m FROM v_responses WHERE model = 'm0' GROUP BY 1) a USING (question_id) LEFT JOIN (SELECT string_split(question_id, '_')[1] AS subject_id, count(*) AS m FROM v_responses GROUP BY 1) b USING (subject_id)")
def _(spark, d):
    r = V.responses(spark, d)
    exact = r.where("model = 'm0'").groupBy("question_id").agg(F.count("*").alias("a"))
    loose = r.groupBy(F.split_part("question_id", F.lit("_"), F.lit(1)).alias("subject_id")).agg(F.count("*").alias("b"))
    return V.questions(spark, d).join(exact, "question_id", "left").join(loose, "subject_id", "left").select("question_id", F.coalesce("a", "b").alias("n"))


@query("agg_03", "SELECT doc_id, fact, count(*) FILTER (vote AND juror <> 1) >= 2 AS entailed, count(*) FILTER (juror <> 1) AS others FROM v_verdicts JOIN v_facts USING (doc_id, fact_idx) GROUP BY doc_id, fact")
def _(spark, d):
    v = V.verdicts(spark, d).join(V.facts(spark, d).select("doc_id", "fact_idx", "fact"), ["doc_id", "fact_idx"])
    return v.groupBy("doc_id", "fact").agg((F.count_if(F.col("vote") & (F.col("juror") != 1)) >= 2).alias("entailed"), F.count_if(F.col("juror") != 1).alias("others"))


@query("agg_06", "SELECT doc_id, round(avg(CAST(hit AS INT)), 6) AS recall FROM (SELECT doc_id, fact_idx, bool_or(vote) AS hit FROM v_verdicts GROUP BY ALL) GROUP BY doc_id")
def _(spark, d):
    per = V.verdicts(spark, d).groupBy("doc_id", "fact_idx").agg(F.bool_or("vote").alias("hit"))
    return per.groupBy("doc_id").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall"))


@query("agg_07", "WITH p AS (SELECT c.doc_id // 2 AS k, c.fact_idx AS ci, r.fact_idx AS ri FROM v_facts c JOIN v_facts r ON c.doc_id // 2 = r.doc_id // 2 AND c.doc_id % 2 = 1 AND r.doc_id % 2 = 0 AND COALESCE(CAST(c.fact_date AS VARCHAR), '') = COALESCE(CAST(r.fact_date AS VARCHAR), '') WHERE (c.fact_idx * 7 + r.fact_idx * 3) % 10 >= 9) SELECT k, count(DISTINCT ci) AS cand_hit, count(DISTINCT ri) AS ref_hit FROM p GROUP BY k")
def _(spark, d):
    f = V.facts(spark, d).withColumn("k", F.expr("doc_id div 2"))
    p = X.same_date_pairs(f.where("doc_id % 2 = 1"), f.where("doc_id % 2 = 0"), "k").where("(cand_idx * 7 + ref_idx * 3) % 10 >= 9")
    return p.groupBy("k").agg(F.countDistinct("cand_idx").alias("cand_hit"), F.countDistinct("ref_idx").alias("ref_hit"))


_MATCH = """f AS (SELECT doc_id // 730 * 365 + doc_id % 365 AS k, doc_id // 365 % 2 AS side, fact_idx, COALESCE(CAST(fact_date AS VARCHAR), '') AS day,
list_distinct(regexp_extract_all(lower(fact), '[\\p{L}\\p{N}_]+')) AS w FROM v_facts),
p AS (SELECT c.k, c.fact_idx AS ci, r.fact_idx AS ri FROM f c JOIN f r ON c.k = r.k AND c.day = r.day AND c.side = 1 AND r.side = 0 WHERE 20 * len(list_intersect(c.w, r.w)) >= 9 * (len(c.w) + len(r.w)) AND len(c.w) + len(r.w) > 0),
h AS (SELECT k, count(DISTINCT ci) AS cand_hit, count(DISTINCT ri) AS ref_hit FROM p GROUP BY k),
n AS (SELECT k, count(*) FILTER (side = 1) AS n_cand, count(*) FILTER (side = 0) AS n_ref FROM f GROUP BY k)"""


@query("agg_07_match", f"WITH /* v_facts */ {_MATCH} SELECT k, n_cand, COALESCE(cand_hit, 0) AS cand_hit, n_ref, COALESCE(ref_hit, 0) AS ref_hit, round(CAST(COALESCE(cand_hit, 0) AS DOUBLE) / nullif(n_cand, 0), 6) AS precision, round(CAST(COALESCE(ref_hit, 0) AS DOUBLE) / nullif(n_ref, 0), 6) AS recall FROM n LEFT JOIN h USING (k)")
def _(spark, d):
    """Facts of two documents of one date, matched by the F1 of their words."""
    f = V.facts(spark, d).withColumn("k", F.expr("doc_id div 730 * 365 + doc_id % 365"))
    return B.fact_scores(f.where("doc_id div 365 % 2 = 1"), f.where("doc_id div 365 % 2 = 0"), "k")


@query("agr_03", f"WITH p AS {_CP}, m AS (SELECT rater_a, rater_b, count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(CAST(a = 'A' AS INT)) * avg(CAST(b = 'A' AS INT)) + avg(CAST(a = 'B' AS INT)) * avg(CAST(b = 'B' AS INT)) + avg(CAST(a = 'TIE' AS INT)) * avg(CAST(b = 'TIE' AS INT)) AS pe FROM p GROUP BY ALL) SELECT rater_a, rater_b, n, round((po - pe) / (1 - pe), 6) AS kappa FROM m")
def _(spark, d):
    return A.nominal_agreement(A.pairs(V.choices(spark, d), ["unit"]), ["rater_a", "rater_b"]).select("rater_a", "rater_b", "n", "kappa")


@query("agr_01", f"SELECT rater_a, rater_b, round(avg(CAST(a = b AS INT)), 6) AS agreement FROM {_RP} GROUP BY ALL")
def _(spark, d):
    return A.binary_agreement(A.pairs(V.raters(spark, d), ["unit"]), ["rater_a", "rater_b"]).select("rater_a", "rater_b", "agreement")


@query("agr_04", f"SELECT rater_a, rater_b, round(CASE WHEN abs(1 - pe) <= 1e-12 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT rater_a, rater_b, avg(CAST(a = b AS INT)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM {_RP} GROUP BY ALL)")
def _(spark, d):
    k = A.binary_agreement(A.pairs(V.raters(spark, d), ["unit"]), ["rater_a", "rater_b"])
    return k.select("rater_a", "rater_b", F.coalesce("kappa", F.lit(1.0)).alias("kappa"))


@query("agr_06", f"SELECT rater_a, rater_b, round(2 * avg(CAST(a = b AS INT)) - 1, 6) AS pabak FROM {_RP} GROUP BY ALL")
def _(spark, d):
    return A.binary_agreement(A.pairs(V.raters(spark, d), ["unit"]), ["rater_a", "rater_b"]).select("rater_a", "rater_b", "pabak")


@query("chk_06", _BATCHES.format(k=30000))
def _(spark, d):
    return _batches(spark, d, 30000)


@query("chk_02")
def _(spark, d):
    n = V.notes(spark, d).select("subject_id", "note_idx", F.posexplode(T.split_chunks(F.col("text"), 4000, 400)).alias("chunk_idx", "text"))
    return n.withColumn("chunk_id", F.concat_ws("_", "subject_id", "note_idx", "chunk_idx"))


@query("win_03", "SELECT subject_id, note_idx, CAST(sum(length(text)) OVER (PARTITION BY subject_id ORDER BY note_idx) AS BIGINT) AS used FROM v_notes")
def _(spark, d):
    return S.budget_prefix(V.notes(spark, d), ["subject_id"], [F.asc("note_idx")], F.length("text"), 1 << 60).select("subject_id", "note_idx", "used")


@query("win_05", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(spark, d):
    return S.first_per_key(V.read(spark, d, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "text")


@query("win_06", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def _(spark, d):
    return S.first_per_key(V.read(spark, d, "conversations"), ["conv_id"], [F.asc("turn")]).select("conv_id", "turn", "text")


@query("win_08", "SELECT doc_id || '_fact_' || fact_idx AS fact_id, fact FROM v_facts")
def _(spark, d):
    return V.facts(spark, d).select(F.concat_ws("_fact_", "doc_id", "fact_idx").alias("fact_id"), "fact")


@query("smp_02", "WITH b AS (SELECT ord, completeness AS stratum FROM v_pairwise), q AS (SELECT stratum, greatest(1, CAST(round(30 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()) AS INTEGER)) AS quota FROM b GROUP BY stratum) SELECT ord, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(ord AS VARCHAR)), ord) AS r FROM b) JOIN q USING (stratum) WHERE r <= quota")
def _(spark, d):
    b = V.pairwise(spark, d).select(F.col("ord").cast("bigint").alias("ord"), F.col("completeness").alias("stratum"))
    return S.stratified_quota(b, "stratum", 30, F.col("ord"))


@query("fn_16", "SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'model' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def _(spark, d):
    m = V.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(F.when(x["role"] == "assistant", "model").otherwise(x["role"]), F.lit(": "), x["text"])), "\n").alias("messages"))


@query("fn_17", "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) AS n FROM conversations GROUP BY conv_id")
def _(spark, d):
    m = V.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("m"))
    return m.select("conv_id", F.size(F.filter("m", lambda r: r == "user")).cast("bigint").alias("n_user"), F.size("m").cast("bigint").alias("n"))


@query("fn_20", "SELECT event_id, event_id % 3 = 0 AS stop FROM events")
def _(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, "True").otherwise("no")
    return V.read(spark, d, "events").select("event_id", T.stopped(said).alias("stop"))


@query("fn_21", "SELECT doc_id, string_agg('- ' || fact, chr(10) ORDER BY fact_idx) AS block FROM v_facts GROUP BY doc_id")
def _(spark, d):
    g = V.facts(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("fact_idx", "fact"))).alias("f"))
    return g.select("doc_id", F.array_join(F.transform("f", lambda x: F.concat(F.lit("- "), x["fact"])), "\n").alias("block"))


@query("fn_23", "SELECT DISTINCT CASE position WHEN 'ab' THEN 'ba' ELSE 'ab' END AS position FROM v_pairwise")
def _(spark, d):
    return P.flip(V.pairwise(spark, d)).select("position").distinct()


@query("srt_01", "SELECT rater, count(*) FILTER (label = 'TIE') AS ties FROM v_choices GROUP BY rater ORDER BY ties DESC, rater")
def _(spark, d):
    return V.choices(spark, d).groupBy("rater").agg(F.count_if(F.col("label") == "TIE").alias("ties")).orderBy(F.desc("ties"), "rater")


@query("lim_01", "SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10")
def _(spark, d):
    return V.read(spark, d, "benchmark").select("item_id").orderBy("item_id").limit(10)


@query("inc_01", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return S.pending(V.read(spark, d, "documents").select("doc_id"), V.read(spark, d, "labels"), ["doc_id"])


@query("oth_20", f"SELECT rater_a, rater_b, count(*) AS n, round(avg(CAST(a = b AS INT)), 6) AS agreement, round(avg(CAST(a <> b AND a <> 'TIE' AND b <> 'TIE' AS INT)), 6) AS flip_rate FROM {_CP} GROUP BY ALL")
def _(spark, d):
    return A.nominal_agreement(A.pairs(V.choices(spark, d), ["unit"]), ["rater_a", "rater_b"]).select("rater_a", "rater_b", "n", "agreement", "flip_rate")


@query("oth_22", "SELECT DISTINCT source, regexp_extract(source || '.csv', '^(.*)[.]csv$', 1) AS stem FROM documents")
def _(spark, d):
    return V.read(spark, d, "documents").select("source").distinct().select("source", F.regexp_extract(F.concat("source", F.lit(".csv")), r"^(.*)\.csv$", 1).alias("stem"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
_SHARED = f"round(coalesce(len(list_intersect({_WORDS.format('natural_query')}, {_WORDS.format('text')})) / nullif(len({_WORDS.format('natural_query')}), 0)::DOUBLE, 0), 6)"


@query("ret_08", f"WITH /* v_notes v_questions */ {_BM25}, pool AS (SELECT question_id, r.note_idx, {_SHARED} AS score FROM ranked r JOIN v_questions USING (question_id) JOIN v_notes n ON n.subject_id = v_questions.subject_id AND n.note_idx = r.note_idx WHERE rank <= 50) "
       "SELECT question_id, note_idx, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, note_idx) AS rank FROM pool QUALIFY rank <= 10")  # fmt: skip
def _(spark, d):
    """The 50 best notes by words, scored again in pairs; the scorer is a stub, the share of the question's words in the note."""
    q, n = V.questions(spark, d), V.notes(spark, d)
    pool = R.bm25(q, n, 50).select("question_id", "note_idx").join(q.select("question_id", "subject_id", "natural_query"), "question_id")
    pairs = R.with_notes(pool, n.select("subject_id", "note_idx", "text"))
    return R.rerank(pairs, R.word_share, 10)


# Requests, results and lookups


@query("chk_07", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS job FROM orders")
def _(spark, d):
    return S.jobs(V.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("agg_19", "SELECT doc_id, count(*) AS total_items, count(*) FILTER (votes >= 2) AS items_met, count(*) FILTER (votes >= 2) / count(*) AS rubric_score FROM (SELECT doc_id, fact_idx, count(*) FILTER (vote) AS votes FROM v_verdicts GROUP BY ALL) GROUP BY doc_id")
def _(spark, d):
    items = V.verdicts(spark, d).groupBy("doc_id", "fact_idx").agg(F.count_if("vote").alias("votes"))
    out = items.groupBy("doc_id").agg(F.count("*").alias("total_items"), F.count_if(F.col("votes") >= 2).alias("items_met"))
    return out.withColumn("rubric_score", F.col("items_met") / F.col("total_items"))


@query("srt_02", "SELECT unit, direction, rater FROM v_raters ORDER BY ALL")
def _(spark, d):
    return V.raters(spark, d).select("unit", "direction", "rater").orderBy("unit", "direction", "rater")


@query("srt_03", "SELECT subject_id, note_idx FROM v_notes ORDER BY subject_id, note_idx DESC")
def _(spark, d):
    return V.notes(spark, d).select("subject_id", "note_idx").orderBy("subject_id", F.desc("note_idx"))


@query("fn_01", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a, b|c' WHEN 1 THEN 'it''s|1' ELSE '' END AS items FROM documents")
def _(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, '["a, b", "c"]').when(F.col("doc_id") % 3 == 1, "[\"it's\", 1, ]").otherwise("none")
    return V.read(spark, d, "documents").select("doc_id", F.array_join(T.parse_literals(text), "|").alias("items"))


@query("fn_10", "SELECT doc_id, text AS excerpt FROM v_notes")
def _(spark, d):
    whole = F.concat(F.lit("Note Title: "), "note_title", F.lit("\nNote Excerpt: "), "text")
    at = F.locate("Note Excerpt: ", whole)
    return V.notes(spark, d).select("doc_id", F.when(at > 0, F.substr(whole, at + 14)).otherwise(whole).alias("excerpt"))


@query("fn_12")
def _(spark, d):
    """BLEU-1 to 4 of responses against the reference of their question."""
    q = V.questions(spark, d).select("question_id", "reference")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    both = V.responses(spark, d).join(q, "question_id").select("response_id", "conv_id", words("response").alias("c"), words("reference").alias("r"))
    return both.select("response_id", "conv_id", *[T.bleu(F.col("c"), F.col("r"), n).alias(f"bleu_{n}") for n in range(1, 5)])


@query("fn_18", "SELECT DISTINCT source, source AS provider, 'bm25' AS method FROM documents")
def _(spark, d):
    parts = T.source_parts(F.concat("source", F.lit("_bm25")))
    return V.read(spark, d, "documents").select("source").distinct().select("source", parts["provider"].alias("provider"), parts["method"].alias("method"))


@query("fn_22", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id % 6 END AS score, CASE WHEN event_id % 7 > 0 THEN event_type END AS explanation FROM events")
def _(spark, d):
    said = F.when(F.col("event_id") % 7 == 0, "no score").otherwise(F.to_json(F.struct((F.col("event_id") % 6).alias("score"), F.col("event_type").alias("explanation"))))
    return V.read(spark, d, "events").select("event_id", F.from_json(said, "score bigint, explanation string").alias("j")).select("event_id", "j.score", "j.explanation")


@query("fn_24", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS n, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS source_idx FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, F.format_string('[{"text":"a","source_idx":%d}]', i)).when(i % 4 == 1, '["a","b"]').when(i % 4 == 2, "[]").otherwise('[{"text":"a"},"b"]')
    atoms = V.read(spark, d, "documents").select("doc_id", T.parse_atoms(text).alias("f"))
    return atoms.select("doc_id", F.when(F.col("f").isNotNull(), F.size("f")).alias("n"), F.get("f", F.lit(0))["source_idx"].alias("source_idx"))


@query("inc_02", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 5 > 0)")
def _(spark, d):
    line = F.when(F.col("doc_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("doc_id")))
    done = V.read(spark, d, "labels").select(F.from_json(line, "doc_id bigint").alias("j")).select("j.doc_id").where("doc_id is not null")
    return S.pending(V.read(spark, d, "documents").select("doc_id"), done, ["doc_id"])


@query("inc_08", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def _(spark, d):
    """Rows of forced keys are dropped and computed anew; the others stay."""
    old = V.read(spark, d, "labels").select("doc_id", "quality")
    again = old.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality"))
    return S.upsert(old, again, ["doc_id"])


@query("inc_09", "SELECT question_id, arg_min(response_id, conv_id * 1000 + turn) AS response_id FROM v_responses GROUP BY question_id")
def _(spark, d):
    return V.responses(spark, d).groupBy("question_id").agg(F.min_by("response_id", F.struct("conv_id", "turn")).alias("response_id"))


@query("oth_02", "SELECT subject_id || ':' || note_idx || ':' || c AS request_id, md5(substr(text, c * 500 + 1, 500)) AS digest FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(text) / 500) AS BIGINT)))) AS c FROM v_notes)")
def _(spark, d):
    chunks = V.notes(spark, d).select("subject_id", "note_idx", F.posexplode(T.fixed_chunks(F.col("text"), 500)).alias("c", "chunk"))
    return chunks.select(F.concat_ws(":", "subject_id", "note_idx", "c").alias("request_id"), F.md5("chunk").alias("digest"))


@query("oth_04", "SELECT question_id, CASE item_id % 3 WHEN 0 THEN 'Use the facts and the summary.' WHEN 1 THEN 'Use the facts.' ELSE 'Use the summary.' END AS prompt FROM v_questions")
def _(spark, d):
    part = F.col("item_id") % 3
    return V.questions(spark, d).select("question_id", F.when(part == 0, "Use the facts and the summary.").when(part == 1, "Use the facts.").otherwise("Use the summary.").alias("prompt"))


@query("oth_05", "SELECT subject_id, note_idx, text FROM v_notes WHERE note_title = 'src1'")
def _(spark, d):
    return V.notes(spark, d).where("note_title = 'src1'").select("subject_id", "note_idx", "text")


@query("oth_06", "SELECT subject_id, question_id, row_number() OVER (PARTITION BY subject_id ORDER BY item_id) - 1 AS ordinal, CASE WHEN item_id % 2 = 0 THEN 'Rewritten: ' || natural_query ELSE natural_query END AS natural_query FROM v_questions")
def _(spark, d):
    from pyspark.sql import Window

    rewrite = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Rewritten: "), "natural_query"))
    ordinal = F.row_number().over(Window.partitionBy("subject_id").orderBy("item_id")) - 1
    return V.questions(spark, d).select("subject_id", "question_id", ordinal.alias("ordinal"), F.coalesce(rewrite, "natural_query").alias("natural_query"))


@query("oth_07", "SELECT question_id, natural_query, 'why ' || item_id AS rationale FROM v_questions WHERE item_id % 2 = 0")
def _(spark, d):
    q = V.questions(spark, d)
    said = q.where("item_id % 2 = 0").select(F.to_json(F.array(F.struct("question_id", F.concat(F.lit("why "), "item_id").alias("rationale")))).alias("j"))
    chosen = said.select(F.inline(F.from_json("j", "array<struct<question_id:string,rationale:string>>")))
    return q.join(chosen, "question_id").select("question_id", "natural_query", "rationale")


@query("oth_08", "SELECT doc_id, fact_idx, md5('Fact: ' || fact || chr(10) || 'Note: ' || text) AS digest FROM v_facts JOIN v_notes USING (doc_id)")
def _(spark, d):
    prompt = T.fill("Fact: {fact}\nNote: {note}", fact=F.col("fact"), note=F.col("text"))
    return V.facts(spark, d).join(V.notes(spark, d).select("doc_id", "text"), "doc_id").select("doc_id", "fact_idx", F.md5(prompt).alias("digest"))


@query("oth_09", "SELECT doc_id, fact_idx, direction, bool_or(vote) FILTER (juror = 0) AS juror_0, bool_or(vote) FILTER (juror = 2) AS juror_2 FROM v_verdicts, (SELECT unnest(['precision', 'recall']) AS direction) WHERE juror IN (0, 2) GROUP BY ALL")
def _(spark, d):
    jurors = (0, 2)
    votes = V.verdicts(spark, d).where(F.col("juror").isin(*jurors)).groupBy("doc_id", "fact_idx").agg(*[F.bool_or(F.when(F.col("juror") == j, F.col("vote"))).alias(f"juror_{j}") for j in jurors])
    return votes.select("*", F.explode(F.lit(["precision", "recall"])).alias("direction"))


@query("oth_10", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'decompose' ELSE 'extract' END AS prompt FROM documents WHERE doc_id % 2 = 0 OR trim(coalesce(text, '')) <> ''")
def _(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "decompose").when(F.trim(F.coalesce("text", F.lit(""))) != "", "extract")
    return V.read(spark, d, "documents").select("doc_id", kind.alias("prompt")).where("prompt is not null")


@query("oth_13", "SELECT doc_id, unnest(['2024-01-0' || (doc_id % 9 + 1), '2024-02-01']) AS note_date FROM documents")
def _(spark, d):
    mixed = F.parse_json(F.format_string('[{"note_date": "2024-01-0%d"}, "2024-02-01"]', F.col("doc_id") % 9 + 1)).cast("array<variant>")
    rows = V.read(spark, d, "documents").select("doc_id", F.explode(mixed).alias("v"))
    return rows.select("doc_id", F.coalesce(F.try_variant_get("v", "$.note_date", "string"), F.try_variant_get("v", "$", "string")).alias("note_date"))


@query("oth_14", "SELECT doc_id, fact_idx, string_agg(CASE WHEN vote THEN 'Y' ELSE 'N' END, '' ORDER BY juror) AS votes, count(*) FILTER (vote) >= 2 AS consensus FROM v_verdicts GROUP BY ALL")
def _(spark, d):
    g = V.verdicts(spark, d).groupBy("doc_id", "fact_idx").agg(F.array_sort(F.collect_list(F.struct("juror", "vote"))).alias("v"), (F.count_if("vote") >= 2).alias("consensus"))
    return g.select("doc_id", "fact_idx", F.array_join(F.transform("v", lambda x: F.when(x["vote"], "Y").otherwise("N")), "").alias("votes"), "consensus")


@query("oth_17", "SELECT question_id, arg_max(response_id, conv_id * 1000 + turn) AS response_id FROM v_responses GROUP BY question_id")
def _(spark, d):
    return V.responses(spark, d).groupBy("question_id").agg(F.max_by("response_id", F.struct("conv_id", "turn")).alias("response_id"))


@query("oth_19", "SELECT rater, count(*) AS n, count(label) AS marked FROM (SELECT rater, label FROM v_choices UNION ALL SELECT rater, CAST(label AS VARCHAR) FROM v_raters) GROUP BY rater")
def _(spark, d):
    people = V.choices(spark, d).select("rater", "label")
    judges = V.raters(spark, d).select("rater", F.col("label").cast("string").alias("label"))
    return people.unionByName(judges).groupBy("rater").agg(F.count("*").alias("n"), F.count("label").alias("marked"))


@query("oth_24", "SELECT question_id, model_a, model_b, position FROM v_pairwise WHERE completeness = 'TIE'")
def _(spark, d):
    keys = ["question_id", "model_a", "model_b", "position"]
    judged = V.pairwise(spark, d).select(*keys, F.when(F.col("completeness") != "TIE", F.col("completeness")).otherwise(" ").alias("completeness"))
    return S.pending(V.pairwise(spark, d).select(*keys), judged, keys, "completeness")


@query("oth_27", "SELECT question_id, model_a, model_b, CASE completeness WHEN 'TIE' THEN 'tie' ELSE completeness END AS winner FROM v_pairwise")
def _(spark, d):
    won = T.normal_label(F.col("completeness"))
    return V.pairwise(spark, d).select("question_id", "model_a", "model_b", F.when(won == "TIE", "tie").otherwise(won).alias("winner"))


@query("win_09")
def _(spark, d):
    """An answer carried through the turns of a conversation, by the stub provider."""
    from .operators import providers as M

    turns = V.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("batch"), "text")
    return M.rolling_answers(turns, M.echo, "conv_id", "{answer}\n{text}")


from . import queries_more as _more  # noqa: E402, F401
