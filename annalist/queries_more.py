"""Queries of sources, sinks, providers, agents and staged work.

Files are written from the supplied tables to the session's shared folder, and read again through the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import stem as ST
from .functions import text as T
from .functions import tokens as K
from .operators import agent as G
from .operators import agents as GR
from .operators import agreement as A
from .operators import facts as X
from .operators import pairwise as P
from .operators import providers as M
from .operators import retrieval as R
from .operators import tables as S
from .plans import views as V
from .queries import query
from .sources import folders, readers, sinks

# Sources


def _note_folder(spark, d):
    path = folders.scratch(spark, "notes")
    notes = V.notes(spark, d).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("note_idx", F.col("note_date").cast("string").alias("note_date"), "note_title", "text"))).alias("n"))
    lists = F.to_json(F.transform("n", lambda x: F.struct(x["note_date"].alias("note_date"), x["note_title"].alias("note_title"), x["text"].alias("text"))))
    folders.named_files(notes.select(F.col("subject_id").alias("name"), lists.alias("value")), path, "_subsetrecords.json")
    return path


_NOTES = "SELECT subject_id, note_idx, CAST(note_date AS VARCHAR) AS note_date, note_title, md5(text) AS digest FROM v_notes"


@query("src_01", _NOTES)
def _(spark, d):
    return readers.note_files(spark, _note_folder(spark, d)).select("subject_id", "note_idx", "note_date", "note_title", F.md5("text").alias("digest"))


@query("src_02", _NOTES)
def _(spark, d):
    return readers.note_files(spark, _note_folder(spark, d), strict=True).select("subject_id", "note_idx", "note_date", "note_title", F.md5("text").alias("digest"))


@query("src_03", "SELECT doc_id, note_date, note_title, md5(text) AS digest FROM v_notes")
def _(spark, d):
    path = folders.scratch(spark, "table") + ".json"
    V.notes(spark, d).select("doc_id", F.col("note_date").cast("string").alias("note_date"), "note_title", "text").write.json(path)
    return readers.note_table(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("note_date").cast("date").alias("note_date"), "note_title", F.md5("text").alias("digest"))


@query("src_04", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents")
def _(spark, d):
    path = folders.scratch(spark, "csv")
    V.read(spark, d, "documents").select("doc_id", "lang", "source").write.option("header", True).csv(path)
    return readers.strings(spark, path, ["doc_id", "lang", "source"])


@query("src_05", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents")
def _(spark, d):
    base, docs = folders.scratch(spark, "union"), V.read(spark, d, "documents")
    docs.where("doc_id % 2 = 0").select("doc_id", "lang").write.option("header", True).csv(f"{base}/a")
    docs.where("doc_id % 2 = 1").select("doc_id", "source").write.option("header", True).csv(f"{base}/b")
    spark.createDataFrame([("doc_id,lang",), ("1,en,surplus",), ("2,fr,surplus",)], "value string").coalesce(1).write.text(f"{base}/c")
    return readers.union_files(spark, [f"{base}/a", f"{base}/b", f"{base}/c"]).select("doc_id", "lang", "source")


@query("src_05_rejects", "SELECT 'kept' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT 'rejected', doc_id || ',' || lang || ',surplus' FROM documents WHERE doc_id % 5 = 0")
def _(spark, d):
    """Every fifth line has a value too many: such lines go to a side table, and both tables add up to the file."""
    path = folders.scratch(spark, "widths") + "/a"
    docs = V.read(spark, d, "documents").select("doc_id", "lang")
    line = F.concat_ws(",", F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") % 5 == 0, "surplus"))
    head = F.lit("doc_id,lang").alias("value")
    # a file has its header first: one is written for each remainder
    folders.named_files(docs.select((F.col("doc_id") % 16).cast("string").alias("name"), line.alias("value")).unionByName(docs.select((F.col("doc_id") % 16).cast("string").alias("name"), head).distinct()), path, ".csv", F.col("value") != "doc_id,lang")
    good, bad = readers.union_with_rejects(spark, [path])
    return good.select(F.lit("kept").alias("kind"), F.col("doc_id").alias("id")).unionByName(bad.select(F.lit("rejected").alias("kind"), F.col("line").alias("id")))


@query("src_06", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source AS source_file FROM documents")
def _(spark, d):
    path, docs = folders.scratch(spark, "tagged"), V.read(spark, d, "documents").select("doc_id", "lang", "source")
    lines = docs.select(F.col("source").alias("name"), F.concat_ws(",", "doc_id", "lang").alias("value")).unionByName(docs.select(F.col("source").alias("name"), F.lit("doc_id,lang").alias("value")).distinct())
    sample = lines.where("value <> 'doc_id,lang'").select(F.lit("extra_sample").alias("name"), "value")
    folders.named_files(lines.unionByName(sample), path, ".csv", F.col("value") != "doc_id,lang")
    return readers.tagged_files(spark, f"{path}/*.csv", ["doc_id", "lang"])


@query("src_07", "SELECT doc_id * 100000 + fact_idx AS fact_idx, sha1(fact) AS fact FROM v_facts")
def _(spark, d):
    path = folders.scratch(spark, "tsv")
    V.facts(spark, d).select((F.col("doc_id") * 100_000 + F.col("fact_idx")).alias("index"), F.sha1("fact").alias("fact")).write.options(header=True, sep="\t").csv(path)
    return readers.tsv_facts(spark, path)


@query("src_08", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM labels")
def _(spark, d):
    path, ids = folders.scratch(spark, "lists"), V.read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    old = ids.select(F.concat(F.lit("a"), part).alias("name"), "id", F.lit("old").alias("v"))
    new = ids.where("id % 2 = 0").select(F.concat(F.lit("b"), part).alias("name"), "id", F.lit("new").alias("v"))
    folders.named_files(old.unionByName(new).groupBy("name").agg(F.to_json(F.collect_list(F.struct("id", "v"))).alias("value")), path, ".json")
    return readers.last_per_id(spark, path, "id:bigint,v:string", "id")


@query("src_09", "SELECT 'left' AS source_name, CAST(doc_id AS VARCHAR) AS question_id, lang AS model, source AS text, CAST(NULL AS VARCHAR) AS facts FROM documents UNION ALL SELECT 'right', CAST(doc_id AS VARCHAR), 'right', CAST(NULL AS VARCHAR), CAST(quality AS VARCHAR) FROM labels")
def _(spark, d):
    base = folders.scratch(spark, "configured")
    V.read(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "lang", "source").write.option("header", True).csv(f"{base}/a")
    V.read(spark, d, "labels").select(F.col("doc_id").alias("question_id"), "quality").write.option("header", True).csv(f"{base}/b")
    return readers.configured(spark, [{"source_name": "left", "path": f"{base}/a", "model_column": "lang", "text_column": "source"}, {"source_name": "right", "path": f"{base}/b", "facts_column": "quality"}])


def _shard_lines(spark, d):
    r = V.responses(spark, d).select(F.concat_ws("_", "conv_id", "turn").alias("k"), "conv_id", "response")
    body = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("response").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    ok = F.to_json(F.struct(F.when(F.col("conv_id") % 2 == 0, F.col("k")).alias("key"), F.when(F.col("conv_id") % 2 == 1, F.col("k")).alias("custom_id"), body.alias("response")))
    bad = F.to_json(F.struct(F.col("k").alias("key"), F.lit("quota").alias("status")))
    return r.select(F.when(F.col("conv_id") % 7 == 0, bad).when(F.col("conv_id") % 7 == 1, "{broken").otherwise(ok).alias("value"))


_SHARDS = "SELECT conv_id || '_' || turn AS key, CASE conv_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'missing' END AS reason, CASE WHEN conv_id % 7 > 1 THEN response END AS text FROM v_responses"


@query("src_10", _SHARDS)
def _(spark, d):
    path = folders.scratch(spark, "shards")
    _shard_lines(spark, d).write.text(path)
    asked = V.responses(spark, d).select(F.concat_ws("_", "conv_id", "turn").alias("key"))
    return S.keyed_results(asked, readers.shards(spark, path), ["key"]).select("key", "reason", "text")


@query("src_11", "SELECT CAST(vec_id % 20 AS VARCHAR) AS subject_id, vec_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def _(spark, d):
    """Half of the subjects are cached; the misses are found by an anti join, stored, and all is read again."""
    path, schema = folders.scratch(spark, "cache"), "vec_id bigint, embedding array<float>, subject_id string"
    e = V.read(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 20).cast("string").alias("subject_id"))
    sinks.remember(e.where("vec_id % 2 = 0"), path)
    missing = e.join(readers.cached(spark, path, schema).select("subject_id").distinct(), "subject_id", "left_anti")
    sinks.remember(missing, path)
    return readers.cached(spark, path, schema).select("subject_id", "vec_id", F.size("embedding").cast("bigint").alias("dim"))


@query("src_12", "SELECT subject_id, note_idx, ('0x' || substr(md5(text), 1, 6))::BIGINT AS v FROM v_notes WHERE subject_id NOT IN (SELECT subject_id FROM v_notes WHERE doc_id % 4 = 0)")
def _(spark, d):
    """Only notes of subjects without a cache entry are encoded, by the stub encoder."""
    n = V.notes(spark, d)
    todo = n.join(n.where("doc_id % 4 = 0").select("subject_id").distinct(), "subject_id", "left_anti")
    return M.encode(todo.select("subject_id", "note_idx", "text"), ["subject_id", "note_idx"], M.hashed).select("subject_id", "note_idx", F.get("vec", F.lit(0)).cast("bigint").alias("v"))


@query("src_13", "SELECT conv_id, turn, text FROM conversations")
def _(spark, d):
    c = V.read(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "text")
    pages = c.groupBy("conv_id").agg(readers.to_html(F.collect_list(F.struct("turn", "text"))).alias("html"))
    return pages.select("conv_id", F.inline(readers.from_html(F.col("html"), "array<struct<turn:bigint,text:string>>")))


# Sinks


@query("snk_01", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents")
def _(spark, d):
    """Two appends: an extra column goes, a missing one is blank."""
    path, docs = folders.scratch(spark, "append"), V.read(spark, d, "documents")
    sinks.append(docs.where("doc_id % 2 = 0").select("doc_id", "lang", "source"), path, ["doc_id", "lang"], "csv")
    sinks.append(docs.where("doc_id % 2 = 1").select("doc_id"), path, ["doc_id", "lang"], "csv")
    return readers.strings(spark, path, ["doc_id", "lang"])


@query("snk_02", "SELECT doc_id, source FROM documents")
def _(spark, d):
    path, docs = folders.scratch(spark, "jsonl"), V.read(spark, d, "documents")
    for i in (0, 1):
        sinks.append(docs.where(f"doc_id % 2 = {i}"), path, ["doc_id", "source"], "json")
    return spark.read.schema("doc_id bigint, source string").json(path)


@query("snk_03", "SELECT doc_id, quality FROM labels WHERE doc_id % 3 > 0")
def _(spark, d):
    """A table is rewritten from itself; readers see one snapshot or the other."""
    base, rows = folders.scratch(spark, "snapshots"), V.read(spark, d, "labels").select("doc_id", "quality")
    sinks.replace(rows, base)
    sinks.replace(sinks.current(spark, base).where("doc_id % 3 > 0"), base)
    return sinks.current(spark, base)


@query("snk_04", "SELECT subject_id, count(*) AS n, min(note_idx) AS first FROM v_notes GROUP BY subject_id")
def _(spark, d):
    path = folders.scratch(spark, "keys")
    sinks.per_key(V.notes(spark, d).select("subject_id", "note_idx"), path, "subject_id")
    back = spark.read.schema("note_idx bigint, subject_id string").option("header", True).csv(path)
    return back.groupBy("subject_id").agg(F.count("*").alias("n"), F.min("note_idx").alias("first"))


_CELLS = "(SELECT a.rater AS rater_a, b.rater AS rater_b, round(avg(CAST(a.label = b.label AS INT)), 6) AS agreement FROM v_raters a JOIN v_raters b ON a.unit = b.unit AND a.rater < b.rater WHERE a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY ALL)"


@query("snk_05", f"SELECT rater_a, rater_b, CAST(floor(agreement * 10) AS BIGINT) AS shade FROM (SELECT * FROM {_CELLS} UNION ALL SELECT rater_b, rater_a, agreement FROM {_CELLS})")
def _(spark, d):
    """The matrix drawn with ten shades; the rows are read back from the picture."""
    m = A.symmetric(A.binary_agreement(A.pairs(V.raters(spark, d), ["unit"]), ["rater_a", "rater_b"]), "agreement")
    path = folders.scratch(spark, "pictures") + "/agreement.png"
    sinks.heatmap(m.select("rater_a", "rater_b", F.floor(F.col("agreement") * 10).alias("shade")), path)
    return readers.heatmap(spark, path)


@query("ui_01", "SELECT subject_id, count(*) AS cards FROM v_notes GROUP BY subject_id")
def _(spark, d):
    """One annotation page a subject with its cards embedded; the cards are counted from the pages."""
    pages = V.notes(spark, d).groupBy("subject_id").agg(readers.to_html(F.collect_list(F.struct(F.col("note_idx").alias("card")))).alias("html"))
    return pages.select("subject_id", F.size(readers.from_html(F.col("html"), "array<struct<card:bigint>>")).cast("bigint").alias("cards"))


# Projections, order and samples


@query("prj_01", "SELECT response_id, model, length(response) AS bleu, length(response) % 7 AS rouge FROM v_responses")
def _(spark, d):
    scored = V.responses(spark, d).select(F.length("response").alias("bleu"), "response_id", (F.length("response") % 7).alias("rouge"), "model", F.lit(1).alias("unasked"))
    return S.output_columns(scored, ["response_id", "model"], ["rouge", "bleu"])


@query("win_01")
def _(spark, d):
    return P.elo_table(V.pairwise(spark, d).withColumn("overall", P.majority(*P.DIMENSIONS)), "ord")


@query("win_02")
def _(spark, d):
    """The turn of every judgment in the seeded shuffle."""
    rows = P.numbered_rows(V.pairwise(spark, d).select("ord"), "ord")
    return S.seeded_turns(rows, "row", P.seeded_order(rows.count()))


@query("smp_04", "SELECT doc_id, fact_idx, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0|' || doc_id || '|' || fact_idx), fact_idx) - 1 AS place FROM v_facts")
def _(spark, d):
    return S.shuffled(V.facts(spark, d).select("doc_id", "fact_idx"), ["doc_id"], "fact_idx", "0")


@query("smp_05", "SELECT question_id, ['a', 'b', 'c'][('0x' || substr(md5('42|' || question_id), 1, 8))::BIGINT % 3 + 1] AS persona FROM v_questions")
def _(spark, d):
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), "question_id")), 1, 8), 16, 10).cast("bigint")
    return V.questions(spark, d).select("question_id", F.element_at(F.lit(["a", "b", "c"]), (drawn % 3 + 1).cast("int")).alias("persona"))


@query("set_11")
def _(spark, d):
    f = V.facts(spark, d).select(F.col("doc_id").cast("string").alias("subject"), "fact_idx", F.col("fact"))
    return S.drop_redundant(f, "subject", M.repeats("subject"), sinks.kept, group=8).select("subject", "fact_idx")


# Retrieval over chunks


@query("ret_02_chunks")
def _(spark, d):
    return R.chunk_bm25(V.questions(spark, d), V.notes(spark, d), 50)


@query("ret_10", "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings WHERE list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]) > 0")
def _(spark, d):
    u = V.read(spark, d, "embeddings").select("vec_id", R.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.sqrt(R.dot(F.col("u"), F.col("u"))), 6).alias("norm")).where("norm > 0")


# Resume


@query("inc_03", "SELECT conv_id, max(turn) AS batch, max(turn) + 1 >= any_value(total) AS complete FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) + 1 - conv_id % 2 + 1 AS total FROM conversations) WHERE trim(text) <> '' GROUP BY conv_id")
def _(spark, d):
    from pyspark.sql import Window

    c = V.read(spark, d, "conversations").withColumn("total", F.max("turn").over(Window.partitionBy("conv_id")) + 2 - F.col("conv_id") % 2)
    return S.rolling_progress(c.select("conv_id", F.col("turn").alias("batch"), "total", F.col("text").alias("answer")), ["conv_id"]).select("conv_id", "batch", "complete")


@query("inc_04", "SELECT job, (job >= 0) AS attached FROM (SELECT unnest([0, 1]) AS job)")
def _(spark, d):
    """A manifest of the same ids is attached to, in whatever order; another one isn't, and new jobs are written."""
    base, asked = folders.scratch(spark, "manifest"), V.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    sinks.replace(S.jobs(asked, "id", 1000), base)
    same = S.same_requests(sinks.current(spark, base), asked.orderBy(F.desc("id")), "id")
    other = S.same_requests(sinks.current(spark, base), asked.where("id > 1"), "id")
    return spark.createDataFrame([(0, same), (1, not other)], "job int, attached boolean")


@query("inc_05", "SELECT conv_id || '_' || turn AS key, CASE conv_id % 7 WHEN 0 THEN 'error' ELSE 'missing' END AS reason FROM v_responses WHERE conv_id % 7 < 2")
def _(spark, d):
    """Failures of two runs are appended to a ledger and read from it."""
    path, shards = folders.scratch(spark, "ledger"), folders.scratch(spark, "shards")
    _shard_lines(spark, d).write.text(shards)
    asked = V.responses(spark, d).select(F.concat_ws("_", "conv_id", "turn").alias("key"), "conv_id")
    found = S.keyed_results(asked, readers.shards(spark, shards), ["key"]).where("reason is not null")
    for i in (0, 1):
        sinks.ledger(found.where(f"conv_id % 2 = {i}"), path)
    return spark.read.schema("key string, reason string").json(path)


@query("inc_07", "SELECT item_id, length(text) AS n, length(text) * 2 AS m FROM benchmark")
def _(spark, d):
    """Three stages, each stored; the second run reads what the first one stored."""
    base, items = folders.scratch(spark, "stages"), V.read(spark, d, "benchmark")
    for _ in range(2):
        one = sinks.staged(spark, base, "stage1", lambda: items.select("item_id", F.length("text").alias("n")))
        two = sinks.staged(spark, base, "stage2", lambda: one.withColumn("m", F.col("n") * 2))
        out = sinks.staged(spark, base, "stage3", lambda: two)
    return out


# Providers


@query("udf_02", "SELECT item_id AS custom_id, CASE WHEN item_id % 5 > 0 THEN 'answer:' || length(text) END AS text FROM benchmark")
def _(spark, d):
    asked = V.read(spark, d, "benchmark").select(F.col("item_id").alias("custom_id"), F.when(F.col("item_id") % 5 > 0, F.col("text")).otherwise("raise").alias("prompt"))
    return M.complete(asked, M.failing, "custom_id").select(F.col("custom_id").cast("bigint").alias("custom_id"), "text")


@query("udf_03", "SELECT CAST(o_orderkey AS VARCHAR) AS key, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS job, CASE WHEN o_orderkey % 9 = 0 THEN 'error' END AS reason FROM orders")
def _(spark, d):
    """Requests are split into jobs, answered by the stub as shards, and parsed by key."""
    shards = folders.scratch(spark, "answers")
    jobs = S.jobs(V.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000).select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"), "job")
    M.answer_jobs(jobs, shards, F.col("o_orderkey") % 9 == 0)
    return S.keyed_results(jobs.select("key", "job"), readers.shards(spark, shards), ["key"]).select("key", "job", "reason")


@query("udf_04", "SELECT doc_id, fact_idx, juror, (doc_id + fact_idx + juror) % 3 > 0 AS vote FROM v_facts, (SELECT unnest(range(3)) AS juror)")
def _(spark, d):
    """Three jurors judge every fact; each is a provider of its own."""
    f = V.facts(spark, d).select("doc_id", "fact_idx")
    out = None
    for j in range(3):
        asked = f.select(F.concat_ws("_", "doc_id", "fact_idx").alias("key"), (F.col("doc_id") + F.col("fact_idx")).cast("string").alias("prompt"))
        said = M.complete(asked, M.juror(j), "key").select(F.split_part("key", F.lit("_"), F.lit(1)).cast("bigint").alias("doc_id"), F.split_part("key", F.lit("_"), F.lit(2)).cast("bigint").alias("fact_idx"), F.lit(j).cast("bigint").alias("juror"), F.get_json_object("text", "$.entailed").cast("boolean").alias("vote"))
        out = said if out is None else out.unionByName(said)
    return out


@query("udf_05", "SELECT item_id, ('0x' || substr(md5(text), 1, 6))::BIGINT AS first FROM benchmark")
def _(spark, d):
    return M.encode(V.read(spark, d, "benchmark").select("item_id", "text"), ["item_id"], M.hashed).select("item_id", F.get("vec", F.lit(0)).cast("bigint").alias("first"))


@query("udf_06", "SELECT CAST(item_id AS VARCHAR) AS item_id, CASE WHEN item_id % 4 = 0 THEN 'fallback' ELSE 'try ' || (item_id % 4) END AS text FROM benchmark")
def _(spark, d):
    """An answer is asked for up to three times; what then isn't accepted falls back."""
    asked = V.read(spark, d, "benchmark").select("item_id", (F.col("item_id") % 4).cast("string").alias("prompt"))
    return M.complete(asked, M.moody(), "item_id", tries=3, fallback="fallback")


@query("udf_07")
def _(spark, d):
    """Every tool of the agent on each subject's notes, errors as text."""
    n = V.notes(spark, d).select("subject_id", "note_idx", F.col("note_date").cast("string").alias("note_date"), "note_title", "text")
    return G.tool_outputs(n, M.echo)


def _said(turns: int) -> str:
    sql = "SELECT question_id, natural_query AS prompt, '' AS said FROM v_questions"
    for i in range(turns):
        sql = f"SELECT question_id, prompt, said || '{chr(10) if i else ''}answer:' || length(prompt || chr(10) || said) AS said FROM ({sql})"
    return f"SELECT question_id, said FROM ({sql})"


@query("win_10", _said(5))
def _(spark, d):
    """Five turns over all questions at once; every pass is stored before the next one asks."""
    q = V.questions(spark, d).select("question_id", F.col("natural_query").alias("prompt"))
    said = M.turns(q, M.echo, "question_id", 5, lambda df, _: sinks.kept(df))
    return said.select("question_id", F.array_join(F.transform("history", lambda h: h["text"]), "\n").alias("said"))


@query("win_11")
def _(spark, d):
    q = V.questions(spark, d).withColumn("question", F.col("natural_query"))
    seen = R.as_of(q, V.notes(spark, d)).select("question_id", "question", "note_idx", F.col("note_date").cast("string").alias("note_date"), "note_title", "text")
    return G.answers(seen, G.scripted)


@query("win_11_rows")
def _(spark, d):
    """Agents over rows: all open questions ask at once, and their calls meet the notes by joins."""
    q = V.questions(spark, d).withColumn("question", F.col("natural_query"))
    out = GR.run(q, V.notes(spark, d), GR.scripted, sinks.kept)
    return out.select("question_id", "answer", "n_steps", F.size("history").alias("kept_steps"))


@query("udf_08", "SELECT subject_id, note_idx, count(*) AS n FROM (SELECT subject_id, note_idx, unnest(range(greatest(1, CAST(ceil(length(text) / 20000) AS BIGINT)))) AS c FROM v_notes) GROUP BY ALL")
def _(spark, d):
    """One row in, many out: the extraction chunks of every note."""
    return V.notes(spark, d).select("subject_id", "note_idx", F.explode(T.fixed_chunks(F.col("text"), 20_000)).alias("c")).groupBy("subject_id", "note_idx").agg(F.count("*").alias("n"))


@query("udf_09", "SELECT item_id, i AS criterion, (item_id + i) % 9 - 4 AS points FROM benchmark, (SELECT unnest(range(3)) AS i) WHERE item_id % 6 > 0")
def _(spark, d):
    """Rubrics of the stub, parsed by schema; what doesn't parse gives no criterion."""
    asked = V.read(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("prompt"))
    said = M.complete(asked, M.rubric, "item_id").select(F.col("item_id").cast("bigint").alias("item_id"), F.from_json("text", "criteria array<struct<id:bigint,points:bigint>>").alias("r"))
    return said.select("item_id", F.inline("r.criteria")).withColumnRenamed("id", "criterion")


@query("udf_10", "SELECT unit, direction, count(*) AS marks FROM v_raters GROUP BY unit, direction HAVING count(label) = count(*)")
def _(spark, d):
    """Few-shot turns only of directions that are marked throughout."""
    return X.fully_marked(V.raters(spark, d), ["unit", "direction"], "label").select("unit", "direction", "marks")


@query("udf_11", "SELECT substr(sha1(question_id || '|' || model_a || '|' || model_b), 1, 12) AS record_id, question_id, model_a, model_b FROM v_pairwise WHERE position = 'ab'")
def _(spark, d):
    """A map from blind ids to records, stored as JSON, back to pairs; the blinded side carries the id alone."""
    p = V.pairwise(spark, d).where("position = 'ab'")
    record = T.record_id(F.col("question_id"), F.col("model_a"), F.col("model_b"))
    stored = p.select(record.alias("record_id"), F.to_json(F.struct("question_id", "model_a", "model_b")).alias("j"))
    return stored.select("record_id", F.from_json("j", "question_id string, model_a string, model_b string").alias("r")).select("record_id", "r.*")


# Metrics by model


@query("fn_13")
def _(spark, d):
    """Greedy token matching of stub vectors: precision, recall and F1."""
    r = V.responses(spark, d).join(V.questions(spark, d).select("question_id", "reference"), "question_id")
    return M.token_match(r.select("response_id", "conv_id", F.col("response").alias("c"), F.col("reference").alias("r")), ["response_id", "conv_id"])


@query("fn_11_l")
def _(spark, d):
    r = V.responses(spark, d).join(V.questions(spark, d).select("question_id", "reference"), "question_id")
    return r.select("response_id", "conv_id", F.round(T.rouge_l(ST.rouge_words(F.col("response")), ST.rouge_words(F.col("reference"))), 6).alias("rouge_l"))


# Further staged and textual work


@query("oth_01")
def _(spark, d):
    """Answers accumulated over a document's chunks in order: the first one that can be answered starts, the later ones update."""
    chunks = V.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("seed"), F.posexplode(T.fixed_chunks(F.col("text"), 2000)).alias("batch", "text"))
    return M.rolling_answers(chunks, M.echo, "seed", "{answer}\n{text}").groupBy("seed").agg(F.max_by("answer", "batch").alias("answer"), F.count("*").alias("n_updates"))


@query("oth_03", "SELECT doc_id, doc_id % 3 <> 0 AS reused FROM documents")
def _(spark, d):
    """Raw facts of an earlier run are used again unless they are empty or don't parse."""
    raw = V.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "[]").when(F.col("doc_id") % 6 == 3, "{broken").otherwise('["a"]').alias("raw"))
    facts = T.parse_list(F.col("raw"))
    return raw.select("doc_id", (F.size(facts) > 0).alias("reused"))


@query("oth_11", "SELECT DISTINCT response, CASE WHEN trim(response) <> '' THEN 'answer:' || length(response) END AS facts FROM v_responses")
def _(spark, d):
    """Each distinct response is asked once; a failure is null."""
    once = V.responses(spark, d).select("response").distinct().select(F.md5("response").alias("k"), F.col("response").alias("prompt"))
    return once.join(M.complete(once, M.echo, "k"), "k").select(F.col("prompt").alias("response"), F.col("text").alias("facts"))


@query("oth_12", "SELECT item_id, count(points) AS num_jurors, round(avg(points), 6) AS average, 12::BIGINT AS max_points FROM (SELECT item_id, j, CASE WHEN (item_id + j) % 4 > 0 THEN (item_id * 3 + j * 5) % 13 END AS points FROM benchmark, (SELECT unnest(range(3)) AS j)) GROUP BY item_id")
def _(spark, d):
    """Points of several jurors; those that failed are left out of the average."""
    j = V.read(spark, d, "benchmark").selectExpr("item_id", "explode(sequence(0L, 2L)) j").withColumn("points", F.expr("case when (item_id + j) % 4 > 0 then (item_id * 3 + j * 5) % 13 end"))
    return j.groupBy("item_id").agg(F.count("points").alias("num_jurors"), F.round(F.avg("points"), 6).alias("average"), F.lit(12).cast("bigint").alias("max_points"))


@query("oth_15", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'pairwise' ELSE 'unknown' END AS kind FROM events")
def _(spark, d):
    i = F.col("event_id") % 3
    record = F.when(i == 0, '{"record_id":"a","recall_items":[]}').when(i == 1, '{"record_id":"a","completeness":{"winner":"A"}}').otherwise('{"x":1}')
    return V.read(spark, d, "events").select("event_id", T.annotation_kind(record).alias("kind"))


@query("oth_16", "SELECT unit, rater, label FROM v_raters WHERE label IS NOT NULL UNION ALL SELECT unit, 'consensus', CAST(2 * sum(label) > count(*) AS INTEGER) FROM v_raters WHERE label IS NOT NULL GROUP BY unit HAVING 2 * sum(label) <> count(*)")
def _(spark, d):
    """Jurors out of a map of verdicts by juror, null verdicts skipped, and the consensus as one more rater."""
    maps = V.raters(spark, d).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("rater", "label"))).alias("judges"))
    rows = maps.select("unit", F.explode("judges").alias("rater", "label")).where("label is not null")
    return rows.unionByName(A.majority_rater(rows, ["unit"]).select("unit", F.lit("consensus").alias("rater"), "label"))


@query("oth_25", "SELECT unit, rater, row_number() OVER (PARTITION BY rater ORDER BY md5(CAST(unit AS VARCHAR)), unit) AS card FROM v_choices")
def _(spark, d):
    """Cards in the order of a page: each rater sees the units by a hash of their id."""
    return S.hash_ranks(V.choices(spark, d).select("unit", "rater"), ["rater"], F.col("unit"), "card")


@query("oth_26", "SELECT question_id, model_a || ' against ' || model_b || ' (' || position || '): ' || completeness || ' / ' || relevancy || ' / ' || concision AS preview FROM v_pairwise")
def _(spark, d):
    return V.pairwise(spark, d).select("question_id", T.fill("{a} against {b} ({p}): {x} / {y} / {z}", a=F.col("model_a"), b=F.col("model_b"), p=F.col("position"), x=F.col("completeness"), y=F.col("relevancy"), z=F.col("concision")).alias("preview"))


@query("oth_28", "SELECT doc_id, md5('Note Title: ' || note_title || chr(10) || 'Note Date: ' || COALESCE(CAST(note_date AS VARCHAR), '') || chr(10) || 'Text: ' || text || chr(10)) AS digest FROM v_notes")
def _(spark, d):
    return V.notes(spark, d).select("doc_id", F.md5(T.note_block(F.col("note_title"), F.col("note_date"), F.col("text"))).alias("digest"))


@query("oth_29", "SELECT model, sum(n)::BIGINT AS total, max(n) AS most, count(*) AS calls FROM (SELECT model, len([x FOR x IN string_split_regex(response, '\\s+') IF x <> '']) AS n FROM v_responses) GROUP BY model")
def _(spark, d):
    n = T.token_count(F.col("response"))
    return V.responses(spark, d).groupBy("model").agg(F.sum(n).alias("total"), F.max(n).alias("most"), F.count("*").alias("calls"))


@query("oth_29_tokens")
def _(spark, d):
    """The same in tokens of a byte-pair vocabulary."""
    n = V.responses(spark, d).select("model", K.model_tokens(F.col("response")).alias("n"))
    return n.groupBy("model").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("calls"))


@query("oth_30", "SELECT item_id, 'Answer briefly: ' || text AS prompt FROM benchmark")
def _(spark, d):
    prompts = T.prompt_assets('{"answer": "Answer briefly: {text}", "judge": "Judge: {text}"}')
    return V.read(spark, d, "benchmark").select("item_id", T.fill(prompts["answer"], text=F.col("text")).alias("prompt"))
