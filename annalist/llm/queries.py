"""The registered queries of the corpus operators, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, licenses, lines, lloyd, packing, pii, quality, rules, sharding, simhash, spans, variants
from .common import read

#: Vocabulary file of the packing query.
TOKENIZER = "byte_bpe_50k.json"
PII_KEY = "annalist-demo-key"


def tokenizer_path(name: str = TOKENIZER) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.apply_policy(rules.ledger(read(spark, sf_dir, "documents")), rules.POLICIES["v2"])
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), special=True).drop("tokens")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_found", "n_changed")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return sharding.reshard(docs, sharding.old_shard(sharding.group_of(F.col("text"))))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.templates(spark))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(read(spark, sf_dir, "documents"), keep="largest")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec"))[0]


OPERATORS = (
    op1_quality,
    op2_substring_dedup,
    op3_simhash,
    op4_line_dedup,
    op5_quality_rules,
    op6_packing,
    op7_pii,
    op8_decontamination,
    op9_sharding,
    op10_licenses,
    op11_exact_dedup,
    op12_spelling_variants,
    op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in OPERATORS}
_SPACE = "[\\x20\\x09-\\x0D]+"
_NORM = "trim(regexp_replace({x}, '" + _SPACE + "', ' ', 'g'))"
#: The least of (doc_id, first) of equal contents stays; pieces in the others' windows go.
_DEDUP = """n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS k FROM raw WHERE norm <> ''),
later AS (SELECT doc_id, first, len FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, first + unnest(range(len)) AS k FROM later),
kept AS (SELECT raw.doc_id, coalesce(string_agg(raw.piece, '{glue}' ORDER BY raw.raw) FILTER (g.k IS NULL), '') AS text, count(n.k) AS n_all, count(g.k) AS n_removed
FROM raw LEFT JOIN n ON n.doc_id = raw.doc_id AND n.raw = raw.raw LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.k = n.k GROUP BY raw.doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN kept.text END AS text, n_all AS {name}, n_removed FROM documents d JOIN kept USING (doc_id)"""
_OP2 = (
    "WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][\\x20\\x09-\\x0D]+|\\n[\\x20\\x09-\\x0D]*)', '\\1' || chr(1) || chr(2), 'g'), chr(1) || chr(2)) AS ps FROM documents), "
    "raw AS (SELECT doc_id, raw, ps[raw] AS piece, " + _NORM.format(x="ps[raw]") + " AS norm FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS raw FROM p)), "
    "runs AS (SELECT doc_id, k AS first, count(*) OVER r AS len, string_agg(norm, ' ') OVER r AS content, count(*) OVER (PARTITION BY doc_id) AS m FROM n WINDOW r AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), "
    "w AS (SELECT doc_id, first, len, len || chr(1) || content AS content FROM runs WHERE (len = 3 OR (first = 0 AND m = 2)) AND len(string_split(content, ' ')) >= 20 "
    "UNION ALL SELECT doc_id, k, 1, '1' || chr(1) || norm FROM n WHERE len(string_split(norm, ' ')) >= 20), "
)
#: Windows of 50 words select the line of the least hash; matches grow along the first place; of lines with 8 copies the first stays.
_OP4 = (
    "WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents), "
    "raw AS (SELECT doc_id, raw, ps[raw] AS piece, " + _NORM.format(x="ps[raw]") + " AS norm FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS raw FROM p)), "
    "c AS (SELECT doc_id, k, norm, nw, md5(norm) AS h, sum(nw) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (SELECT *, len(string_split(norm, ' ')) AS nw FROM n)), "
    "a AS (SELECT doc_id, list(norm ORDER BY k) AS a, list(nw ORDER BY k) AS ns, list(h ORDER BY k) AS hs, sum(nw) AS total FROM c GROUP BY doc_id), "
    "e AS (SELECT s.doc_id, s.k, min(t.k) AS k2 FROM c s JOIN c t ON t.doc_id = s.doc_id AND t.k >= s.k AND t.k < s.k + 50 AND t.upto - s.upto + s.nw >= 50 GROUP BY s.doc_id, s.k "
    "UNION ALL SELECT doc_id, 0, len(a) - 1 FROM a WHERE total < 50), "
    "fp AS (SELECT DISTINCT doc_id, k + list_position(hs[k + 1:k2 + 1], list_min(hs[k + 1:k2 + 1])) - 1 AS k FROM e JOIN a USING (doc_id)), "
    "f AS (SELECT doc_id, k, a[k + 1] AS content, list_reverse(a[greatest(1, k - 48):k]) AS l, list_reverse(ns[greatest(1, k - 48):k]) AS ln, a[k + 2:k + 50] AS r, ns[k + 2:k + 50] AS rn FROM fp JOIN a USING (doc_id)), "
    "g AS (SELECT doc_id, k, content, [l[j] FOR j IN range(1, len(l) + 1) IF list_sum(ln[1:j]) < 50] AS l, [r[j] FOR j IN range(1, len(r) + 1) IF list_sum(rn[1:j]) < 50] AS r FROM f), "
    "m AS (SELECT *, first_value(l) OVER s AS sl, first_value(r) OVER s AS sr, row_number() OVER s AS nth FROM g WINDOW s AS (PARTITION BY content ORDER BY doc_id, k)), "
    "x AS (SELECT doc_id, k, len([j FOR j IN range(1, 50) IF j <= len(l) AND j <= len(sl) AND l[1:j] = sl[1:j]]) AS el, len([j FOR j IN range(1, 50) IF j <= len(r) AND j <= len(sr) AND r[1:j] = sr[1:j]]) AS er FROM m WHERE nth > 1), "
    "later AS (SELECT doc_id, k - el AS first, 1 + el + er AS len FROM x UNION ALL "
    "SELECT doc_id, k, 1 FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) AS nth FROM n WHERE norm IN (SELECT norm FROM n GROUP BY norm HAVING count(*) >= 8)) WHERE nth > 1), "
)


def _dedup(head: str, glue: str, name: str) -> str:
    """The parts of ``_DEDUP`` around those of ``head``, which may find the later runs itself."""
    first, later, rest = _DEDUP.format(glue=glue, name=name).split(",\n", 2)
    at = head.index("AS raw FROM p)), ") + len("AS raw FROM p)), ")
    return head[:at] + first + ", " + head[at:] + ("" if "later AS (" in head else later + ",\n") + rest


_OP5 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, c) > 1), (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT s) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM t) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines
FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, CAST(n_words < 10 AS INTEGER) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS INTEGER) + 4 * CAST(10 * n_symbols > 2 * n_words AND n_symbols >= 5 AS INTEGER)
+ 8 * CAST(2 * n_dup_lines > n_lines AND n_lines >= 4 AS INTEGER) + 16 * CAST(word_chars > 25 * n_words AND n_words > 0 AS INTEGER) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 15 = 0 AS kept, failed FROM f"""


def _grams(table: str, key: str, text: str) -> str:
    """Distinct 5-word shingles of a table, as SQL: key, position, content."""
    return (
        f"SELECT {key}, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS c FROM (SELECT {key}, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM "
        f"(SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) WHERE len(w) > 0)"
    )


_OP8 = f"""WITH d AS (SELECT DISTINCT doc_id, c FROM ({_grams('documents', 'doc_id', 'text')})), q AS (SELECT DISTINCT item_id, c FROM ({_grams('benchmark', 'item_id', 'text')})),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared FROM d JOIN q USING (c) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n)"""
_FORMS = "forms AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '" + t.replace("'", "''") + "')" for n, t in licenses.TEMPLATES) + ") AS v(license, template))"
_OP10 = f"""WITH {_FORMS}, d AS ({_grams('documents', 'doc_id', 'text')}), q AS (SELECT DISTINCT license, c FROM ({_grams('forms', 'license', 'template')})),
n AS (SELECT license, count(*) AS n, greatest(4, pow(2, ceil(log2(count(*)))))::BIGINT AS size FROM q GROUP BY license),
x AS (SELECT doc_id, license, n, p // size + o AS win, c FROM d JOIN q USING (c) JOIN n USING (license), (SELECT unnest([0, -1]) AS o)),
y AS (SELECT doc_id, license, n, win, count(DISTINCT c) AS k FROM x WHERE win >= 0 GROUP BY ALL HAVING count(DISTINCT c) >= ceil(0.8 * n))
SELECT doc_id, license, n AS n_shingles, max(k) AS n_shared, min(win) AS first_window FROM y GROUP BY ALL"""
_OP11 = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)"""


def _op13(rounds: int = lloyd.ROUNDS) -> str:
    """Lloyd rounds one after the other: a<i> are the assignments to c<i>, the centroids."""
    sql = """WITH v AS MATERIALIZED (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT vec_id, v, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, m)])::BIGINT AS d FROM v, c{i})
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        if i < rounds:
            sql += f""",
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(q ORDER BY i) AS m FROM (SELECT c, i, CAST((s - ((s % k) + k) % k) // k AS BIGINT) AS q FROM
(SELECT c, i, sum(x)::BIGINT AS s, count(*) AS k FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i)) GROUP BY c) n USING (c))"""
    return sql + f""" SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE: dict[str, str] = {
    "op2_substring_dedup": _dedup(_OP2, "", "n_sentences"),
    "op4_line_dedup": _dedup(_OP4, "\n", "n_lines"),
    "op5_quality_rules": _OP5,
    "op8_decontamination": _OP8,
    "op10_licenses": _OP10,
    "op11_exact_dedup": _OP11,
    "op13_centroid_clustering": _op13(),
}
