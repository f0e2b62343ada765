"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, line_dedup, minhash, packing, quality_cnn, secret_scan, spelling, token_counts, token_files, topk, toxicity
from ..sources.shared import drop_at_exit, fresh_folder
from .common import documents, table
from .encoding import vocabulary


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs on one ledger: over an earlier state of the corpus (half of the documents), then over all
    of them, which scans what the first has not seen; the result is that of the second."""
    docs, ledger = documents(spark, sf_dir), fresh_folder(spark, "secret-ledger")
    drop_at_exit(spark, ledger)
    secret_scan.update_ledger(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    found = secret_scan.secret_scan(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), F.col("_emptied").alias("emptied"), "text"
    )


OP9_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(lines[i + 1:i + 3], chr(10)) AS win
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 1))) AS i FROM l)
),
g AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM w WHERE regexp_matches(win, '\S')
),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM g WHERE nth > 1),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM l),
k AS (
  SELECT e.doc_id, count(*) AS n_lines, count(cov.i) AS n_removed,
         coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE cov.i IS NULL), '') AS text
  FROM e LEFT JOIN cov ON e.doc_id = cov.doc_id AND e.i = cov.i GROUP BY e.doc_id
)
SELECT doc_id, n_lines, n_removed, n_removed = n_lines AS emptied, text FROM k
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op9_line_dedup": op9_line_dedup,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op9_line_dedup": OP9_SQL}


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=2).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES["op10_minhash"] = op10_minhash


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


QUERIES |= {"op4_best_fit_packing": op4_best_fit_packing, "op6_token_files": op6_token_files}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", F.col("_severity").alias("expected_severity"), F.col("_p_toxic").alias("p_toxic"), F.col("_toxic").alias("toxic"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_tokens_before", "n_tokens", "n_encoded")


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels"), allowed=quality_cnn.fold(F.col("doc_id")) != 0)
    scored = quality_cnn.score(docs, net)
    return scored.select("doc_id", F.coalesce(quality_cnn.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", F.round("similarity", 4).alias("similarity"), "start_word", "stop_word")


QUERIES |= {"op2_toxicity": op2_toxicity, "op3_token_counts": op3_token_counts, "op7_quality_cnn": op7_quality_cnn, "op8_decontamination": op8_decontamination}


def _spans_sql(rank: int, rule: secret_scan.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (
        f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, length(m[i]) AS n, length(v[i]) AS held, {rule.least} AS least, "
        "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d))"
    )


ORACLE_SQL["op5_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, rank, kind, start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS span FROM ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(secret_scan.RULES))}) WHERE held >= least),
j AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""

ORACLE_SQL["op10_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT s.doc_id, n, unnest(s) AS g FROM s JOIN n USING (doc_id)),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
),
l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)),
links AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT links.y, reach.root FROM reach JOIN links ON reach.doc_id = links.x),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


QUERIES["op11_top_k"] = op11_top_k
ORACLE_SQL["op11_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir))


QUERIES["op12_spelling_variants"] = op12_spelling_variants


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


QUERIES["op13_divergence"] = op13_divergence
ORACLE_SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS held FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(held) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(c.n)::HUGEINT AS total FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)
),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM u
QUALIFY part = 'pair' OR rank <= 200
"""
