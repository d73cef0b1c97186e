"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm import decontaminate, hard_negatives, lexical, licences, line_dedup, packing, pii, secrets, sharding, simhash, suffix_dedup, topk, toxicity
from tabwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query("op3_shards")
def op3(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_topk", OP4_SQL)
def op4(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _duck_spans(kind: str, order: int, pattern: str, least: int = 1, group: int = 0) -> str:
    text = "coalesce(text, '')"
    return f"""
SELECT doc_id, {order} AS ord, '{kind}' AS kind, a, a + length(hits[i]) AS b FROM (
  SELECT doc_id, hits, parts, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all({text}, '{pattern}', 0) AS hits, regexp_extract_all({text}, '{pattern}', {group}) AS parts, string_split_regex({text}, '{pattern}') AS gaps FROM documents)))
WHERE length(parts[i]) >= {least}"""


OP5_SQL = (
    "WITH spans AS ("
    + " UNION ALL ".join(
        [
            # the base kinds in the contract's words, the others from the rules, which both engines read alike
            _duck_spans("assign", 0, """(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
            _duck_spans("access", 1, "AKIA[A-Z0-9]+", 20),
            _duck_spans("hex", 2, "[0-9a-f]+", 24),
            *[_duck_spans(r.kind, i, r.pattern) for i, r in enumerate(secrets.RULES) if not r.base],
        ]
    )
    + """)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, ord) FILTER (ord < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, ord), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
)


@query("op5_secrets", OP5_SQL)
def op5(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_simhash")
def op7(spark, sf_dir):
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op8_licences")
def op8(spark, sf_dir):
    """Documents lie in the folder of their language, that in the folder of their source."""
    return licences.scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


OP9_SQL = """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
win AS (
  SELECT doc_id, s, 2 AS n, l[s + 1:s + 2] AS w FROM (SELECT doc_id, l, unnest(range(0, len(l) - 1)) AS s FROM doc WHERE len(l) > 1)
  UNION ALL
  SELECT doc_id, s, 1, l[s + 1:s + 1] FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS s FROM doc) WHERE length(l[s + 1]) - length(replace(l[s + 1], ' ', '')) + 1 >= 50),
firsts AS (SELECT w, min((doc_id, s)) AS f FROM win GROUP BY w HAVING count(*) > 1),
later AS (SELECT doc_id, s, n FROM win JOIN firsts USING (w) WHERE doc_id <> f[1] OR s >= f[2] + n),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM later),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_runs FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS t FROM (SELECT doc_id, l[p + 1] AS x, p FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS p FROM doc)) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark, sf_dir):
    left = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__runs").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, w[i:i + least(len(w), 10) - 1] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT l FROM win),
grams AS (SELECT doc_id, l, i, w[i:i + l - 1] AS x FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM doc, sizes WHERE len(w) >= l)),
hits AS (SELECT g.doc_id, g.i, g.l, win.item_id FROM grams g JOIN win ON g.l = win.l AND g.x = win.x),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
doc AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
tot AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM doc),
norm AS (SELECT doc_id, 25 + (75 * n * docs) // l AS m FROM doc, tot),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical", OP11_SQL)
def op11(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_pii")
def op12(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON true WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
      FROM s WHERE label = own AND vec_id <> anchor_id QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score, positive_rank
FROM p JOIN s USING (anchor_id) WHERE s.label <> s.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
