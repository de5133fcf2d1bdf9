"""Queries over the driver's tables, each with the SQL that must give the same rows.

QUERIES maps a name to a function of (spark, sf_dir); SQL maps the same names to DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions import text as tx
from veridock.operators import extraction, graph, modes, rows, selection, sections
from veridock.operators.evidence import is_literal
from veridock.operators.lineage import placed
from veridock.plans import evaluation, gates
from veridock.sources import stores
from veridock.sources.files import pending
from veridock.streaming import sessions
from veridock.streaming.sessions import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


COLLAPSE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


# scans, filters, projections


@query("SELECT doc_id, source, lang FROM documents WHERE source IS NULL OR source = '' OR source = 'src3'")
def f1_scope_filter(spark, sf):
    d = t(spark, sf, "documents")
    return d.where(selection.in_scope(F.col("source"), "src3")).select("doc_id", "source", "lang")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def s11_resume_anti_join(spark, sf):
    return pending(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")


@query("""SELECT conv_id, turn, CASE WHEN coalesce(lower(trim(text)), '') = '' THEN false ELSE left(lower(trim(text)), 2) IN ('s','sí','si','y','ye','1','tr','ok') END AS yes FROM conversations""")
def t33_affirmative(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", rows.affirmative(F.col("text")).alias("yes"))


@query("SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def f14_stratified_sample(spark, sf):
    return selection.top_per_group(t(spark, sf, "documents").select("doc_id", "lang"), ["lang"], [F.col("doc_id")], 5)


@query("SELECT item_id, text FROM benchmark WHERE length(trim(text)) > 0")
def f13_cases_with_reference(spark, sf):
    return t(spark, sf, "benchmark").where(F.length(F.trim("text")) > 0)


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'none') AS tier, coalesce(toxic, 0) AS hops FROM documents LEFT JOIN labels USING (doc_id)")
def n4_default_fill(spark, sf):
    d = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("string").alias("tier"), F.col("toxic").alias("hops"))
    return rows.filled_defaults(d, {"tier": "none", "hops": 0}).select("doc_id", "tier", "hops")


# joins


@query(f"""
WITH k AS (SELECT doc_id, {COLLAPSE} AS key FROM documents),
q AS (SELECT item_id, {COLLAPSE} AS key FROM benchmark UNION ALL SELECT 1000000000 + doc_id, key || CASE WHEN doc_id % 2 = 0 THEN ' …' ELSE '' END FROM k WHERE key IS NOT NULL),
e AS (SELECT item_id, min(doc_id) AS doc_id, 'exact' AS how FROM q JOIN k USING (key) GROUP BY 1),
o AS (SELECT left(key, 120) AS opening, min(doc_id) AS doc_id FROM k GROUP BY 1 HAVING count(*) = 1)
SELECT * FROM e UNION ALL
SELECT q.item_id, o.doc_id, 'prefix' FROM q JOIN o ON left(q.key, 120) = o.opening WHERE q.key NOT IN (SELECT key FROM k)
""")
def j1_text_lookup(spark, sf):
    """Texts to chunks: whole normalised text, else an opening that only one row has."""
    d = t(spark, sf, "documents")
    own = d.select((1000000000 + F.col("doc_id")).alias("item_id"), F.concat(tx.collapse(F.col("text")), F.when(F.col("doc_id") % 2 == 0, " …").otherwise("")).alias("text"))
    asked = t(spark, sf, "benchmark").select("item_id", "text").unionByName(own)
    return selection.lookup_by_text(asked, d.select("doc_id", F.col("text").alias("own")), "text", "own", "doc_id").select("item_id", "doc_id", "how")


@query("""
WITH r AS (SELECT conv_id * 7 + turn AS doc_id, row_number() OVER (ORDER BY conv_id, turn, role) AS pos FROM conversations)
SELECT doc_id, min(pos) AS pos, any_value(source) AS source FROM r JOIN documents USING (doc_id) GROUP BY doc_id
""")
def j2_ids_to_rows(spark, sf):
    order = [F.col("conv_id"), F.col("turn"), F.col("role")]
    r = placed(t(spark, sf, "conversations").select("conv_id", "turn", "role"), order, "pos").select((F.col("conv_id") * 7 + F.col("turn")).alias("doc_id"), F.col("pos").cast("long").alias("pos"))
    return selection.ids_to_rows(r, t(spark, sf, "documents").select("doc_id", "source"), "doc_id", "pos")


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4
""")
def j6_similarity_self_join(spark, sf):
    """Pairs by blocked matrix products."""
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.similar_pairs(v, 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT o_custkey, o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def j7_semi_join(spark, sf):
    c = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rows.members_of(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), c, "o_custkey")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no file' ELSE 'not listed' END AS why
FROM documents d FULL OUTER JOIN (SELECT doc_id + 50 AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def j10_manifest_bijection(spark, sf):
    d, m = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select((F.col("doc_id") + 50).alias("doc_id"))
    return gates.bijection(d, m, "doc_id")


@query(r"""
WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(text)), '[a-zñ]+')) AS token FROM benchmark),
d AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-zñ]+')) AS token FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS name, token, count(*) AS n FROM d ANTI JOIN b USING (token) WHERE token NOT IN ('figura', 'algoritmo', 'tabla', 'omitida', 'omitido', 'p', 'consultar', 'pdf', 'original') GROUP BY 1, 2
""")
def j9_token_oracle(spark, sf):
    """Words of each document that the benchmark's texts, as everyone's reference, don't have."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("markdown"))
    return gates.words_unknown_to(d, t(spark, sf, "benchmark"))


# aggregates


@query(f"""
WITH l AS (
  SELECT 0 AS list_no, doc_id AS pos, {COLLAPSE} AS key, doc_id FROM documents WHERE lang = 'de'
  UNION ALL SELECT 1, doc_id, {COLLAPSE}, doc_id FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY list_no, pos) AS n FROM l)
SELECT doc_id, row_number() OVER (ORDER BY list_no, pos) AS place FROM k WHERE n = 1
""")
def a1_priority_dedup(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", F.col("doc_id").alias("pos"), tx.collapse(F.col("text")).alias("key"))
    return selection.merge_dedup([d.where("lang = 'de'"), d], "key", "pos").select("doc_id", "place")


@query("""
SELECT left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120) AS opening, count(*) AS n, min(doc_id) AS first_id
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def a6_shared_openings(spark, sf):
    return rows.shared_openings(t(spark, sf, "documents"), "text", "doc_id")


@query("""WITH r AS (SELECT source, doc_id, trim(text) AS label, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n FROM documents WHERE text IS NOT NULL)
SELECT source, label, doc_id AS at FROM r WHERE n = 1""")
def a10_longest_form(spark, sf):
    return rows.longest_form(t(spark, sf, "documents").where("text IS NOT NULL"), "source", "text", "doc_id")


@query("SELECT lang, min(n_chars) AS least, median(n_chars) AS middle, avg(n_chars) AS mean, max(n_chars) AS most, count(*) AS n FROM documents GROUP BY lang")
def a16_chunk_stats(spark, sf):
    return rows.size_stats(t(spark, sf, "documents"), "lang", "n_chars")


@query("SELECT count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS tokens, sum(n_chars) * 0.13 / 1000000 AS cost FROM documents")
def a17_cost_estimate(spark, sf):
    return stores.embedding_cost(t(spark, sf, "documents").withColumnRenamed("n_chars", "n_tokens"), 0.13)


@query("""
WITH s AS (SELECT o_custkey, CAST(sum(o_totalprice) AS DOUBLE) AS x FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN max(x) OVER () = min(x) OVER () THEN 1.0 ELSE round(0.1 + 0.9 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) END AS scaled FROM s""")
def a24_rescale(spark, sf):
    s = t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").cast("double").alias("scaled")).withColumn("all", F.lit(0))
    return modes.rescaled(s, ["all"], "scaled").select("o_custkey", F.round("scaled", 6).alias("scaled"))


@query("""
WITH r AS (SELECT doc_id, lang AS tier, n_chars / 1000.0 AS latency, toxic = 1 AS technical, CAST(NULL AS BOOLEAN) AS judge, true AS answered, quality = 1 AS valid, doc_id % 3 <> 0 AS sufficient FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, CASE WHEN technical THEN 'technical_error' WHEN coalesce(judge, false) THEN 'validation_error' WHEN NOT answered THEN 'technical_error' WHEN NOT coalesce(valid, false) THEN 'not_validated' WHEN sufficient THEN 'answered' ELSE 'insufficient' END AS outcome FROM r)
SELECT tier, count(*) AS n, avg(CASE WHEN outcome = 'answered' THEN 1.0 ELSE 0.0 END) AS answered_rate, avg(CAST(latency AS DOUBLE)) AS mean_latency, median(CAST(latency AS DOUBLE)) AS median_latency, max(CAST(latency AS DOUBLE)) AS max_latency FROM o GROUP BY tier""")
def a21_outcomes_by_tier(spark, sf):
    r = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    result = evaluation.outcome(F.col("toxic") == 1, F.lit(None).cast("boolean"), F.lit(True), F.col("quality") == 1, F.col("doc_id") % 3 != 0)
    return evaluation.by_tier(r.select(F.col("lang").alias("tier"), (F.col("n_chars") / 1000.0).alias("latency"), result.alias("outcome")), "tier", "outcome", "latency")


@query("""
WITH f AS (SELECT 'G3' AS code, count(*) AS n FROM (SELECT left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120) FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'G11', count(*) FROM documents WHERE n_chars <> length(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) )
SELECT c AS code, coalesce(n, 0) AS findings, coalesce(n, 0) = 0 AS passed FROM (SELECT unnest(['G2', 'G3', 'G10']) AS c) LEFT JOIN f ON code = c""")
def a26_gate_rollup(spark, sf):
    c = t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.lit("text").alias("content_type"), F.col("n_chars").alias("n_tokens"))
    return gates.rollup(gates.chunk_gates(c).where("code IN ('G2', 'G3', 'G10')"), ["G2", "G3", "G10"])


# windows


@query("""
SELECT doc_id, CASE WHEN count(*) OVER w = 0 THEN '(sin vecinos)' ELSE array_to_string(list_concat(coalesce(list(k) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), []), coalesce(list(k) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), [])), chr(10) || '---' || chr(10)) END AS neighbours
FROM (SELECT doc_id, source, text AS k FROM documents)
WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)""")
def w1_neighbour_texts(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("k"))
    return sections.neighbours(d, "source", "doc_id", "k").select("doc_id", "neighbours")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sec FROM documents)
SELECT doc_id, sec, CASE WHEN sec = 0 THEN 1 ELSE 3 END AS level, CASE WHEN sec = 0 THEN 'Preámbulo' ELSE '2.' || sec || '. Tema' END AS heading, CASE WHEN sec = 0 THEN 'Preámbulo' ELSE '2.' || sec || '. Tema' END AS path,
  CASE WHEN sec > 0 THEN '2.' || sec END AS section_number, regexp_replace(line, '^\s+|\s+$', '', 'g') AS body FROM l WHERE sec > 0 OR regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''""")
def w3_section_ids(spark, sf):
    """Every line of a text under a heading of its own."""
    md = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("### 2."), i.cast("string"), F.lit(". Tema\n"), x))), "\n")
    own = sections.sections(t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", md.alias("text")))
    return own.select("doc_id", F.col("sec").cast("long").alias("sec"), F.col("level").cast("int").alias("level"), "heading", F.array_join("breadcrumb", ">").alias("path"), "section_number", "body")


@query("""
WITH l AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN '' ELSE text END AS v FROM conversations),
c AS (SELECT *, CASE WHEN v <> '' THEN v END AS carry FROM l)
SELECT conv_id, turn, CASE WHEN v = '' THEN coalesce(last_value(carry IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') ELSE v END AS filled FROM c""")
def w4_fill_down(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, "").otherwise(F.col("text")).alias("v"))
    return extraction.fill_down(c, ["conv_id"], "turn", "v").select("conv_id", "turn", "filled")


@query("""
WITH t AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations),
p AS (SELECT *, n % 3 AS a, sum(CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS patient, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM t)
SELECT conv_id, turn, previous, """ + ", ".join(f"last_value(CASE WHEN a = {i} THEN n END IGNORE NULLS) OVER w AS k{i}" for i in range(3)) + """ FROM p
WINDOW w AS (PARTITION BY conv_id, patient ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w11_session_facts(spark, sf):
    n = F.length("text").cast("long")
    turns = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.col("text").alias("question"), F.concat(F.lit("k"), (n % 3).cast("string")).alias("attr"), n.cast("string").alias("value"), (n % 5 == 0).alias("reset"))
    own = sessions.session_facts(turns)
    return own.select(F.col("session_id").cast("long").alias("conv_id"), "turn", "previous", *[F.element_at("facts", F.lit(f"k{i}")).cast("long").alias(f"k{i}") for i in range(3)])


# ranking


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS score
FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def r1_dense_top_k(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = graph.dense_top_k(e, e.where("id % 20 = 0"), 5)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


BM25 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
i AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1),
s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM i WHERE term IN (SELECT term FROM q) GROUP BY 1),
b AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
      FROM q JOIN f USING (term) JOIN i USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b)
"""


def _bm25(spark, sf):
    d, q = t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark").select("item_id", "text")
    return selection.bm25(d, q, "doc_id", "item_id", "text", 30)


@query(BM25 + "SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 30")
def v8_bm25_top_k(spark, sf):
    return _bm25(spark, sf).select("item_id", "doc_id", "score", "rank")


COSINE = "round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6)"
HYBRID = BM25 + f""", g AS (SELECT doc_id FROM documents WHERE source IS NULL OR source = '' OR source = 'src3'),
v AS (SELECT q.vec_id AS item_id, e.vec_id AS doc_id, {COSINE} AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings e ON true WHERE e.vec_id IN (SELECT doc_id FROM g)),
h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM v
  UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) FROM r WHERE doc_id IN (SELECT doc_id FROM g)),
u AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM h WHERE rank <= 30 GROUP BY 1, 2),
y AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM u)
"""


def _hybrid(spark, sf, k):
    """Dense hits (the vectors of questions and documents are those of their ids) and BM25 hits, each in scope before it is cut, fused."""
    d, q = t(spark, sf, "documents"), t(spark, sf, "benchmark")
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    scope = d.select("doc_id", F.col("source").alias("specialty"))
    inside = e.join(scope.where(selection.in_scope(F.col("specialty"), "src3")).select(F.col("doc_id").alias("id")), "id", "left_semi")
    dense = graph.dense_top_k(inside, e.join(q.select(F.col("item_id").alias("id")), "id", "left_semi"), 30).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score")
    sparse = selection.bm25(d, q, "doc_id", "item_id", "text", 30, among=selection.in_scope(F.col("source"), "src3")).drop("rank")
    return selection.hybrid(dense, sparse, "item_id", "doc_id", k, scope, "src3").select("item_id", "doc_id", "score", "rank")


@query(HYBRID + "SELECT * FROM y WHERE rank <= 10")
def r2_hybrid_rrf(spark, sf):
    return _hybrid(spark, sf, 10)


@query(HYBRID + r""", x AS (SELECT y.item_id, y.doc_id, y.rank, list_distinct(string_split(trim(regexp_replace(strip_accents(lower(b.text)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS bw, list_distinct(string_split(trim(regexp_replace(strip_accents(lower(d.text)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS dw
  FROM y JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = y.doc_id WHERE rank <= 20),
z AS (SELECT item_id, doc_id, CAST(len(list_filter(list_intersect(bw, dw), lambda x: x <> '')) AS INTEGER) AS score, rank FROM x),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS place FROM z)
SELECT * FROM o WHERE place <= 5""")
def r6_baseline_shot(spark, sf):
    """Hybrid candidates ranked anew by the words they share with the question, over whole texts."""
    found = _hybrid(spark, sf, 20).join(t(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(t(spark, sf, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    own = selection.rerank(found.where("rank <= 20"), "item_id", "question", "text", selection.shared_words, ["rank"], 5, chars=1 << 24)
    return own.select("item_id", "doc_id", "score", "place")


@query("""
WITH p AS (SELECT doc_id, source, n_chars, doc_id AS pos, 0 AS list_no FROM documents WHERE lang = 'en' AND n_chars < 5000 UNION ALL SELECT doc_id, source, n_chars, n_chars, 1 FROM documents WHERE n_chars > 4000),
k AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY list_no, pos) AS n FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY list_no, pos, doc_id) AS place FROM k WHERE n = 1)
SELECT source, doc_id, score, rank FROM (SELECT source, doc_id, n_chars % 97 AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97 DESC, place, doc_id) AS rank FROM m) WHERE rank <= 8""")
def r3_house_tail(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    own = d.where("n_chars < 5000").join(t(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").withColumn("pos", F.col("doc_id") * 1000000)
    more = d.where("n_chars > 4000").withColumn("pos", F.col("n_chars") * 1000000 + F.col("doc_id"))
    return selection.house_tail(own, more, F.col("n_chars") % 97, "doc_id", "pos", "source").select("source", "doc_id", "score", "rank")


# text


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[_*`\\]', '', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS cited, strip_accents(lower(text)) AS folded FROM documents")
def t1_text_forms(spark, sf):
    x = F.col("text")
    return t(spark, sf, "documents").select("doc_id", tx.collapse(x).alias("norm"), tx.citation_form(x).alias("cited"), tx.fold(x).alias("folded"))


@query("SELECT doc_id, left(sha1(doc_id || chr(0) || source || chr(0) || text), 16) AS chunk_id FROM documents")
def v5_content_id(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.content_id(F.col("doc_id"), F.col("source"), F.col("text")).alias("chunk_id"))


@query(r"""SELECT doc_id, list_distinct_ordered FROM (SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ',') AS list_distinct_ordered FROM documents)""")
def t21_numbers(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(rows.figures_of(F.col("text")), ",").alias("list_distinct_ordered"))


@query(r"""
SELECT c.conv_id, c.turn, contains(lower(trim(regexp_replace(regexp_replace(b.text, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))), lower(trim(regexp_replace(regexp_replace(c.text, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')))) AS literal
FROM (SELECT conv_id, turn, regexp_replace(text, '[_*`\\]', '', 'g') AS text FROM conversations) c JOIN benchmark b ON b.item_id = c.conv_id""")
def v1_literal_quotes(spark, sf):
    b = t(spark, sf, "benchmark").select(F.col("item_id").alias("conv_id"), F.col("text").alias("body"))
    return t(spark, sf, "conversations").join(b, "conv_id").select("conv_id", "turn", is_literal(F.col("text"), F.col("body")).alias("literal"))


# graphs


@query("""
WITH e AS (SELECT DISTINCT least(o_custkey, 1000000 + l_suppkey) AS src, greatest(o_custkey, 1000000 + l_suppkey) AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node""")
def g2_degree(spark, sf):
    return graph.degree(graph.undirected(_edges(spark, sf)))


def _edges(spark, sf):
    o, l = t(spark, sf, "orders").select("o_orderkey", "o_custkey"), t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return o.join(l, "o_orderkey").select(F.col("o_custkey").alias("src"), (1000000 + F.col("l_suppkey")).alias("dst"))


GEO = """
WITH RECURSIVE e AS (SELECT DISTINCT 'N' || s_nationkey AS src, 'S' || s_suppkey AS dst FROM supplier UNION SELECT DISTINCT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1),
seeds AS (SELECT 'R' || r_regionkey AS node FROM region UNION ALL SELECT 'S' || s_suppkey FROM supplier),
"""


def _geo(spark, sf):
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = s.select(name("N", "s_nationkey").alias("src"), name("S", "s_suppkey").alias("dst")).unionAll(n.select(name("N", "n_nationkey"), name("R", "n_regionkey")))
    seeds = t(spark, sf, "region").select(name("R", "r_regionkey").alias("node")).unionAll(s.select(name("S", "s_suppkey")))
    return graph.undirected(e), seeds


@query(GEO + """
p AS (
  SELECT [node] AS nodes, node AS tip, CAST(1.0 AS DOUBLE) AS resource, CAST(1.0 AS DOUBLE) AS total, 0 AS hops FROM seeds
  UNION ALL
  SELECT list_append(nodes, b.dst), b.dst, 0.7 * resource / d.degree, total + 0.7 * resource / d.degree, hops + 1
  FROM p JOIN b ON b.src = p.tip JOIN d ON d.node = p.tip
  WHERE hops < 4 AND 0.7 * resource / d.degree >= 0.01 AND NOT list_contains(nodes, b.dst))
SELECT array_to_string(nodes, '>') AS path, round(total / hops, 6) AS flow FROM p WHERE hops > 0 AND tip IN (SELECT node FROM seeds)""")
def g3_flow_paths(spark, sf):
    e, seeds = _geo(spark, sf)
    return graph.flow_paths(e, seeds).select(F.array_join("nodes", ">").alias("path"), F.round("flow", 6).alias("flow"))


RANK = GEO + """
m AS (SELECT node, 1.0 / count(*) OVER () AS mass FROM seeds),
n AS (SELECT node, count(*) OVER () AS nodes FROM (SELECT DISTINCT src AS node FROM b)),
w AS (SELECT b.src, b.dst, d.degree FROM b JOIN d ON d.node = b.src),
r AS (SELECT 0 AS i, node, CAST(1.0 AS DOUBLE) / nodes AS rank FROM n
  UNION ALL SELECT i + 1, w.dst, 0.85 * sum(r.rank / w.degree) + 0.15 * coalesce(any_value(m.mass), 0) FROM r JOIN w ON w.src = r.node LEFT JOIN m ON m.node = w.dst WHERE i < 100 GROUP BY i, w.dst),
c AS (SELECT a.i, sum(abs(a.rank - o.rank)) AS change FROM r a JOIN r o ON o.node = a.node AND o.i = a.i - 1 GROUP BY a.i),
s AS (SELECT min(i) AS i FROM c WHERE change < 1e-6 * (SELECT max(nodes) FROM n))
SELECT node, round(rank, 9) AS rank FROM r JOIN s USING (i)"""


def _pagerank(spark, sf):
    """PageRank of the places, as far as the reference's tolerance."""
    e, seeds = _geo(spark, sf)
    n = seeds.agg(F.count("*").alias("n"))
    return graph.converged_pagerank(e, seeds.join(F.broadcast(n)).select("node", (1.0 / F.col("n")).alias("mass"))).select("node", F.round("rank", 9).alias("rank"))


@query(RANK)
def g5_pagerank(spark, sf):
    return _pagerank(spark, sf)


# more text, rows and sets


@query(r"""SELECT page_id, CAST(length(regexp_extract_all(html, '<[a-z]+')) AS BIGINT) AS tags, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, sha256(html) AS digest FROM pages""")
def n1_page_projection(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit("<[a-z]+")).cast("long").alias("tags"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.sha2("html", 256).alias("digest"))


@query("""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn, role) AS roles FROM conversations""")
def w14_provenance_numbers(spark, sf):
    own = rows.numbered(t(spark, sf, "conversations"), "conv_id", ["turn", "role"], "role")
    return own.select("conv_id", "turn", "n", F.col("upto").alias("roles"))


@query("""WITH o AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_chars AS later FROM documents)
SELECT source, doc_id FROM o WHERE later = 0 OR later + n_chars <= 8000""")
def w5_tail_within_budget(spark, sf):
    """Last rows of each group up to a budget, one at least."""
    w = Window.partitionBy("source").orderBy(F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    o = t(spark, sf, "documents").withColumn("upto", F.sum("n_chars").over(w))
    return o.where("upto = n_chars OR upto <= 8000").select("source", "doc_id")


@query("""WITH a AS (SELECT l_partkey AS token, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS token, count(*) AS kept FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT sum(least(n, coalesce(kept, 0))) / sum(n) AS share FROM a LEFT JOIN b USING (token)""")
def a20_kept_share(spark, sf):
    l = t(spark, sf, "lineitem").withColumnRenamed("l_partkey", "token")
    return extraction.kept_share(l.where("l_returnflag = 'R'"), l.where("l_linestatus = 'F'"))


@query("""SELECT source, topic, min(doc_id) AS first_id FROM (SELECT source, lang AS topic, doc_id FROM documents) GROUP BY 1, 2""")
def a13_ordered_distinct(spark, sf):
    return t(spark, sf, "documents").groupBy("source", F.col("lang").alias("topic")).agg(F.min("doc_id").alias("first_id"))


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL THEN p_name ELSE p_name || ' (' || p_size || ')' END AS provenance, list_contains(['Brand#11', 'Brand#12'], p_brand) AS tagged FROM part""")
def t24_provenance(spark, sf):
    return t(spark, sf, "part").select("p_partkey", tx.provenance(F.col("p_name"), F.col("p_size")).alias("provenance"), F.col("p_brand").isin("Brand#11", "Brand#12").alias("tagged"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'fallback' WHEN c_mktsegment = 'BUILDING' THEN 'evidence' WHEN c_nationkey >= 2 THEN 'fallback' ELSE 'refocus' END AS next FROM customer""")
def p11_route_validation(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", evaluation.next_step(F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey")).alias("next"))


@query("""SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
def u2_set_difference(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("n")).subtract(t(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query(r"""WITH l AS (SELECT doc_id, 'd' || (doc_id // 20) AS d, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT d, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '', 'g'), '\s+', ' ', 'g'))) AS key, count(DISTINCT doc_id) AS n FROM l GROUP BY 1, 2)
SELECT d, key, n FROM k WHERE n >= 2 AND length(key) > 12""")
def a19_running_heads(spark, sf):
    l = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20).cast("string")).alias("d"), F.explode(F.split("text", "\n")).alias("line"))
    return l.groupBy("d", extraction.head_key(F.col("line")).alias("key")).agg(F.countDistinct("doc_id").alias("n")).where("n >= 2 AND length(key) > 12")


# streams


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def p21_event_windows(spark, sf):
    return event_windows(t(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT event_type, median(value) AS middle, avg(value) AS mean, max(value) AS most, sum(value) AS total FROM events GROUP BY event_type""")
def a22_latency_stats(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.median("value").alias("middle"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.sum("value").alias("total"))
