"""Queries of labels, retrieval modes and control flow over the driver's tables, added to the catalogue of veridock.plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions import labels
from veridock.operators import graph, modes, rows, sections
from veridock.operators.lineage import placed
from veridock.plans import control
from veridock.plans.queries import BM25, SQL, _bm25, _edges, _geo, _pagerank, query, t

# labels and rendered blocks


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 2 END AS level FROM part""")
def t22_heading_level(spark, sf):
    n, kind = F.col("p_size").cast("string"), F.col("p_size") % 4
    line = F.when(kind == 0, F.concat(F.lit("3."), n, F.lit(". "), F.col("p_name"))).when(kind == 1, F.concat(F.lit("Tabla "), n)).when(kind == 2, F.concat(F.lit("ANEXO "), n)).otherwise(F.col("p_name"))
    return t(spark, sf, "part").select("p_partkey", labels.heading_level(line).alias("level"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '§' || p_size || '.1 · ' || p_name WHEN 1 THEN '§3.1 ' || p_brand || ' › ' || p_name ELSE p_type || ' › ' || p_brand || ' › ' || p_name END AS label FROM part""")
def t23_section_label(spark, sf):
    kind = F.col("p_size") % 3
    brand = F.when(kind == 1, F.concat(F.lit("3.1. "), F.col("p_brand"))).otherwise(F.col("p_brand"))
    number = F.when(kind == 0, F.concat(F.col("p_size").cast("string"), F.lit(".1")))
    return t(spark, sf, "part").select("p_partkey", labels.section_label(F.col("p_name"), number, F.array("p_type", brand, "p_name")).alias("label"))


@query(r"""SELECT doc_id, CAST(len(u) AS INTEGER) AS units, coalesce(list_sum(list_transform(u, lambda x: length(x))), 0) AS chars FROM (
SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: length(b) >= 40 AND NOT starts_with(b, '#')) AS u FROM documents WHERE text IS NOT NULL)""")
def t31_coverage_units(spark, sf):
    d = t(spark, sf, "documents").where("text IS NOT NULL")
    units = labels.coverage_units(F.col("text"))
    return d.select("doc_id", F.size(units).alias("units"), F.aggregate(units, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"))


@query("""
SELECT o_orderkey, '- ' || o_orderkey || ': ' || array_to_string(list_filter([CASE WHEN o_custkey % 3 > 0 THEN 'cust «' || o_custkey || '»' END, 'status «' || o_orderstatus || '»', 'prio «' || o_orderpriority || '»', CASE WHEN o_custkey % 2 > 0 THEN 'c «' || o_custkey || '»' END, 'd «x»', 'e «y»'], lambda x: x IS NOT NULL), '; ') || '.' AS line FROM orders""")
def t32_record_lines(spark, sf):
    cells = [F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).otherwise(" "), F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(F.col("o_custkey") % 2 > 0, F.col("o_custkey").cast("string")).otherwise(""), F.lit("x"), F.lit("y")]
    header = F.array(*map(F.lit, ("order", "cust", "status", "prio", "c", "d", "e")))
    return t(spark, sf, "orders").select("o_orderkey", labels.record_line(header, F.array(*cells)).alias("line"))


@query(r"""SELECT conv_id, turn, role, '- ' || trim(role) || ': ' || substr(replace(regexp_replace(coalesce(text, ''), '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g'), chr(10), ' '), 1, 200) AS line, concat_ws(' ', trim(role), 'said', trim(CAST(turn AS VARCHAR))) AS triple FROM conversations""")
def t28_digest(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", "role", labels.digest(F.col("role"), F.col("text")).alias("line"), labels.linearised(F.col("role"), F.lit("said"), F.col("turn").cast("string")).alias("triple"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, u, 1 AS i, length(u[1]) AS size, 1 AS bins FROM l
  UNION ALL SELECT doc_id, u, i + 1, CASE WHEN size + 1 + length(u[i + 1]) > 400 THEN length(u[i + 1]) ELSE size + 1 + length(u[i + 1]) END, bins + CASE WHEN size + 1 + length(u[i + 1]) > 400 THEN 1 ELSE 0 END FROM f WHERE i < len(u))
SELECT doc_id, max(bins) AS bins FROM f GROUP BY doc_id""")
def w6_pack_budget(spark, sf):
    """Lines packed greedily into pieces of at most 400 characters; a longer line is a piece of its own."""
    d = t(spark, sf, "documents").where("text IS NOT NULL")
    start = F.struct(F.lit(-1).alias("size"), F.lit(0).alias("bins"))

    def step(s, line):
        n = F.length(line)
        full = (s["size"] < 0) | (s["size"] + 1 + n > 400)
        return F.struct(F.when(full, n).otherwise(s["size"] + 1 + n).alias("size"), (s["bins"] + full.cast("int")).alias("bins"))

    return d.select("doc_id", F.aggregate(F.split("text", "\n"), start, step, lambda s: s["bins"]).alias("bins"))


@query("""SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS previous FROM conversations""")
def w12_previous_question(spark, sf):
    return rows.with_previous(t(spark, sf, "conversations"), "conv_id", ["turn", "role"], "text").select("conv_id", "turn", "role", "previous")


# retrieval modes


@query("""
WITH s AS (SELECT q.vec_id % 60 AS q, e.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0),
b AS (SELECT q, vec_id, max(score) AS score FROM s GROUP BY 1, 2),
k AS (SELECT q, vec_id, score, vec_id % 50 AS concept, row_number() OVER (PARTITION BY q, vec_id % 50 ORDER BY score DESC, vec_id) AS n FROM b),
r AS (SELECT q, vec_id, concept, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM k WHERE n = 1),
l AS (SELECT * FROM r WHERE rank <= 40)
SELECT q, vec_id, concept, rank, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE 0.1 + 0.9 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM l WINDOW w AS (PARTITION BY q)""")
def a8_distinct_concepts(spark, sf):
    """Three questions whose keywords are every twentieth vector."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = e.where("id % 20 = 0").select((F.col("id") % 60).alias("id"), "v")
    s = graph.best_scores(e, asked).select(F.col("query").alias("q"), F.col("id").alias("vec_id"), "score")
    got = modes.distinct_concepts(s, "q", "vec_id", F.col("vec_id") % 50, "score")
    return modes.rescaled(got, ["q"], "score").select("q", "vec_id", "concept", "rank", F.round("score", 6).alias("score"))


@query("""
WITH a AS (SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst, 'relation' AS kind, 0 AS o FROM orders UNION ALL
  SELECT 'C' || o_custkey, 'O' || (o_orderkey + 1), 'context', 1 FROM orders UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'synonym', 2 FROM orders WHERE o_orderstatus = 'P'),
n AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, kind, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY o DESC) AS n FROM a)
SELECT src, dst, kind FROM n WHERE n = 1""")
def g1_entity_graph(spark, sf):
    o = t(spark, sf, "orders")
    c, k = F.concat(F.lit("C"), F.col("o_custkey")), lambda i: F.concat(F.lit("O"), F.col("o_orderkey") + i)
    pair = lambda d, a, b: d.select(a.alias("src"), b.alias("dst"))
    return modes.entity_graph(pair(o, c, k(0)), pair(o, c, k(1)), pair(o.where("o_orderstatus = 'P'"), k(0), c)).select("src", "dst", "kind")


RESET = """
WITH p AS (SELECT 'N' || s_nationkey AS node, greatest(s_acctbal, 0) AS mass FROM supplier UNION ALL SELECT 'S' || s_suppkey, greatest(s_acctbal, 0) FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 0.05 * greatest(c_acctbal, 0) FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT node, sum(CAST(mass AS DOUBLE)) AS mass FROM p GROUP BY 1)
SELECT node, round(mass / sum(mass) OVER (), 9) AS mass FROM m"""


@query(RESET)
def a11_reset_mass(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, c = t(spark, sf, "supplier"), t(spark, sf, "customer")
    triples = s.select(name("N", "s_nationkey").alias("subject"), name("S", "s_suppkey").alias("object"), F.col("s_acctbal").cast("double").alias("score"))
    passages = c.select(name("C", "c_custkey").alias("node"), F.col("c_acctbal").cast("double").alias("similarity"))
    nodes = triples.select(F.explode(F.array("subject", "object")).alias("node")).unionAll(c.where("c_custkey % 2 = 0").select(name("C", "c_custkey")))
    return modes.reset_mass(triples, passages, nodes).select("node", F.round("mass", 9).alias("mass"))


@query(f"SELECT substr(node, 2) AS node, rank FROM ({SQL['g5_pagerank']}) WHERE node LIKE 'S%' ORDER BY rank DESC, node LIMIT 20")
def r8_rank_passages(spark, sf):
    return modes.get_mode("hipporag")(_pagerank(spark, sf), "S")


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
h AS (SELECT c_nationkey AS q, c_custkey AS node, c_custkey % 7 AS score FROM customer),
k AS (SELECT q, score, dst - 1000000 AS a, src AS b FROM h JOIN e ON src = node UNION ALL SELECT n_nationkey, 9, dst - 1000000, src FROM nation JOIN e ON src = n_nationkey + 1),
c AS (SELECT q, 'a' || a AS chunk_id, score FROM k UNION ALL SELECT q, 'b' || b, score FROM k),
g AS (SELECT q, chunk_id, max(score) AS score FROM c GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM g) WHERE rank <= 20""")
def g6_traverse(spark, sf):
    e = _edges(spark, sf).distinct().withColumn("sources", F.concat(F.lit("a"), F.col("dst") - 1000000, F.lit("<SEP>b"), F.col("src")))
    h = t(spark, sf, "customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("node"), (F.col("c_custkey") % 7).alias("score"))
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("q"), (F.col("n_nationkey") + 1).alias("src"), F.lit(9).alias("score")).join(e.select("src", "dst"), "src")
    return modes.get_mode("graph")(h, n, e, "q")


@query("""
WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS no FROM orders),
p AS (SELECT no, [o_custkey, o_orderkey + 1000000, o_custkey + 1] AS nodes FROM n),
s AS (SELECT no, unnest(['n' || nodes[1], 'x' || nodes[1] % 4, 'e' || nodes[1], 'n' || nodes[2], 'x' || nodes[2] % 4, 'e' || nodes[3], 'n' || nodes[3], 'x' || nodes[3] % 4]) AS chunk_id, unnest(range(8)) AS i FROM p),
f AS (SELECT chunk_id, min(no * 100 + i) AS o FROM s GROUP BY 1)
SELECT chunk_id, row_number() OVER (ORDER BY o) AS place FROM f ORDER BY o LIMIT 20""")
def r11_path_chunks(spark, sf):
    o = placed(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "path_no")
    paths = o.select("path_no", F.array(F.col("o_custkey").cast("long"), F.col("o_orderkey").cast("long") + 1000000, F.col("o_custkey").cast("long") + 1).alias("nodes"))
    each = paths.select("nodes").withColumn("node", F.explode("nodes"))
    nodes = each.select("node").distinct().withColumn("sources", F.concat(F.lit("n"), "node", F.lit("<SEP>x"), F.col("node") % 4))
    edges = paths.select(F.explode(F.array(F.col("nodes")[0], F.col("nodes")[2])).alias("src"), F.col("nodes")[1].alias("dst")).distinct().withColumn("sources", F.concat(F.lit("e"), "src"))
    return modes.path_chunks(paths, nodes, edges)


@query(BM25 + """,
h AS (SELECT item_id // 3 AS question, item_id % 3 + 1 AS hop, doc_id, score, rank FROM r WHERE rank <= 5),
d AS (SELECT question, doc_id, score, hop * 6 + rank AS pos, row_number() OVER (PARTITION BY question, doc_id ORDER BY hop * 6 + rank) AS n FROM h),
p AS (SELECT question, doc_id, score, row_number() OVER (PARTITION BY question ORDER BY pos) AS place FROM d WHERE n = 1)
SELECT question, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, place) AS rank FROM p) WHERE rank <= 8""")
def r13_multi_query_fan_out(spark, sf):
    h = _bm25(spark, sf).select(F.floor(F.col("item_id") / 3).alias("question"), (F.col("item_id") % 3 + 1).alias("hop"), "doc_id", F.col("score").alias("own"), "rank")
    return modes.get_mode("iterative")(h, "question", "doc_id", F.col("own")).select("question", "doc_id", "score", "rank")


@query("""SELECT p_partkey, substr(CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_type ELSE p_name END, 1, 220) AS shown FROM part""")
def j15_descriptions(spark, sf):
    p = t(spark, sf, "part")
    items = p.select("p_partkey", F.concat_ws("<SEP>", "p_name", "p_type").alias("description"))
    return modes.described(items, p.where("p_size % 2 = 0").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("text")), "p_partkey").select("p_partkey", "shown")


# control flow


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment WHEN c_nationkey % 2 = 0 THEN 'HOUSEHOLD' END AS specialty, (c_acctbal < 0 AND c_nationkey % 3 = 0) AS asks FROM customer""")
def p22_session_gates(spark, sf):
    """The pinned specialty, and whether to ask if this is another patient."""
    state = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).otherwise("")
    context = F.when(F.col("c_nationkey") % 2 == 0, "HOUSEHOLD")
    facts = F.when(F.col("c_nationkey") % 3 == 0, F.create_map(F.lit("k"), F.lit("v")))
    return t(spark, sf, "customer").select("c_custkey", control.pinned_specialty(state, context, F.lit("unknown"), ["BUILDING", "MACHINERY", "HOUSEHOLD"], "BUILDING").alias("specialty"), control.asks_for_patient(F.col("c_acctbal") < 0, facts).alias("asks"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'segment=BUILDING' ELSE 'segment=old' END || CASE WHEN c_nationkey % 3 = 0 THEN ',phone=' || c_name ELSE '' END AS facts,
  CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'segment,' END || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'phone,' END || 'age' AS pending, 1 AS rounds, (c_nationkey % 2 = 0 OR c_nationkey % 3 = 0) AS refining FROM customer""")
def p6_fold_answers(spark, sf):
    n = F.col("c_nationkey")
    replies = F.create_map(F.lit("segment"), F.when(n % 2 == 0, "BUILDING").otherwise(" "), F.lit("phone"), F.when(n % 3 == 0, F.col("c_name")).otherwise(""))
    state = t(spark, sf, "customer").select("c_custkey", F.create_map(F.lit("segment"), F.lit("old")).alias("facts"), F.array(*map(F.lit, ("segment", "phone", "age"))).alias("pending"), F.array().cast("array<string>").alias("asked"), F.lit(0).alias("rounds"), replies.alias("answers"))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("facts"), lambda e: F.concat_ws("=", e["key"], e["value"])), lambda a, b: F.when(a < b, 1).otherwise(-1)), ",")
    return control.fold_answers(state).select("c_custkey", pairs.alias("facts"), F.array_join("pending", ",").alias("pending"), "rounds", "refining")


@query(r"""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g')), lambda x: x <> ''), 1, 3), '|') AS asked FROM documents WHERE text IS NOT NULL""")
def r12_question_cap(spark, sf):
    return t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(control.capped_questions(F.split("text", r"\.")), "|").alias("asked"))


@query(r"""SELECT conv_id, turn, role, CASE WHEN trim(coalesce(text, '')) <> '' THEN 'q' || conv_id || chr(10) || regexp_replace(text, '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g') || ' ' || role END AS focus FROM conversations """)
def p12_refocus(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", control.refocus_query(F.concat(F.lit("q"), F.col("conv_id").cast("string")), F.array(F.col("text"), F.lit(" "), F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("role")))).alias("focus"))


@query("""
SELECT conv_id AS run, turn AS seq, role AS node, unnest(['step', 'state', 'output']) AS event FROM conversations WHERE turn % 3 > 0 AND text <> ''
UNION ALL SELECT conv_id, turn, '__interrupt__', 'interrupt' FROM conversations WHERE turn % 3 > 0 AND text <> '' UNION ALL SELECT conv_id, turn, NULL, 'progress' FROM conversations WHERE turn % 3 = 0 AND text <> ''""")
def p21_progress_events(spark, sf):
    c = t(spark, sf, "conversations").where("text <> ''")
    chunks = c.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 > 0, "updates").otherwise("custom").alias("channel"), F.create_map("role", "text", F.lit("__interrupt__"), F.lit("ask")).alias("updates"))
    return control.progress_events(chunks)


@query("""SELECT count(*) FILTER (toxic = 1) AS false, count(*) AS rejected, count(*) FILTER (toxic = 1) / count(*) AS rate FROM labels WHERE quality = 0""")
def a25_false_rejections(spark, sf):
    records = t(spark, sf, "labels").select(F.when(F.col("quality") == 0, "not_validated").otherwise("answered").alias("outcome"), F.lit("x").alias("rejected_answer"), (F.col("toxic") == 1).alias("agrees"))
    return control.false_rejections(records)


@query("""SELECT lang, avg(quality) AS quality, avg(toxic) AS toxic, avg(n_chars) AS n_chars FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def a23_tier_means(spark, sf):
    own = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.group_means(own, t(spark, sf, "documents"), "doc_id", "lang", ["quality", "toxic", "n_chars"])


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS heads FROM pages WHERE html IS NOT NULL) SELECT page_id, CAST(len(heads) AS BIGINT) AS sections FROM h WHERE len(heads) > 0""")
def c1_page_sections(spark, sf):
    """Headed sections of each page, by the Markdown section parser."""
    p = t(spark, sf, "pages").where("html IS NOT NULL")
    heads = F.regexp_extract_all("html", F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))
    md = F.array_join(F.transform(heads, lambda h: F.concat(F.lit("## h "), F.regexp_replace(h, r"\s+", " "), F.lit("\nbody"))), "\n")
    docs = p.where(F.size(heads) > 0).select(F.col("page_id").alias("doc_id"), md.alias("text"))
    return sections.sections(docs).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("sections"))
