"""Queries of citations, gates, assembly, linking, control flow and stores over the driver's tables, added to the catalogue of veridock.plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.functions import text as tx
from veridock.operators import assembly, citations, graph, linking, rows, selection
from veridock.plans import control, evaluation, gates
from veridock.plans.queries import query, t
from veridock.sources import stores

# text


@query(r"""
WITH x AS (SELECT doc_id, '4.' || doc_id || '. ' || coalesce(text, '') || ' , (A-II) (**B-I**) (A-II) ﬁn' || chr(10) || chr(10) || chr(10) || chr(10) || '- a: b )' AS x FROM documents),
l AS (SELECT doc_id, x, replace(replace(replace(replace(replace(x, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl') AS y FROM x)
SELECT doc_id, y AS ligatures, regexp_replace(lower(x), '[^0-9a-záéíóúüñ]+', '', 'g') AS alnum,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+([,.;:)])', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS tidy,
  trim(regexp_replace(y, '\s+', ' ', 'g')) AS cell, 'A-II,B-I' AS grades, '4.' || doc_id AS number, true AS tabular FROM l""")
def t4_text_forms(spark, sf):
    x = F.concat(F.lit("4."), F.col("doc_id"), F.lit(". "), F.coalesce("text", F.lit("")), F.lit(" , (A-II) (**B-I**) (A-II) ﬁn\n\n\n\n- a: b )"))
    d = t(spark, sf, "documents").select("doc_id", x.alias("x"))
    y = F.col("x")
    return d.select("doc_id", tx.expand_ligatures(y).alias("ligatures"), tx.alnum(y).alias("alnum"), tx.tidy(y).alias("tidy"), tx.clean_cell(y).alias("cell"), F.array_join(tx.grades(y), ",").alias("grades"), tx.section_number(y).alias("number"), tx.has_tabular_content(y).alias("tabular"))


@query(r"""
WITH x AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' VIH y carga viral' WHEN 1 THEN ' virus humano (VIH)' ELSE ' CV' END AS x, '2.' || doc_id % 3 || '.1' AS a, '2.' || doc_id % 2 || '.5' AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(replace(replace(strip_accents(lower(x)), 'carga viral', 'cv'), 'virus humano', 'vih'), '[^a-z0-9]+', ' ', 'g')), ' '))), ' ') AS key,
  CASE WHEN contains(x, 'VIH') AND NOT contains(strip_accents(lower(x)), 'virus humano') THEN replace(y, 'VIH', 'virus humano (VIH)') ELSE y END AS expanded, CASE WHEN doc_id % 3 = doc_id % 2 THEN '2.' || doc_id % 2 ELSE '2' END AS common
FROM (SELECT *, x AS y FROM x)""".replace("FROM (SELECT *, x AS y FROM x)", "FROM (SELECT doc_id, a, b, x, CASE WHEN contains(x, 'CV') AND NOT contains(strip_accents(lower(x)), 'carga viral') AND NOT contains(x, 'VIH') THEN replace(x, 'CV', 'carga viral (CV)') ELSE x END AS y FROM x)"))
def t5_abbreviations(spark, sf):
    names = [("VIH", "virus humano"), ("CV", "carga viral")]
    kind = F.col("doc_id") % 3
    x = F.concat(F.coalesce("text", F.lit("")), F.when(kind == 0, " VIH y carga viral").when(kind == 1, " virus humano (VIH)").otherwise(" CV"))
    two = F.array(F.concat(F.lit("2."), kind, F.lit(".1")), F.concat(F.lit("2."), F.col("doc_id") % 2, F.lit(".5")))
    d = t(spark, sf, "documents").select("doc_id", x.alias("x"), two.alias("two"))
    key = F.array_join(F.array_sort(F.split(tx.canonical_key(F.col("x"), names), " ")), " ")
    return d.select("doc_id", key.alias("key"), tx.expand_abbreviations(F.col("x"), names).alias("expanded"), tx.common_section_number(F.col("two")).alias("common"))


@query("""
WITH h AS (SELECT c_custkey, lower(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name))) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def v6_stable_uuid(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", tx.stable_uuid(F.col("c_name")).alias("id"))


# gates

GATES = r"""
WITH s AS (SELECT doc_id, 'd' || doc_id AS name, coalesce(text, '') || CASE doc_id % 6
    WHEN 0 THEN chr(10) || '> _[Figura omitida — p. 3 — consultar PDF original]_' || chr(10) || '> _[Tabla omitida — p. 4 — consultar PDF original]_' WHEN 1 THEN chr(10) || '[tabla omitida]'
    WHEN 2 THEN chr(10) || '## Tabla 1. X' || chr(10) || '| a |' WHEN 3 THEN chr(10) || '**Tabla 2. Y' || chr(10) || 'nada' WHEN 4 THEN ' dosis (A-II). sigue _ _ (AI-AII)' ELSE ' ﬁn ﬂ' END AS md,
  CASE WHEN doc_id % 7 > 0 THEN coalesce(text, '') || ' dosis' END AS ref FROM documents),
w AS (SELECT name, unnest(regexp_extract_all(replace(replace(strip_accents(lower(md)), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[a-zñ]+')) AS token FROM s WHERE ref IS NOT NULL),
k AS (SELECT name, unnest(regexp_extract_all(strip_accents(lower(ref)), '[a-zñ]+')) AS token FROM s),
f AS (
  SELECT 'G1' AS code, count(*) FILTER (WHERE length(regexp_extract_all(md, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s\x0B\x85\p{Z}]')) > 900) AS n FROM s
  UNION ALL SELECT 'G2', count(*) FILTER (WHERE trim(md) = '') FROM s
  UNION ALL SELECT 'G3', count(*) FROM (SELECT left(trim(regexp_replace(md, '\s+', ' ', 'g')), 120) FROM s GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'G4', 1 * count(*) FROM s WHERE doc_id % 6 IN (0, 1)
  UNION ALL SELECT 'G5', (SELECT count(*) FROM s WHERE ref IS NULL) + (SELECT 2 * count(*) FROM s WHERE doc_id % 6 = 5) + (SELECT count(*) FROM (SELECT DISTINCT name, token FROM w ANTI JOIN k USING (name, token) WHERE token NOT IN ('figura', 'algoritmo', 'tabla', 'omitida', 'omitido', 'p', 'consultar', 'pdf', 'original')))
  UNION ALL SELECT 'G6', 3 * count(*) FROM s WHERE doc_id % 6 = 4
  UNION ALL SELECT 'G7', count(*) FROM s WHERE doc_id % 6 = 3
  UNION ALL SELECT 'G9', (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) + (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id))
  UNION ALL SELECT 'G10', count(*) FROM s WHERE doc_id % 2 = 0 AND doc_id % 6 <> 2
  UNION ALL SELECT 'G11', count(*) FILTER (WHERE length(regexp_extract_all(md, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s\x0B\x85\p{Z}]')) <> 7) FROM s)
SELECT code, n AS findings, n = 0 AS passed FROM f"""


@query(GATES)
def q_gate_findings(spark, sf):
    """Ten gates over every document, each with something to find."""
    kind = F.col("doc_id") % 6
    extra = F.when(kind == 0, "\n> _[Figura omitida — p. 3 — consultar PDF original]_\n> _[Tabla omitida — p. 4 — consultar PDF original]_").when(kind == 1, "\n[tabla omitida]").when(kind == 2, "\n## Tabla 1. X\n| a |").when(kind == 3, "\n**Tabla 2. Y\nnada").when(kind == 4, " dosis (A-II). sigue _ _ (AI-AII)").otherwise(" ﬁn ﬂ")
    d = t(spark, sf, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    s = d.select("doc_id", name.alias("name"), F.concat(F.coalesce("text", F.lit("")), extra).alias("markdown"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" dosis"))).alias("reference"))
    c = s.select(F.col("doc_id").alias("chunk_id"), "name", F.col("markdown").alias("text"), F.when(F.col("doc_id") % 2 == 0, "table").otherwise("heading").alias("content_type"), F.lit(7).alias("n_tokens"))
    found = gates.chunk_gates(c).unionByName(gates.source_gates(s, c, t(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))))
    codes = [x for x in gates.CODES if x != "G8"]
    return gates.rollup(found.where("code <> 'G8'"), codes)


@query(r"""
WITH u AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: length(b) >= 40 AND NOT starts_with(b, '#'))) AS unit FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN left(text, 60) ELSE text END, '\s+', ' ', 'g')) AS hay FROM documents)
SELECT 'd' || doc_id AS name, count(*) AS units, count(*) FILTER (WHERE NOT contains(hay, trim(regexp_replace(unit, '\s+', ' ', 'g')))) AS lost FROM u JOIN c USING (doc_id) GROUP BY 1""")
def q8_coverage(spark, sf):
    d = t(spark, sf, "documents").where("text IS NOT NULL").withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    c = d.select("name", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 60)).otherwise(F.col("text")).alias("text"), F.lit(0).alias("chunk_index"))
    return gates.coverage(d.select("name", F.col("text").alias("markdown")), c)


# citations


@query("""
WITH c AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ref, n_name, n_nationkey FROM nation),
q AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos FROM conversations),
j AS (SELECT conv_id, pos, 'R' || region AS title, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey || '.1' ELSE n_name END AS section, CASE WHEN n_nationkey % 2 = 0 THEN '§' || n_nationkey || '.1 · ' || n_name ELSE n_name END AS label, length(coalesce(text, '')) % 3 = 0 AS missed
  FROM q JOIN c ON region = conv_id % 5 AND ref = turn % 7 + 1)
SELECT conv_id, min(pos) AS place, title, label AS section, CAST(count(*) FILTER (WHERE NOT missed) AS INTEGER) AS quotes, bool_or(missed) AND count(*) FILTER (WHERE NOT missed) = 0 AS consulted_only FROM j GROUP BY conv_id, title, section, label""")
def a5_cited_sources(spark, sf):
    """Each turn quotes one of its region's nations; references 6 and 7 point nowhere."""
    n = t(spark, sf, "nation")
    chunk = F.struct(F.concat(F.lit("R"), F.col("n_regionkey")).alias("doc_title"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.col("n_nationkey").cast("string"), F.lit(".1"))).alias("section_number"), F.col("n_name").alias("heading"), F.array().cast("array<string>").alias("section_path"), F.lit(2000).alias("year"), F.lit("o").alias("organization"))
    regions = rows.group_ordered(n.withColumn("chunk", chunk), "n_regionkey", "n_nationkey", "chunk")
    c = t(spark, sf, "conversations")
    used = rows.group_ordered(c.withColumns({"at": F.struct("turn", "role"), "q": F.struct((F.col("turn") % 7 + 1).alias("ref"), F.coalesce("text", F.lit("")).alias("quote"))}), "conv_id", "at", "q").withColumnRenamed("values", "sources")
    contexts = used.select("conv_id", (F.col("conv_id") % 5).alias("n_regionkey")).join(regions, "n_regionkey").select("conv_id", F.col("values").alias("chunks"))
    met = citations.quoted_chunks(used, contexts, "conv_id").select("conv_id", "pos", "quote", "chunk.*")
    met = met.withColumns({"status": F.when(F.length("quote") % 3 == 0, "miss").otherwise("exact"), "sentence": F.col("quote"), "grades": F.array().cast("array<string>")})
    return citations.sources_of(met, "conv_id").select("conv_id", F.col("place").cast("long").alias("place"), "title", "section", F.size("citations").alias("quotes"), "consulted_only")


@query("""
WITH l AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN '§' || (turn % 4) || ' · ' || role ELSE role END || CASE WHEN turn % 3 > 0 THEN ' (' || (2000 + turn % 3) || ')' ELSE '' END AS label, min(turn * 10 + length(role)) AS pos FROM conversations GROUP BY 1, 2)
SELECT conv_id, string_agg(label, '|' ORDER BY pos) AS labels FROM l GROUP BY conv_id""")
def t29_sections_read(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", (F.col("turn") * 10 + F.length("role")).alias("at"), F.col("role").alias("heading"), F.when(F.col("turn") % 2 == 0, (F.col("turn") % 4).cast("string")).alias("section_number"), F.array().cast("array<string>").alias("section_path"), F.when(F.col("turn") % 3 > 0, 2000 + F.col("turn") % 3).alias("year"))
    return citations.sections_read(c, "conv_id", "at").select("conv_id", F.array_join("labels", "|").alias("labels"))


@query("""SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 4 < 2""")
def f4_graded_recommendations(spark, sf):
    grades = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("B-I"), F.lit("A-II"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("A-I"))).otherwise(F.array(F.lit("C-III")))
    c = t(spark, sf, "documents").withColumns({"content_type": F.when(F.col("lang") == "en", "recommendations").otherwise("text"), "evidence_grades": grades})
    return selection.graded_recommendations(c).select("doc_id")


@query("""SELECT source, string_agg(lang, ',' ORDER BY pos) AS langs FROM (SELECT source, lang, min(doc_id) AS pos FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY source""")
def a13_topics_in_order(spark, sf):
    return rows.ordered_distinct(t(spark, sf, "documents"), "source", "lang", "doc_id").select("source", F.array_join("values", ",").alias("langs"))


# assembly


@query("""
WITH n AS (SELECT l_returnflag AS doc_id, round(CAST(l_discount AS DOUBLE) * 100, 1) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT doc_id, s AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS r FROM n) WHERE r = 1""")
def a18_body_size(spark, sf):
    return assembly.body_size(t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("doc_id"), (F.col("l_discount").cast("double") * 100).alias("size")))


@query("""
SELECT l_orderkey AS doc_id, l_linenumber AS page, CAST(l_quantity AS DOUBLE) AS top, '> _[Figura omitida — p. ' || l_linenumber || ' — consultar PDF original]_' AS text FROM lineitem WHERE CAST(l_quantity AS DOUBLE) * (l_linenumber * 10) / 4000.0 >= 0.04""")
def f11_figures(spark, sf):
    l = t(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("double")
    images = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(0.0).alias("x0"), q.alias("top"), (F.col("l_linenumber") * 10).cast("double").alias("x1"), (2 * q).alias("bottom"), F.lit(40.0).alias("width"), F.lit(100.0).alias("height"))
    return assembly.figures(images).select("doc_id", "page", "top", "text")


@query("""
WITH b AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place, length(coalesce(text, '')) % 4 AS k, coalesce(text, '') AS text FROM conversations),
h AS (SELECT *, k = 0 AS head, k = 0 AND place % 3 = 0 AS bad, 1 + place % 2 AS level FROM b),
w AS (SELECT *, """ + ", ".join(f"max(CASE WHEN bad AND level = {n} THEN place END) OVER w AS b{n}, max(CASE WHEN head AND level <= {n} THEN place END) OVER w AS e{n}" for n in (1, 2)) + """ FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, place FROM w WHERE NOT (coalesce(b1 = e1, false) OR coalesce(b2 = e2, false))""")
def f10_dropped_sections(spark, sf):
    own = rows.numbered(t(spark, sf, "conversations"), "conv_id", ["turn", "role"], "role").withColumn("place", F.col("n"))
    head = F.length(F.coalesce("text", F.lit(""))) % 4 == 0
    b = own.select(F.col("conv_id").alias("doc_id"), "place", F.when(head, "heading").otherwise("text").alias("kind"), F.when(head & (F.col("place") % 3 == 0), "Referencias").otherwise("x").alias("text"), F.when(head, (1 + F.col("place") % 2).cast("int")).alias("level"))
    return assembly.kept_blocks(b).select(F.col("doc_id").alias("conv_id"), "place")


# linking


@query("""
WITH n AS (SELECT o_custkey AS item, 'c' || o_orderkey % 50 AS chunk_id FROM orders UNION SELECT o_custkey, 'd' || o_orderkey % 40 FROM orders),
e AS (SELECT least('a' || o_custkey % 9, 'b' || o_orderkey % 7) || '|' || greatest('a' || o_custkey % 9, 'b' || o_orderkey % 7) AS item, 'c' || o_orderkey % 50 AS chunk_id FROM orders),
a AS (SELECT CAST(item AS VARCHAR) AS item, chunk_id FROM n UNION SELECT item, chunk_id FROM e)
SELECT chunk_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(item, ',' ORDER BY item)) AS digest, CAST((count(*) + 39) // 40 AS INTEGER) AS batches FROM a GROUP BY chunk_id""")
def j5_items_by_chunk(spark, sf):
    o = t(spark, sf, "orders")
    c, d = F.concat(F.lit("c"), F.col("o_orderkey") % 50), F.concat(F.lit("d"), F.col("o_orderkey") % 40)
    nodes = o.select(F.col("o_custkey").cast("string").alias("node"), F.concat_ws("<SEP>", c, d).alias("sources"))
    edges = o.select(F.concat(F.lit("b"), F.col("o_orderkey") % 7).alias("src"), F.concat(F.lit("a"), F.col("o_custkey") % 9).alias("dst"), c.alias("sources"))
    items = linking.items_by_chunk(nodes, edges)
    batches = linking.description_batches(items).groupBy("chunk_id").agg((F.max("batch") + 1).alias("batches"))
    return items.join(batches, "chunk_id").select("chunk_id", F.size("items").alias("n"), F.md5(F.array_join("items", ",")).alias("digest"), "batches")


@query("""SELECT p_brand AS item, min_by(p_name, p_partkey) AS text FROM part GROUP BY 1""")
def s12_first_descriptions(spark, sf):
    records = t(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.create_map("p_brand", "p_name").alias("descriptions"))
    return linking.first_descriptions(records)


@query("""
WITH s AS (SELECT q.vec_id AS query, e.vec_id AS triple, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, triple) AS rank FROM s)
SELECT * FROM r WHERE rank <= 5 AND (query % 3 = 0 OR (rank - 1) IN (0, 2))""")
def r7_linked_triples(spark, sf):
    """The five nearest triples; the judge keeps places 0, 2 and 9, and fails on every third question."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("triple"), F.col("embedding").alias("v"))
    q = e.where("triple % 20 = 0").withColumnRenamed("triple", "query")
    verdicts = q.select("query", F.when(F.col("query") % 3 > 0, F.array(F.lit(0), F.lit(2), F.lit(9))).alias("keep"))
    return linking.recognised(linking.linked_triples(q, e), verdicts).select("query", "triple", "score", "rank")


@query("""
WITH p AS (SELECT c_nationkey AS q, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, 'C' || c_custkey || '>N' || c_nationkey) AS no FROM customer)
SELECT q, string_agg('- C' || c_custkey || ': cliente' || chr(10) || '    --[]-->' || chr(10) || '  N' || q, chr(10) ORDER BY no) AS map FROM p GROUP BY q""")
def g10_concept_map(spark, sf):
    c = t(spark, sf, "customer")
    node = F.concat(F.lit("C"), F.col("c_custkey"))
    paths = c.select(F.col("c_nationkey").alias("q"), F.array(node, F.concat(F.lit("N"), F.col("c_nationkey"))).alias("nodes"), F.col("c_acctbal").alias("score"))
    items = c.select(node.alias("item"), linking.shown_description(F.lit(""), F.lit(" cliente <SEP>customer")).alias("shown"))
    return linking.concept_map(paths, items, "q")


@query("""SELECT o_orderkey AS chunk_id, 'c' || o_custkey AS subject, 'buys' AS relation, o_orderstatus AS object FROM orders WHERE o_orderkey % 3 > 0""")
def n6_flatten_triples(spark, sf):
    """Triples of every order; on every third the extraction fails."""
    made = lambda _: F.when(F.col("o_orderkey") % 3 > 0, F.array(F.array(F.concat(F.lit("c"), F.col("o_custkey")), F.lit("buys"), F.col("o_orderstatus")), F.array(F.lit("broken"))))
    chunks = t(spark, sf, "orders").withColumns({"chunk_id": F.col("o_orderkey"), "text": F.col("o_orderstatus")})
    own = chunks.select("chunk_id", F.coalesce(made(F.col("text")), F.array().cast("array<array<string>>")).alias("triples"))
    return graph.flatten_triples(own)


# control flow


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR trim(c_mktsegment) = '' THEN c_name ELSE c_mktsegment END AS query, c_custkey % 4 = 0 OR c_nationkey % 2 = 0 AS in_domain,
  CASE WHEN c_custkey % 4 = 0 OR c_nationkey % 2 = 0 THEN 'retrieve' ELSE 'out_of_domain' END AS step, CASE WHEN NOT (c_custkey % 4 = 0 OR c_nationkey % 2 = 0) THEN 'Esta consulta queda fuera del ámbito de ' || c_mktsegment || '.' END AS message FROM customer""")
def p1_rephrase_and_route(spark, sf):
    none = F.array().cast("array<string>")
    model = F.when(F.col("c_custkey") % 4 > 0, F.struct(F.col("c_mktsegment").alias("query"), (F.col("c_nationkey") % 2 == 0).alias("in_domain"), none.alias("facts"), none.alias("modifiers"), F.lit(False).alias("other_patient")))
    own = t(spark, sf, "customer").withColumn("r", control.rephrased(F.col("c_name"), model))
    route = control.domain_route(F.col("r.in_domain"), F.col("c_mktsegment"))
    return own.select("c_custkey", "r.query", "r.in_domain", route["step"].alias("step"), route["message"].alias("message"))


@query("""
WITH x AS (SELECT c_custkey, c_custkey % 5 = 0 AS failed, c_nationkey % 3 > 0 AS enough, c_nationkey % 2 = 0 AS ok, c_mktsegment FROM customer)
SELECT c_custkey, (NOT enough) OR (NOT failed AND ok) AS is_valid, enough AND failed AS error, CASE WHEN enough AND NOT failed THEN 'why' ELSE '' END AS reason, CASE WHEN enough AND NOT failed THEN 1 ELSE 0 END AS claims,
  CASE WHEN NOT ((NOT enough) OR (NOT failed AND ok)) THEN 'Corrige la respuesta anterior: ' || CASE WHEN NOT failed THEN 'why' || chr(10) || '- ' || c_mktsegment ELSE '' END END AS feedback,
  CASE WHEN enough AND failed THEN 'fallback' WHEN (NOT enough) OR (NOT failed AND ok) THEN 'evidence' WHEN c_custkey % 2 + 1 >= 2 THEN 'fallback' ELSE 'refocus' END AS next FROM x""")
def p10_validate(spark, sf):
    judge = F.when(F.col("c_custkey") % 5 > 0, F.struct((F.col("c_nationkey") % 2 == 0).alias("is_valid"), F.lit("why").alias("reason"), F.array(F.lit(" "), F.col("c_mktsegment")).alias("unsupported_claims")))
    own = t(spark, sf, "customer").withColumn("v", control.validated(F.col("c_nationkey") % 3 > 0, judge))
    return own.select("c_custkey", "v.is_valid", "v.error", "v.reason", F.size("v.unsupported_claims").alias("claims"), control.feedback(F.col("v")).alias("feedback"), evaluation.next_step(F.col("v.error"), F.col("v.is_valid"), F.col("c_custkey") % 2 + 1).alias("next"))


@query("""
WITH x AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey % 3 = 0 AS multi, c_nationkey % 4 AS k FROM customer)
SELECT c_custkey, CASE WHEN multi AND k > 0 THEN array_to_string(list_slice([c_mktsegment, 'b', 'c', 'd'], 1, 3), '|') ELSE c_name END AS plan, CASE WHEN k = 1 THEN c_mktsegment END AS next,
  CASE WHEN k <> 2 THEN c_name END AS value, CASE WHEN k = 2 THEN 'retrieve' END AS failed_step, CASE WHEN k = 2 THEN 'ValueError: ' || c_mktsegment END AS technical_detail FROM x""")
def p14_guards_and_plans(spark, sf):
    k = F.col("c_nationkey") % 4
    plan = F.when(k > 0, F.struct((F.col("c_custkey") % 3 == 0).alias("multi_hop"), F.array(F.lit(" "), F.col("c_mktsegment"), F.lit("b"), F.lit("c "), F.lit("d")).alias("queries")))
    verdict = F.when(k < 3, F.struct((k != 1).alias("sufficient"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("next")))
    error = F.when(k == 2, F.struct(F.lit("ValueError").alias("type"), F.coalesce("c_mktsegment", F.lit("")).alias("message"))).when(k == 3, F.struct(F.lit("GraphInterrupt").alias("type"), F.lit("ask").alias("message")))
    g = control.guarded(F.col("c_name"), error, "retrieve")
    return t(spark, sf, "customer").select("c_custkey", F.array_join(control.hop_plan(F.col("c_name"), plan), "|").alias("plan"), control.reflection(verdict).alias("next"), *[g[c].alias(c) for c in ("value", "failed_step", "technical_detail")])


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'rephrase>out_of_domain' ELSE 'rephrase>retrieve>generate>validate>' || CASE c_nationkey % 4 WHEN 0 THEN 'evidence' WHEN 1 THEN 'fallback' WHEN 2 THEN 'refocus>generate>validate>evidence' ELSE 'refocus>generate>validate>fallback' END END AS steps FROM customer""")
def p18_course(spark, sf):
    k = F.col("c_nationkey") % 4
    verdict = lambda e, v: F.struct(e.alias("error"), v.alias("valid"))
    own = t(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5 > 0).alias("in_domain"), F.array(verdict(k == 1, k == 0), verdict(F.lit(False), k == 2), verdict(F.lit(False), F.lit(True))).alias("verdicts"))
    return control.course(own, "c_custkey").select("c_custkey", F.array_join("steps", ">").alias("steps"))


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE turn % 5 WHEN 1 THEN '/nuevo' WHEN 2 THEN '/especialidad x' || turn WHEN 3 THEN '/ver' WHEN 4 THEN '/especialidad' ELSE text END AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS no FROM conversations)
SELECT conv_id, no, CASE turn % 5 WHEN 1 THEN 'new' WHEN 2 THEN 'specialty' WHEN 3 THEN 'show' ELSE 'ask' END AS command, last_value(CASE WHEN turn % 5 = 2 THEN 'x' || turn END IGNORE NULLS) OVER w AS specialty, count(*) FILTER (WHERE turn % 5 = 1) OVER w AS patient FROM c
WINDOW w AS (PARTITION BY conv_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def p23_session_commands(spark, sf):
    k = F.col("turn") % 5
    own = rows.numbered(t(spark, sf, "conversations"), "conv_id", ["turn", "role"], "role")
    x = F.when(k == 1, "/nuevo").when(k == 2, F.concat(F.lit("/especialidad x"), F.col("turn"))).when(k == 3, "/ver").when(k == 4, "/especialidad").otherwise(F.coalesce("text", F.lit("")))
    turns = own.select(F.col("conv_id").alias("session_id"), F.col("n").alias("turn"), x.alias("text"))
    return control.session_commands(turns).select(F.col("session_id").alias("conv_id"), F.col("turn").alias("no"), "command", "specialty", "patient")


@query("""SELECT conv_id, max_by(text, turn * 10 + length(role)) AS text FROM conversations WHERE coalesce(text, '') <> '' GROUP BY 1""")
def w13_last_output(spark, sf):
    return control.last_output(t(spark, sf, "conversations").withColumn("at", F.col("turn") * 10 + F.length("role")), "conv_id", "at", "text")


@query("""
SELECT n_nationkey, 'CONTEXTO:' || chr(10) || '[1] ' || n_name || chr(10) || 'a' || chr(10) || chr(10) || '[2] L' || chr(10) || 'b' || chr(10) || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'DATOS DEL PACIENTE:' || chr(10) || 'edad: ' || n_nationkey || chr(10) || chr(10) ELSE '' END
  || CASE WHEN n_regionkey > 1 THEN 'MAPA CONCEPTUAL (no citable):' || chr(10) || 'm' || chr(10) || chr(10) ELSE '' END || 'PREGUNTAS ABIERTAS:' || chr(10) || '- q' || chr(10) || chr(10) || 'PREGUNTA:' || chr(10) || 'x' AS prompt,
  'Eres de ' || n_name || ' con A = aa y ' || chr(10) || '- T' AS system FROM nation""")
def t30_prompts(spark, sf):
    block = lambda a, b: F.struct(a.alias("label"), F.lit(b).alias("text"))
    facts = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("edad"), F.col("n_nationkey").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    prompt = control.user_prompt(F.lit("x"), F.array(block(F.col("n_name"), "a"), block(F.lit("L"), "b")), facts, F.when(F.col("n_regionkey") > 1, "m"), F.array(F.lit("q"), F.lit(" ")))
    system = control.system_prompt(F.lit("Eres de {specialty} con {abbreviations} y \n{documents}"), F.col("n_name"), F.create_map(F.lit("A"), F.lit("aa")), F.array(F.lit("T")))
    return t(spark, sf, "nation").select("n_nationkey", prompt.alias("prompt"), system.alias("system"))


# evaluation and stores


@query("""
WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'not_validated' WHEN quality = 1 THEN 'answered' ELSE 'insufficient' END AS outcome FROM labels)
SELECT o AS outcome, count(r.outcome) AS n, count(r.outcome) / (SELECT count(*) FROM labels) AS share FROM (SELECT unnest(['answered', 'insufficient', 'not_validated', 'validation_error', 'technical_error']) AS o) LEFT JOIN r ON r.outcome = o GROUP BY o""")
def p19_outcome_report(spark, sf):
    r = t(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "not_validated").when(F.col("quality") == 1, "answered").otherwise("insufficient").alias("outcome"))
    return evaluation.outcome_report(r)


@query("""
WITH r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'not_validated' ELSE 'answered' END AS outcome, doc_id % 3 AS attempts, quality = 1 AS refocused FROM labels)
SELECT count(*) AS retried, avg(CASE WHEN outcome = 'answered' THEN 1.0 ELSE 0.0 END) AS rescued, count(*) FILTER (WHERE refocused) AS refocused FROM r WHERE attempts > 1""")
def a21_retry_report(spark, sf):
    r = t(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "not_validated").otherwise("answered").alias("outcome"), (F.col("doc_id") % 3).alias("attempts"), (F.col("quality") == 1).alias("refocused"))
    return evaluation.retry_report(r)


@query("""
SELECT item_id AS case_id, b.text AS question, coalesce(list(d.text ORDER BY d.doc_id) FILTER (WHERE d.doc_id IS NOT NULL), []) AS contexts FROM benchmark b LEFT JOIN documents d ON d.doc_id % 200 = b.item_id AND d.text IS NOT NULL WHERE length(trim(b.text)) > 0 GROUP BY 1, 2""")
def p20_retrieval_dataset(spark, sf):
    cases = t(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.col("text").alias("reference"))
    found = t(spark, sf, "documents").where("text IS NOT NULL").select((F.col("doc_id") % 200).alias("case_id"), F.col("doc_id").alias("rank"), "text")
    return evaluation.retrieval_dataset(cases, found).select("case_id", "question", "contexts")


@query("""SELECT l.doc_id AS question, CASE WHEN toxic = 1 THEN 'x' END AS rejected_answer, quality AS attempts, '' AS failed_step, round(n_chars / 7.0, 2) AS latency FROM labels l JOIN documents USING (doc_id)""")
def n5_run_record(spark, sf):
    s = t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id")
    none = F.lit(None).cast("string")
    states = s.select(F.col("doc_id").alias("question"), F.col("lang").alias("tier"), F.when(F.col("toxic") == 1, "not_validated").otherwise("answered").alias("outcome"), F.lit("x").alias("answer"), F.col("quality").alias("attempts"), F.lit(None).cast("boolean").alias("refocused"), none.alias("reason"), none.alias("failed_step"), none.alias("technical_detail"), (F.col("n_chars") / 7.0).alias("latency"))
    return evaluation.run_record(states).select("question", "rejected_answer", "attempts", "failed_step", "latency")


@query("""SELECT c.c_custkey AS chunk_id, CASE WHEN n_regionkey > 1 THEN n_name ELSE '' END AS context, CASE WHEN n_regionkey > 1 THEN n_name || chr(10) || chr(10) ELSE '' END || c_mktsegment AS text_for_retrieval FROM customer c JOIN nation ON n_nationkey = c_nationkey""")
def n3_enriched_chunks(spark, sf):
    c, n = t(spark, sf, "customer"), t(spark, sf, "nation").where("n_regionkey > 1")
    contexts = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("chunk_id"), F.col("n_name").alias("context"))
    return stores.enriched_chunks(c.select(F.col("c_custkey").alias("chunk_id"), F.col("c_mktsegment").alias("text_for_retrieval")), contexts).select("chunk_id", "context", "text_for_retrieval")


@query("""SELECT 'p' || p_partkey || '.md' AS name, p_type AS markdown, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 > 0 THEN p_brand END AS reference FROM part""")
def s7_paired_sources(spark, sf):
    p = t(spark, sf, "part")
    name, ref = F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".md")), F.concat(F.lit("r"), F.col("p_partkey"), F.lit(".txt"))
    manifest = p.where("p_partkey % 3 > 0").select(F.concat(F.lit("data/md/"), name).alias("markdown"), F.concat(F.lit("data/ref/"), ref).alias("reference"))
    return stores.paired_sources(p.select(name.alias("file_name"), F.col("p_type").alias("text")), manifest, p.where("p_partkey % 2 > 0").select(ref.alias("file_name"), F.col("p_brand").alias("text")))


@query("""SELECT doc_id FROM documents UNION SELECT doc_id + 50 FROM labels""")
def u3_united_keys(spark, sf):
    return rows.united(t(spark, sf, "documents"), t(spark, sf, "labels").select((F.col("doc_id") + 50).alias("doc_id")), "doc_id")
