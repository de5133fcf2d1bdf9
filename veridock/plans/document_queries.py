"""Queries of document assembly, sources, answers and plans over the driver's tables, added to the catalogue of veridock.plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.operators import assembly, citations, graph, linking, rows
from veridock.plans import control
from veridock.plans.queries import query, t
from veridock.sources import stores

# documents


@query("""
WITH b AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations)
SELECT conv_id, string_agg(CASE place % 6 WHEN 1 THEN CASE WHEN place > 1 THEN chr(10) || chr(10) ELSE '' END || '## ' || role WHEN 2 THEN ' ' || role WHEN 3 THEN chr(10) || chr(10) || role WHEN 4 THEN ' ' || role || '.'
  WHEN 5 THEN chr(10) || chr(10) || '> ' || role ELSE chr(10) || chr(10) || role END, '' ORDER BY place) || chr(10) AS markdown FROM b GROUP BY conv_id""")
def c10_assembled_documents(spark, sf):
    """Each conversation as a document: a heading with its continuation, two lines of a paragraph, an omission, a styled line that continues no heading."""
    own = rows.numbered(t(spark, sf, "conversations"), "conv_id", ["turn", "role"], "role")
    k = F.col("n") % 6
    kind = F.when(k == 1, "heading").when(k.isin(2, 0), "heading_cont").when(k == 5, "omission").otherwise("text")
    text = F.when(k == 4, F.concat("role", F.lit("."))).when(k == 5, F.concat(F.lit("> "), "role")).otherwise(F.col("role"))
    blocks = own.select(F.col("conv_id").alias("doc_id"), F.col("n").alias("place"), kind.alias("kind"), text.alias("text"), F.when(k == 1, 2).alias("level"))
    return assembly.assembled(blocks).withColumnRenamed("doc_id", "conv_id")


@query("""
WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, CAST(l_quantity AS DOUBLE) AS top, 'text' AS kind, l_linestatus AS text FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber % 2, CAST(l_quantity AS DOUBLE), 'table', l_returnflag FROM lineitem)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, top, kind, text) AS place FROM b""")
def w9_reading_order(spark, sf):
    l = t(spark, sf, "lineitem")
    part = lambda kind, c: l.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_quantity").cast("double").alias("top"), F.lit(kind).alias("kind"), F.col(c).alias("text"))
    return assembly.page_blocks(part("text", "l_linestatus"), part("table", "l_returnflag"))


@query("""
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, role FROM conversations),
c AS (SELECT conv_id, n, CASE WHEN n % 3 = 1 THEN role ELSE '' END AS a, CASE WHEN n % 5 = 0 THEN '' ELSE role END AS b FROM r)
SELECT conv_id, n, CASE WHEN a = '' AND b <> '' THEN coalesce(last_value(nullif(a, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') ELSE a END || '|' || b AS filled FROM c""")
def c9_filled_cells(spark, sf):
    own = rows.numbered(t(spark, sf, "conversations"), "conv_id", ["turn", "role"], "role")
    cells = F.array(F.when(F.col("n") % 3 == 1, F.col("role")).otherwise(""), F.when(F.col("n") % 5 == 0, "").otherwise(F.col("role")))
    filled = assembly.fill_cells(own.select("conv_id", "n", cells.alias("cells")), "conv_id", "n", "cells", [0])
    return filled.select("conv_id", F.col("n").cast("long").alias("n"), F.array_join("filled", "|").alias("filled"))


@query("""SELECT 'p' || p_partkey || '.md' AS file_name, p_partkey AS doc_id, 'data/md/p' || p_partkey || '.md' AS markdown_path FROM part""")
def s4_manifest_lookup(spark, sf):
    name = F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".md"))
    p = t(spark, sf, "part")
    return stores.document_for(p.select(name.alias("file_name")), p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("data/md/"), name).alias("markdown"))).select("file_name", "doc_id", "markdown_path")


@query("""SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1""")
def a4_group_ordered(spark, sf):
    return rows.group_ordered(t(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderstatus").select("o_custkey", F.array_join("values", "").alias("statuses"))


# answers

ANSWER = f"""
WITH c AS (SELECT *, c_nationkey % 2 = 0 AS enough, chr(10) AS nl FROM customer)
SELECT c_custkey, concat_ws(nl || nl, CASE WHEN enough THEN CASE WHEN c_custkey % 5 > 0 THEN c_name END ELSE CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '{citations.INSUFFICIENT}' END END,
  CASE WHEN c_custkey % 3 = 0 THEN '**Fuentes**' || nl || '- ' || c_mktsegment || ' (2001) — s' || CASE WHEN c_custkey % 2 = 0 THEN ' (consultada)' ELSE '' END || nl || '  > ' || CASE WHEN c_custkey % 4 = 0 THEN '≈ ' ELSE '' END || c_name || ' (A-I, B-II)' END,
  CASE WHEN enough THEN '**Preguntas de seguimiento**' || nl || '- ' || c_mktsegment END, CASE WHEN enough THEN '_{citations.DISCLAIMER}_' END) AS markdown FROM c"""


@query(ANSWER)
def k8_markdown_answer(spark, sf):
    number = F.col("c_custkey")
    view = citations.answer_view(F.col("c_nationkey") % 2 == 0, F.when(number % 5 > 0, F.col("c_name")), F.array(F.col("c_mktsegment"), F.lit(" ")))
    quote = F.struct(F.when(number % 4 == 0, "fuzzy").otherwise("exact").alias("status"), F.col("c_name").alias("sentence"), F.array(F.lit("A-I"), F.lit("B-II")).alias("grades"))
    source = F.struct(F.col("c_mktsegment").alias("title"), F.lit(2001).alias("year"), F.lit("s").alias("section"), (number % 2 == 0).alias("consulted_only"), F.array(quote).alias("citations"))
    sources = F.filter(F.array(source), lambda _: number % 3 == 0)
    own = t(spark, sf, "customer").select("c_custkey", view.alias("view"), sources.alias("sources"))
    return own.select("c_custkey", citations.markdown_answer(F.col("view"), F.col("sources")).alias("markdown"))


@query("""
SELECT c_custkey AS chunk_id, c_name AS title, 2000 + c_nationkey AS year, 'o' AS organization, CASE WHEN c_custkey % 2 = 0 THEN '§' || c_nationkey || '.1 · ' ELSE '' END || c_mktsegment AS section FROM customer""")
def n7_source_rows(spark, sf):
    number = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit(".1")))
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("doc_title"), (2000 + F.col("c_nationkey")).alias("year"), F.lit("o").alias("organization"), F.col("c_mktsegment").alias("heading"), number.alias("section_number"), F.array().cast("array<string>").alias("section_path"))
    return citations.source_rows(c)


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || chr(10) || coalesce(text, '') WHEN doc_id % 3 = 1 THEN coalesce(text, '') ELSE 'x' || source || chr(10) || chr(10) || coalesce(text, '') END AS citable FROM documents""")
def t19_citable_text(spark, sf):
    """Every third text has a retrieval form and keeps its opening, every third loses its breadcrumb, every third begins with something else."""
    kind = F.col("doc_id") % 3
    d = t(spark, sf, "documents").withColumn("whole", F.concat(F.when(kind == 2, "x").otherwise(""), "source", F.lit("\n\n"), F.coalesce("text", F.lit(""))))
    return d.select("doc_id", citations.citable(F.col("whole"), F.when(kind == 0, "form").otherwise(""), F.col("source")).alias("citable"))


@query("""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'broken' WHEN quality = 1 THEN 'a' || doc_id ELSE 'fallback' END AS message FROM labels""")
def p13_final_message(spark, sf):
    outcome = F.when(F.col("toxic") == 1, "technical_error").when(F.col("quality") == 1, "answered").otherwise("not_validated")
    return t(spark, sf, "labels").select("doc_id", control.final_message(outcome, F.concat(F.lit("a"), F.col("doc_id")), "fallback", "broken").alias("message"))


# plans


@query("""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN [c_mktsegment, c_name] ELSE [c_name] END AS plan FROM customer)
SELECT c_custkey, CAST(hop AS INTEGER) AS hop, plan[hop] AS query FROM (SELECT c_custkey, plan, unnest(generate_series(1, len(plan))) AS hop FROM p)""")
def p16_fan_out(spark, sf):
    c = t(spark, sf, "customer")
    plan = F.struct((F.col("c_custkey") % 3 == 0).alias("multi_hop"), F.array(F.lit(" "), F.col("c_mktsegment"), F.col("c_name")).alias("queries"))
    return control.fan_out(c.withColumn("plan", control.hop_plan(F.col("c_name"), plan)), "plan", "c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS hops FROM orders""")
def a3_counted_hops(spark, sf):
    first, second = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")), F.when(F.col("o_custkey") % 3 == 0, F.lit(1))
    return t(spark, sf, "orders").select("o_orderkey", control.counted(first, second).alias("hops"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment || '|b' ELSE c_name END AS keywords FROM customer""")
def g8_keywords(spark, sf):
    """The model names two keywords, none, or fails."""
    k = F.col("c_custkey") % 3
    found = F.when(k == 1, F.array(F.col("c_mktsegment"), F.lit(" "), F.lit("b "))).when(k == 2, F.array(F.lit(" ")))
    return t(spark, sf, "customer").select("c_custkey", F.array_join(linking.keywords(F.col("c_name"), found), "|").alias("keywords"))


@query("""SELECT o_orderkey AS chunk_id, o_orderstatus AS subject, 'is' AS relation, o_orderpriority AS object FROM orders WHERE o_orderstatus <> 'F'""")
def g7_extracted_triples(spark, sf):
    """The extraction fails on finished orders."""
    chunks = t(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("text"))
    part = lambda x, i: F.split(x, r"\|")[i]
    return graph.flatten_triples(linking.extracted_triples(chunks, lambda x: F.when(~x.startswith("F"), F.array(F.array(part(x, 0), F.lit("is"), part(x, 1))))))


@query("""
SELECT 'C' || c_custkey || ' -> N' || c_nationkey AS path, round(CAST(c_acctbal AS DOUBLE) / 7, 4) AS score, round(CAST(c_acctbal AS DOUBLE) / 11, 4) AS flow, round(CAST(c_acctbal AS DOUBLE) / 13, 4) AS relevance FROM customer""")
def r10_path_trace(spark, sf):
    by = lambda n: F.col("c_acctbal").cast("double") / n
    nodes = F.array(F.concat(F.lit("C"), F.col("c_custkey")), F.concat(F.lit("N"), F.col("c_nationkey")))
    return linking.path_trace(t(spark, sf, "customer").select(nodes.alias("nodes"), by(7).alias("score"), by(11).alias("flow"), by(13).alias("relevance")))
