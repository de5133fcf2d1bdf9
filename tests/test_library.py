import numpy as np
import pytest
from pyspark.sql import functions as F

from veridock.functions import text as tx
from veridock.operators import evidence, extraction, graph, sections, selection
from veridock.plans import evaluation, gates
from veridock.sources import files
from veridock.streaming.sessions import session_facts

NAMES = [("TAF", "tenofovir alafenamida"), ("TFV", "tenofovir")]


def one(spark, x):
    return spark.range(1).select(x.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, tx.collapse(F.lit(" a  b\n"))) == "a b"
    assert one(spark, tx.citation_form(F.lit("**Se** recomienda, así (A-II)."))) == "se recomienda así"
    assert one(spark, tx.canonical_key(F.lit("Tenofovir Alafenamida TAF"), NAMES)) == "taf"
    assert one(spark, tx.expand_abbreviations(F.lit("dar TAF ya"), NAMES)) == "dar tenofovir alafenamida (TAF) ya"
    assert one(spark, tx.grades(F.lit("x (A-II) y ( **B - I** ) z (A-II)"))) == ["A-II", "B-I"]
    assert one(spark, tx.common_section_number(F.array(F.lit("4.2.1"), F.lit("4.2.2")))) == "4.2"
    assert one(spark, tx.common_section_number(F.array(F.lit("4"), F.lit("5")))) is None
    assert one(spark, tx.stable_uuid(F.lit("abc"))) == "68661508-f3c4-55b4-945d-ae2b4dfe5db4"
    assert one(spark, tx.facts(F.array(F.lit("a: 1"), F.lit("b:"), F.lit("a: 2: 3"), F.lit("zz")))) == {"a": "2: 3"}
    assert one(spark, tx.facts_phrase(F.create_map(F.lit("k"), F.lit("v")))) == "k: v"
    assert one(spark, tx.tidy(F.lit("a ,b  \n\n\n\nc "))) == "a,b\n\nc\n"


def test_score_window(spark):
    text = "x" * 300 + " needle " + "y" * 400
    assert one(spark, tx.score_window(F.lit("short"), F.lit("needle"))) == "short"
    assert "needle" in one(spark, tx.score_window(F.lit(text), F.lit("the needle"), 128))
    assert one(spark, tx.score_window(F.lit(text), F.lit("a b"), 128)) == text[:128]


def test_sections_and_chunks(spark):
    md = "intro\n## 1. TEMA\ntexto uno\n### 1.1. Primera\n" + "palabra. " * 30 + "\n### 1.2. Segunda\nmás\n## 2. OTRA\n" + "\n\n".join(["frase larga aquí. " * 60] * 8)
    docs = spark.createDataFrame([("d", md)], "doc_id string, text string")
    got = sections.sections(docs).orderBy("sec").collect()
    assert [r["heading"] for r in got] == ["Preámbulo", "1. TEMA", "1.1. Primera", "1.2. Segunda", "2. OTRA"]
    assert got[3]["breadcrumb"] == ["1. TEMA", "1.2. Segunda"] and got[4]["breadcrumb"] == ["2. OTRA"]
    rows = sections.chunks(docs).collect()
    assert all(r["n_tokens"] <= sections.MAX_TOKENS for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(200))
    pieces = sections.split_table(table, 300)
    assert len(pieces) > 1 and all(p.startswith("| a | b |\n|---|---|") for p in pieces)


def test_attribution():
    body = "1. Se recomienda iniciar TAF 25 mg en todos los pacientes con carga viral (A-I).\n2. No se recomienda otra pauta en la insuficiencia hepática grave (B-II)."
    names = {"TAF": "tenofovir alafenamida", "ABC": "abacavir"}
    assert evidence.attribute("Se recomienda iniciar TAF 25 mg en todos los pacientes con carga viral", body, names)[::2] == ("exact", ["A-I"])
    assert evidence.attribute("Se recomienda iniciar TAF 25 mg en todos los enfermos con carga viral", body, names)[0] == "fuzzy"
    assert evidence.attribute("Se recomienda iniciar ABC 25 mg en todos los enfermos con carga viral", body, names)[0] == "miss"
    assert evidence.attribute("Se recomienda", body, names)[0] == "miss"


def test_selection(spark):
    rows = lambda x: spark.createDataFrame(x, "id string, pos int")
    got = selection.merge_dedup([rows([("1", 1), ("2", 2)]), rows([("2", 1), ("3", 2), (None, 3)])], "id", "pos").orderBy("place").collect()
    assert [r["id"] for r in got] == ["1", "2", "3"]
    f = selection.rrf([rows([("a", 1), ("b", 2)]), rows([("b", 1)])], "id", "pos").collect()
    assert {r["id"]: round(r["score"], 6) for r in f} == {"a": round(1 / 61, 6), "b": round(1 / 62 + 1 / 61, 6)}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("b", "c", 3), ("c", "c", 4)], "src string, dst string, n int")
    u = graph.undirected(e, "n")
    assert {(r["src"], r["dst"], r["n"]) for r in u.collect()} == {("a", "b", 2), ("b", "c", 3)}
    seeds = spark.createDataFrame([("a",), ("c",)], "node string")
    paths = {">".join(r["nodes"]): r["flow"] for r in graph.flow_paths(u, seeds).collect()}
    assert paths.keys() == {"a>b>c", "c>b>a"} and paths["a>b>c"] == pytest.approx((1 + 0.7 + 0.245) / 2)
    scores = spark.createDataFrame([("a", 1.0), ("c", 0.5)], "node string, score double")
    assert graph.best_paths(graph.flow_paths(u, seeds), scores).count() == 1
    rank = {r["node"]: r["rank"] for r in graph.pagerank(u, spark.createDataFrame([("a", 1.0)], "node string, mass double"), rounds=8).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["a"] > rank["c"]


def test_converged_pagerank(spark):
    pairs = [(a, b) for a in range(7) for b in range(a + 1, 7) if a + b != 7]
    want, mass = [1 / 8] * 8, [0.75, 0, 0, 0, 0, 0, 0, 0.25]  # node 7 has no edges
    ways = pairs + [(b, a) for a, b in pairs]
    degree = [sum(a == x for a, _ in ways) for x in range(8)]
    while True:
        got = [sum(want[a] / degree[a] for a, b in ways if b == x) for x in range(8)]
        new = [0.85 * got[x] + (0.85 * want[7] + 0.15) * mass[x] for x in range(8)]
        change, want = sum(abs(a - b) for a, b in zip(new, want, strict=True)), new
        if change < 8e-6:
            break
    edges = spark.createDataFrame(pairs, "src long, dst long")
    reset = spark.createDataFrame([(0, 0.75), (7, 0.25)], "node long, mass double")
    assert {r["node"]: r["rank"] for r in graph.converged_pagerank(edges, reset).collect()} == pytest.approx(dict(enumerate(want)), abs=1e-12)
    assert graph.converged_pagerank(edges, reset, max_iter=1).count() == 0


def test_extraction(spark):
    lines = spark.createDataFrame([("d", p, n, x) for p in (1, 2, 3) for n, x in enumerate([f"Guía de práctica {p}", f"texto {p} uno", f"texto {p} dos", "tres", str(p)])], "doc_id string, page int, line_no int, text string")
    assert [r["key"] for r in extraction.running_heads(lines).collect()] == ["guía de práctica"]
    assert lines.where(extraction.is_noise(F.col("text"))).count() == 3
    spots = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 5.0)], "page int, x0 double, top double")
    box = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "page int, x0 double, top double, x1 double, bottom double")
    assert extraction.outside_regions(spots, box).count() == 1
    pages = spark.createDataFrame([("ok", 1, "palabra " * 50), ("scan", 1, "x"), ("bad", 1, "(cid:12) " * 50)], "doc_id string, page int, text string")
    assert {r["doc_id"]: r["status"] for r in extraction.assess_pages(pages).collect()} == {"ok": "native_ok", "scan": "scanned", "bad": "broken_cmap"}


def test_gates(spark):
    c = spark.createDataFrame([("1", "w " * 1000, "text", 1000), ("2", "", "text", 0), ("3", "plain", "table", 3)], "chunk_id string, text string, content_type string, n_tokens int")
    found = {(r["code"], r["subject"]) for r in gates.chunk_gates(c).collect()}
    assert {("G1", "1"), ("G2", "2"), ("G10", "3"), ("G11", "3")} <= found
    s = spark.createDataFrame([("a.md", "## T\n\nfuconazol ﬁ\n\n**Tabla 1. Dosis**\n\ntexto _ _ sin datos\n\n[Tabla omitida]", "fluconazol"), ("b.md", "x", None)], "name string, markdown string, reference string")
    found = {(r["code"], r["subject"]) for r in gates.source_gates(s, c.select(F.lit("a.md").alias("name"), "text"), spark.createDataFrame([("a.md",), ("c.md",)], "name string")).collect()}
    ok = spark.createDataFrame([("c.md", "> _[Figura omitida — p. 42 — consultar PDF original]_", "x"), ("d.md", "> _[Tabla omitida — p. 42 — consultar PDF original]_", "x")], "name string, markdown string, reference string")
    assert {r["subject"] for r in gates.omissions(ok).collect()} == {"d.md"}
    assert {("G4", "a.md"), ("G5", "a.md"), ("G5", "b.md"), ("G6", "a.md"), ("G7", "a.md"), ("G9", "b.md"), ("G9", "c.md")} <= found
    assert {r["code"]: r["passed"] for r in gates.rollup(gates.chunk_gates(c)).collect()}["G8"]


def test_outcome(spark):
    args = lambda *x: evaluation.outcome(*[F.lit(v).cast("boolean") for v in x])
    assert one(spark, args(None, None, True, True, True)) == "answered"
    assert one(spark, args(None, True, True, True, True)) == "validation_error"
    assert one(spark, args(True, True, True, True, True)) == "technical_error"
    assert one(spark, args(None, None, True, None, True)) == "not_validated"


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([("1", "á"), ("2", "b")], "id string, text string")
    files.write_jsonl(d, str(tmp_path / "x"))
    assert files.read_jsonl(spark, str(tmp_path / "x"), "id string, text string").count() == 2
    (tmp_path / "m.toml").write_text('[[document]]\ndoc_id = "a"\ntitle = "A"\nspecialty = "s"\nmarkdown = "a.md"\nyear = 2024\ntopics = ["x"]\n')
    assert files.read_manifest(spark, str(tmp_path / "m.toml")).first()["year"] == 2024
    (tmp_path / "a.md").write_text("# x\n")
    (tmp_path / "a.txt").write_text("no")
    assert [r["file_name"] for r in files.read_markdown(spark, str(tmp_path)).collect()] == ["a.md"]
    assert files.upsert(d, spark.createDataFrame([("2", "c")], "id string, text string"), "id").count() == 2


def test_sessions(spark):
    turns = spark.createDataFrame([("s", 1, "q1", "age", "40", False), ("s", 2, "q2", "sex", "f", False), ("s", 3, "q3", "age", "9", True)], "session_id string, turn long, question string, attr string, value string, reset boolean")
    got = session_facts(turns).orderBy("turn").collect()
    assert [r["previous"] for r in got] == [None, "q1", "q2"] and [len(r["facts"]) for r in got] == [1, 2, 1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chunks_carry_the_manifest(spark):
    text = "# 3. Tema\n\n## 3.1. Uno\n\ncorto (A-II)\n\n## 3.2. Dos\n\notro"
    docs = spark.createDataFrame([("d1", text), ("d2", "sin títulos")], "doc_id string, text string")
    manifest = spark.createDataFrame([("d1", "Guía", "vih", ["a"], "org", 2024), ("d2", "Otra", "vih", [], "org", None)], "doc_id string, title string, specialty string, topics array<string>, organization string, year int")
    got = {r["doc_id"]: r for r in sections.chunks(docs, manifest).collect()}
    assert got["d1"]["section_number"] == "3" and got["d1"]["heading"] == "3. Tema" and got["d1"]["evidence_grades"] == ["A-II"]
    assert got["d1"]["doc_title"] == "Guía" and got["d1"]["year"] == 2024 and got["d1"]["text_for_retrieval"].startswith("3. Tema\n\n")
    assert got["d2"]["section_path"] == ["Otra"] and got["d2"]["text_for_retrieval"] == "Otra\n\nsin títulos"


def test_facts_of_batch_and_merge_agree(spark):
    rows = [("s", 1, "q1", "a", "1", False), ("s", 2, "q2", "a", "2", False), ("s", 3, "q3", "b", "3", False), ("s", 4, "q4", None, None, False), ("s", 5, "q5", "b", "4", True)]
    got = session_facts(spark.createDataFrame(rows, "session_id string, turn long, question string, attr string, value string, reset boolean")).orderBy("turn").collect()
    assert [r["facts"] for r in got] == [{"a": "1"}, {"a": "2"}, {"a": "2", "b": "3"}, {"a": "2", "b": "3"}, {"b": "4"}]
    assert [r["previous"] for r in got] == [None, "q1", "q2", "q3", "q4"]


def test_assembled_document(spark):
    from veridock.operators import assembly

    blocks = [("heading", "1. Tema", 2), ("heading_cont", "largo", None), ("text", "uno", None), ("text", "dos.", None), ("text", "tres", None), ("table", "| a |", None), ("heading", "Referencias", 2), ("text", "fuera.", None), ("heading", "1.1. Dentro", 3), ("heading", "2. Otro", 2), ("text", "fin", None), ("heading_cont", "negrita", None)]
    b = spark.createDataFrame([("d", i, k, x, n) for i, (k, x, n) in enumerate(blocks)], "doc_id string, place int, kind string, text string, level int")
    assert assembly.assembled(b).first()["markdown"] == "## 1. Tema largo\n\nuno dos.\n\ntres\n\n| a |\n\n## 2. Otro\n\nfin negrita\n"
    cells = spark.createDataFrame([(1, ["A", "x"]), (2, ["", "y"]), (3, ["", ""]), (4, ["12", "z"]), (5, ["", "w"])], "n int, cells array<string>").withColumn("t", F.lit(1))
    assert [r["filled"] for r in assembly.fill_cells(cells, "t", "n", "cells", [0]).orderBy("n").collect()] == [["A", "x"], ["A", "y"], ["", ""], ["12", "z"], ["", "w"]]


def test_stores(spark, tmp_path):
    from veridock.sources import stores

    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    path = str(tmp_path / "points")
    stores.upsert_points(spark, path, rows(("a", 1), ("b", 2)))
    for _ in range(2):
        stores.upsert_points(spark, path, rows(("b", 3), ("c", 4)))
        assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    out = str(tmp_path / "done")
    assert stores.append_pending(spark, out, rows(("a", 1), ("b", 2)), "id", lambda d: d, "id string, v int") == 2
    assert stores.append_pending(spark, out, rows(("b", 2), ("c", 3)), "id", lambda d: d, "id string, v int") == 1
    assert spark.read.json(out).count() == 3
    graph_path = str(tmp_path / "graph")
    stores.write_graph(graph_path, rows(("a", 1)), rows(("a", 1)), rows(("a", 1)), {"dim": 4})
    assert set(stores.read_graph(spark, graph_path, 4)) == {"nodes", "edges", "vectors"}
    with pytest.raises(ValueError):
        stores.read_graph(spark, graph_path, 5)


def test_pagerank_on_disk_and_in_memory_agree(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4)], "src long, dst long")
    reset = spark.createDataFrame([(1, 0.5), (9, 0.5)], "node long, mass double")
    small = {r["node"]: r["rank"] for r in graph.converged_pagerank(edges, reset, tol=1e-3).collect()}
    large = {r["node"]: r["rank"] for r in graph.converged_pagerank(edges, reset, tol=1e-3, in_memory=0).collect()}
    assert small.keys() == large.keys() == {1, 2, 3, 4, 9} and all(abs(small[k] - large[k]) < 1e-12 for k in small)


def test_words_unknown_to_a_shared_reference(spark):
    s = spark.createDataFrame([("a", "Árbol casa casa tabla nube"), ("b", "nube x"), ("c", None)], "name string, markdown string")
    reference = spark.createDataFrame([("ARBOL nuBe",), (None,)], "text string")
    unknown = gates.words_unknown_to(s, reference)
    assert {tuple(r) for r in unknown.collect()} == {("a", "casa", 2), ("b", "x", 1)}
    assert {tuple(r) for r in gates.words_unknown_to(s, reference.limit(0)).collect()} == {("a", "arbol", 1), ("a", "casa", 2), ("a", "nube", 1), ("b", "nube", 1), ("b", "x", 1)}


def test_blocked_products_have_one_pair_of_blocks_at_a_time(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (60, 8)).astype(float)
    v[7] = v[3]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None)], "id long, v array<double>")
    asked = rows.where("id % 6 = 0")
    sims = v @ v.T
    got = graph.dense_top_k(rows, asked, 4, unit=False, side=8)
    assert {(r["query"], r["rank"]): r["id"] for r in got.collect()} == {(q, n + 1): i for q in range(0, 60, 6) for n, i in enumerate(sorted(range(60), key=lambda i: (-sims[q, i], i))[:4])}
    assert graph.dense_top_k(rows, asked, 100, unit=False, side=8).count() == 600
    pairs = graph.similar_pairs(rows, 12, side=8)
    assert {(r["a"], r["b"], r["similarity"]) for r in pairs.collect()} == {(a, b, sims[a, b]) for a in range(60) for b in range(a + 1, 60) if sims[a, b] >= 12}
    for d in (got, pairs):  # a joined row of two blocks came to Python in batches of as many rows as a task had
        assert "FlatMapGroupsInArrow" in (plan := d._jdf.queryExecution().toString()) and "MapInPandas" not in plan
    assert graph.similar_pairs(rows.limit(0), 1).count() == graph.dense_top_k(rows.limit(0), asked, 3).count() == 0


def test_best_scores(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 3)
    v = np.random.default_rng(6).normal(size=(50, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = graph.best_scores(rows, rows.where("id < 20").withColumn("id", F.col("id") % 3), side=16)
    want = {(q, i): max(round(float(v[j] @ v[i]), 6) for j in range(q, 20, 3)) for q in range(3) for i in range(50)}
    assert {(r["query"], r["id"]): r["score"] for r in got.collect()} == pytest.approx(want) and got.count() == 150


@pytest.mark.parametrize("in_memory", [1000, 0])
def test_bm25_keeps_the_best_of_each_query(spark, monkeypatch, in_memory):
    import math
    import random

    monkeypatch.setattr(selection, "POSTINGS", 40)
    monkeypatch.setattr(selection, "SCORES", 8)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 30))), i % 4 > 0) for i in range(80)] + [(80, None, True), (81, "", True), (82, "z z", True)]
    docs += [(i, docs[5][1], True) for i in range(100, 110)]  # ties
    asked = [(1, "A b b"), (2, "c x"), (3, "y"), (4, docs[5][1])]
    split = {i: x.split() for i, x, _ in docs if x}
    mean, n = sum(map(len, split.values())) / len(split), len(split)
    want = set()
    for q, x in asked:
        score = {}
        for term in set(x.lower().split()):
            df = sum(term in w for w in split.values())
            for i, w in split.items():
                if term in w:
                    score[i] = score.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(term) * 2.2 / (w.count(term) + 1.2 * (0.25 + 0.75 * len(w) / mean))
        own = sorted((-round(s, 6), i) for i, s in score.items() if dict((i, f) for i, _, f in docs)[i])[:6]
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(own)}
    d, q = spark.createDataFrame(docs, "doc long, text string, found boolean"), spark.createDataFrame(asked, "q int, text string")
    got = selection.bm25(d, q, "doc", "q", "text", 6, among=F.col("found"), asked_in_memory=in_memory)
    assert {(r["q"], r["doc"], r["score"], r["rank"]) for r in got.collect()} == want
    assert selection.bm25(d, q.where("q = 3"), "doc", "q", "text", 6, asked_in_memory=in_memory).count() == selection.bm25(d.limit(0), q, "doc", "q", "text", 6, asked_in_memory=in_memory).count() == 0


def test_long_texts_are_folded_by_runs_and_once_a_step(spark):
    assert one(spark, tx.fold(F.lit("Árbol, niño ﬁn ½ Ａ Ωμέγα é"))) == "arbol, nino fin ½ a ωμεγα e"
    assert one(spark, tx.strip_accents(F.lit(None).cast("string"))) is None and one(spark, tx.strip_accents(F.lit(""))) == ""
    plan = spark.range(1).select(tx.expand_abbreviations(F.col("id").cast("string"), [("A", "uno"), ("B", "dos"), ("C", "tres")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("id#") < 8  # each step was written out again at every mention of it
