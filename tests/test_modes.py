import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridock.functions import labels
from veridock.operators import modes
from veridock.plans import control
from veridock.sources import files
from veridock.streaming.sessions import stream_facts


def one(spark, x):
    return spark.range(1).select(x.alias("x")).first()["x"]


def texts(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


@pytest.mark.parametrize("line,level", [("1. Tema", 2), ("1.2. Tema", 3), ("1.2.3.4.5.6.7 Hondo", 6), ("Recomendaciones:", 4), ("TABLA 3", 4), ("Bibliografía", 3), ("Listado de abreviaturas", 2), ("texto", None), ("1. " + "x" * 160, None), ("", None)])
def test_heading_level(spark, line, level):
    assert one(spark, labels.heading_level(F.lit(line))) == level


def test_section_label(spark):
    label = lambda h, n, p: one(spark, labels.section_label(F.lit(h), F.lit(n).cast("string"), texts(*p)))
    assert label("3.1. FACTORES", "3.1", ["3. TEMA", "3.1. FACTORES"]) == "§3.1 · FACTORES"
    assert label("RECOMENDACIONES", None, ["3. TEMA", "4.2. CUÁNDO", "RECOMENDACIONES"]) == "§4.2 CUÁNDO › RECOMENDACIONES"
    assert label("Nota", None, ["Guía", "Nota"]) == "Guía › Nota"
    assert label("Nota", None, []) == "Nota" and label(None, "2", []) == "§2"
    assert label("Suelta", None, ["4. Otra"]) == "§4 Otra › Suelta"


def test_breadcrumb_prefix(spark):
    prefix = lambda *p, most=4: one(spark, labels.breadcrumb_prefix(texts(*p), most))
    assert prefix() == "" and prefix("A", "B") == "A > B\n\n"
    assert prefix("A b", "C d", "E") == "C d > E\n\n"
    assert prefix("uno dos tres cuatro cinco") == "uno dos tres cua…\n\n"


def test_rendered_blocks(spark):
    narrow = labels.rendered_table(texts("a", "b"), F.array(texts("1", "2"), texts("3", "")))
    assert one(spark, narrow) == "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |  |"
    head = texts("f", *"abcdef")
    wide = labels.rendered_table(head, F.array(texts(" x ", "", "1", *" " * 3, "2"), texts("", *"123456"), texts("y", *[""] * 6)))
    assert one(spark, wide) == "- x: b «1»; f «2»."
    md = "# " + "h" * 50 + "\n\n" + "p" * 45 + "\n\nshort\n\n| " + "c" * 50 + " |\n| x |\n"
    assert one(spark, labels.coverage_units(F.lit(md))) == ["p" * 45, "| " + "c" * 50 + " |"]
    assert one(spark, labels.page_range(F.lit("2-4"))) == [2, 3, 4] and one(spark, labels.page_range(F.lit("5"))) == [5] and one(spark, labels.page_range(F.lit(""))) is None
    assert tuple(one(spark, labels.clamped(*map(F.lit, (-1.0, 2.0, 99.0, 5.0, 50.0, 60.0))))) == (0.0, 2.0, 50.0, 5.0)
    assert one(spark, labels.abbreviation_list(F.create_map(F.lit("A"), F.lit("aa"), F.lit("B"), F.lit("bb")))) == "A = aa, B = bb"
    assert one(spark, labels.digest(F.lit(None).cast("string"), F.lit(" a\nb "))) == "- : a b"
    assert one(spark, labels.clean_list(texts(" a ", None, "\n"))) == ["a"]


def test_refinement(spark):
    state = spark.createDataFrame([({"a": "1"}, ["q", "r"], ["z"], 0, {"q": " ", "r": "2"})], "facts map<string,string>, pending array<string>, asked array<string>, rounds int, answers map<string,string>")
    got = control.fold_answers(state).first()
    assert (got["facts"], got["pending"], got["asked"], got["rounds"], got["refining"]) == ({"a": "1", "r": "2"}, ["q"], ["z", "q", "r"], 1, True)
    assert one(spark, control.merged(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2")))) == {"a": "2"}
    reply = lambda pending, text: one(spark, control.answers_by_question(texts(*pending), F.lit(text)))
    assert reply(["q"], " x ") == {"q": "x"} and reply(["q", "r"], "x") == {control.FREE_REPLY: "x"} and reply(["q"], " ") == {}
    blank = F.create_map(F.lit("q"), F.lit(" "), F.lit("r"), F.lit(""))
    assert one(spark, control.reply_map(blank)) is None and one(spark, control.reply_text(texts("q"), F.create_map(F.lit("q"), F.lit(" x")))) == "x"
    assert one(spark, control.refocus_query(F.lit("q"), texts(" ", None))) is None
    assert one(spark, control.pinned_specialty(F.lit(""), F.lit(None).cast("string"), F.lit("zz"), ["hiv"], "hiv")) is None


def test_modes(spark):
    assert set(modes.MODES) == {"baseline", "iterative", "graph", "pathrag", "hipporag"} and modes.resolve_mode(None, "no", "graph") == "graph" and modes.resolve_mode() == "baseline"
    with pytest.raises(KeyError):
        modes.get_mode("no")
    s = spark.createDataFrame([(1, "x1", 0.5), (1, "x1", 0.9), (1, "x2", 0.8), (1, "y", 0.1)], "q int, node string, score double")
    got = modes.rescaled(modes.distinct_concepts(s, "q", "node", F.substring("node", 1, 1), "score", 2), ["q"], "score").orderBy("rank").collect()
    assert [(r["node"], round(r["score"], 6)) for r in got] == [("x1", 1.0), ("y", 0.1)]
    empty = spark.createDataFrame([], "subject string, object string, score double")
    assert modes.reset_mass(empty, spark.createDataFrame([("p", -1.0)], "node string, similarity double"), spark.createDataFrame([("p",)], "node string")).count() == 0
    hits = spark.createDataFrame([(1, 1, "a", 1, 0.1), (1, 1, "b", 6, 9.0), (1, 2, "a", 1, 0.9), (1, 2, "c", 2, 0.5), (1, 4, "d", 1, 9.0)], "q int, hop int, id string, rank int, own double")
    assert [r["id"] for r in modes.iterate(hits, "q", "id", F.col("own")).orderBy("rank").collect()] == ["c", "a"]


def test_stream_facts(spark, tmp_path):
    schema = "session_id string, turn long, question string, attr string, value string, reset boolean"
    rows = [("s", 1, "q1", "age", "40", False), ("s", 2, "q2", "sex", "f", False), ("s", 3, "q3", "age", "20", True), ("t", 1, "q", None, None, False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = stream_facts(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["session_id"], r["turn"]): (r["previous"], r["facts"]) for r in spark.table("told").collect()}
    assert got == {("s", 1): (None, {"age": "40"}), ("s", 2): ("q1", {"age": "40", "sex": "f"}), ("s", 3): ("q2", {"age": "20"}), ("t", 1): (None, {})}


def test_profiles(spark, tmp_path):
    (tmp_path / "b.toml").write_text('label = "B"\n[prompts]\nask = "x"\n[abbreviations]\nA = "second"\nC = "cc"\n', encoding="utf-8")
    (tmp_path / "a.toml").write_text('[prompts]\nask = "y"\n[abbreviations]\nA = "first"\n', encoding="utf-8")
    got = files.read_profiles(spark, str(tmp_path), ("ask",))
    assert [(r["specialty"], r["label"]) for r in got.collect()] == [("a", "a"), ("b", "B")]
    assert {r["abbreviation"]: r["name"] for r in files.all_abbreviations(got).collect()} == {"A": "first", "C": "cc"}
    with pytest.raises(ValueError):
        files.read_profiles(spark, str(tmp_path), ("ask", "other"))


def test_decoded_vectors(spark):
    m = np.array([[1.5, -2.25, 0.0], [3e-40, -1e30, 0.1]], "<f4")
    frame = lambda rows: spark.createDataFrame([(base64.b64encode(m.tobytes()).decode(), rows)], "matrix string, rows int")
    got = files.decoded_vectors(frame(2), 3).orderBy("row").collect()
    assert np.array_equal(np.array([r["v"] for r in got], "f4"), m)
    with pytest.raises(Exception, match="matrix size"):
        files.decoded_vectors(frame(3), 3).collect()
