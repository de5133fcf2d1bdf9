"""Quality gates over chunks and sources: each yields rows (code, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions.labels import coverage_units
from veridock.functions.text import GRADE, LIGATURES, RECORD_ROW, TABLE_ROW, collapse, fold, has_tabular_content, is_mostly_table
from veridock.operators.lineage import cut

MAX_TOKENS, OPENING, COVERAGE = 900, 120, 0.995
CODES = [f"G{i}" for i in range(1, 12)]


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def _rows(df: DataFrame, code: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def indexed(c: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("text_for_retrieval"), F.lit("")), F.col("text")) if "text_for_retrieval" in c.columns else F.col("text")


def chunk_gates(c: DataFrame) -> DataFrame:
    """G1, G2, G3, G10, G11 over chunks(chunk_id, text, content_type, n_tokens)."""
    own, subject = n_tokens(indexed(c)), F.col("chunk_id")
    openings = c.groupBy(F.substring(collapse(F.col("text")), 1, OPENING).alias("opening")).agg(F.count("*").alias("n")).where("n > 1")
    kind = F.when((F.col("content_type") == "table") & ~has_tabular_content(F.col("text")), "no table data").when((F.col("content_type") == "text") & is_mostly_table(F.col("text")), "is a table")
    return reduce(DataFrame.unionAll, [
        _rows(c.where(own > MAX_TOKENS), "G1", subject, own),
        _rows(c.where(F.trim("text") == ""), "G2", subject, F.lit("empty body")),
        _rows(openings, "G3", F.col("opening"), F.col("n")),
        _rows(c.where(kind.isNotNull()), "G10", subject, kind),
        _rows(c.where(F.col("n_tokens") != own), "G11", subject, own),
    ])


#: The one accepted omission marker, anything that looks like one (with what may stand around it), and the marker's own words.
OMISSION = r"^> _\[(Figura|Algoritmo|Tabla) omitid[ao] — p\. \d+ — consultar PDF original\]_$"
ANY_OMISSION = r"(?:> _)?\[[^\]]*omitid[ao][^\]]*\]_?"
MARKER_WORDS = ("figura", "algoritmo", "tabla", "omitida", "omitido", "p", "consultar", "pdf", "original")
#: A grade with a clause after its full stop, grades that the scheme doesn't read, emphasis that is closed and opened again, a caption.
MID_SENTENCE = r"\(\s*\*{0,2}\s*[ABC]\s*-?\s*I{1,3}\s*\*{0,2}\s*\)[*_ \t]{0,6}\.[*_ \t]{0,4}\n?[*_ \t]{0,4}[a-záéíóúñü]"
LOOSE_GRADE = r"\([_*\s]*[ABC][_*\s]*-?[_*\s]*I{1,3}[_*\s.]*\)|\([ABC]I{1,3}\s*-\s*[ABC]I{1,3}\)"
BROKEN_EMPHASIS = r"_\s+_"
CAPTION = r"^(?:#{1,6}\s+|\*\*)\s*(?:TABLA|Tabla)\s*\d+"


def _found(column: str, pattern: str) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def omissions(s: DataFrame) -> DataFrame:
    """G4: markers that aren't the accepted one, and accepted ones that stand for a table, whose text must be recovered."""
    each = s.select("name", F.explode(_found("markdown", ANY_OMISSION)).alias("marker"))
    why = F.when(~F.col("marker").rlike(OMISSION), "not canonical").when(F.col("marker").startswith("> _[Tabla"), "table omitted")
    return _rows(each.withColumn("why", why).where("why IS NOT NULL"), "G4", F.col("name"), F.concat_ws(": ", "why", "marker"))


def _words(d: DataFrame, text: str) -> DataFrame:
    return d.select("name", F.explode(F.regexp_extract_all(fold(F.col(text)), F.lit("[a-zñ]+"), F.lit(0))).alias("token"))


def unknown_words(s: DataFrame, vocabulary: tuple[str, ...] = MARKER_WORDS) -> DataFrame:
    """(name, token, n): words of a source that its reference text and the markers' vocabulary lack; a set difference by anti-join."""
    own = _words(s.where("reference IS NOT NULL"), "markdown").groupBy("name", "token").agg(F.count("*").alias("n")).where(~F.col("token").isin(*vocabulary))
    return own.join(_words(s, "reference").distinct(), ["name", "token"], "left_anti")


def words_unknown_to(s: DataFrame, reference: DataFrame, vocabulary: tuple[str, ...] = MARKER_WORDS) -> DataFrame:
    """unknown_words() where all sources(name, markdown) have the same reference(text): its texts are read once, not once a source.

    Words are taken out before they are counted; the reference's are broadcast if there are at most 100,000 of them.
    """
    known = cut(_words(reference.select(F.lit("").alias("name"), "text"), "text").select("token").distinct())
    own = _words(s, "markdown").where(~F.col("token").isin(*vocabulary))
    return own.join(F.broadcast(known) if known.count() <= 100_000 else known, "token", "left_anti").groupBy("name", "token").agg(F.count("*").alias("n"))


def bare_captions(s: DataFrame) -> DataFrame:
    """(name, caption) of captions without rows of data before the next caption or heading: lines are numbered by the captions and headings up to them."""
    lines = s.select("name", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("caption", F.col("line").rlike(CAPTION))
    w = Window.partitionBy("name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = lines.withColumn("part", F.sum((F.col("caption") | F.col("line").rlike(r"^#{1,6}\s")).cast("int")).over(w))
    data = F.col("line").rlike(TABLE_ROW) | F.col("line").rlike(RECORD_ROW)
    each = parts.groupBy("name", "part").agg(F.max(F.when(F.col("caption"), F.col("line"))).alias("caption"), F.max((data & ~F.col("caption")).cast("int")).alias("data"))
    return each.where("caption IS NOT NULL AND data = 0").select("name", "caption")


def coverage(s: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, units, lost): the pieces of a source that must reach chunks(name, text, chunk_index), and how many don't. Texts are joined in their order."""
    order = F.col("chunk_index") if "chunk_index" in chunks.columns else F.lit(0)
    parts = F.array_sort(F.collect_list(F.struct(order.alias("i"), collapse(F.col("text")).alias("t"))))
    whole = chunks.groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("whole"))
    units = s.select("name", F.explode(coverage_units(F.col("markdown"))).alias("unit"))
    found = units.join(whole, "name", "left").withColumn("lost", ~F.coalesce(F.contains("whole", collapse(F.col("unit"))), F.lit(False)))
    return found.groupBy("name").agg(F.count("*").alias("units"), F.count_if("lost").alias("lost"))


def bijection(files: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """(key, why) of what only one of two sets of names has."""
    both = files.select(key, F.lit(1).alias("_f")).join(listed.select(key, F.lit(1).alias("_l")), key, "full_outer")
    return both.where("_f IS NULL OR _l IS NULL").select(key, F.when(F.col("_f").isNull(), "no file").otherwise("not listed").alias("why"))


def source_gates(s: DataFrame, chunks: DataFrame, listed: DataFrame, vocabulary: tuple[str, ...] = MARKER_WORDS) -> DataFrame:
    """G4-G9 over sources(name, markdown, reference), chunks(name, text, chunk_index) and the manifest listed(name)."""
    glyph = F.explode(F.filter(F.array(*map(F.lit, LIGATURES)), lambda g: F.contains("markdown", g)))
    loose = s.select("name", F.explode(_found("markdown", LOOSE_GRADE)).alias("grade")).where(~F.col("grade").rlike(f"^(?:{GRADE})$"))
    broken = s.select("name", F.regexp_count("markdown", F.lit(BROKEN_EMPHASIS)).alias("n")).where("n > 0")
    reach = coverage(s, chunks).withColumn("share", 1 - F.col("lost") / F.col("units"))
    return reduce(DataFrame.unionAll, [
        omissions(s),
        _rows(s.select("name", glyph.alias("glyph")), "G5", F.col("name"), F.col("glyph")),
        _rows(s.where("reference IS NULL"), "G5", F.col("name"), F.lit("no reference")),
        _rows(unknown_words(s, vocabulary), "G5", F.col("name"), F.concat_ws(" x ", "token", "n")),
        _rows(s.select("name", F.explode(_found("markdown", MID_SENTENCE)).alias("x")), "G6", F.col("name"), F.col("x")),
        _rows(broken, "G6", F.col("name"), F.col("n")),
        _rows(loose, "G6", F.col("name"), F.col("grade")),
        _rows(bare_captions(s), "G7", F.col("name"), F.col("caption")),
        _rows(reach.where(F.col("share") < COVERAGE), "G8", F.col("name"), F.col("share")),
        _rows(bijection(s, listed), "G9", F.col("name"), F.col("why")),
    ])


def rollup(findings: DataFrame, codes: list[str] = CODES) -> DataFrame:
    """(code, findings, passed) of every gate, those without findings too."""
    spark = findings.sparkSession
    return spark.createDataFrame([(c,) for c in codes], "code string").join(findings.groupBy("code").agg(F.count("*").alias("n")), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("findings"), F.col("n").isNull().alias("passed"))
