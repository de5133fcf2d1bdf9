"""From a model's answer to certified sources: quotes meet their chunks, chunks of one section become one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.labels import clean_list, section_label
from veridock.functions.text import provenance

#: What is said where nothing can be answered, and under an answer.
INSUFFICIENT = "La información no está disponible en las guías proporcionadas."
DISCLAIMER = "Herramienta de apoyo clínico; no sustituye en ningún caso el juicio del profesional sanitario."


def quoted_chunks(used: DataFrame, contexts: DataFrame, answer: str) -> DataFrame:
    """Quotes joined to the chunk they refer to; references that point nowhere go.

    used(answer, sources array<struct<ref, quote>>), contexts(answer, chunks array<struct>): reference 1 is the first chunk. `pos` is the quote's place.
    """
    quotes = used.select(answer, F.posexplode("sources").alias("pos", "_s")).select(answer, "pos", F.col("_s.ref").cast("int").alias("ref"), F.col("_s.quote").alias("quote"))
    numbered = contexts.select(answer, F.posexplode("chunks").alias("_i", "chunk")).select(answer, (F.col("_i") + 1).alias("ref"), "chunk")
    return quotes.join(numbered, [answer, "ref"])


def sources_of(cited: DataFrame, answer: str) -> DataFrame:
    """(answer, place, title, year, organization, section, citations, consulted_only): one row per section of a document, in the order of its first quote.

    cited(answer, pos, status, sentence, grades, doc_title, section_number, heading, section_path, year, organization). Missed quotes leave no citation;
    a section with no other is listed as consulted only. Title, year and label are those of the first chunk.
    """
    key = F.coalesce(F.nullif(F.col("section_number"), F.lit("")), F.coalesce("heading", F.lit("")))
    own = cited.withColumns({"_title": F.coalesce("doc_title", F.lit("")), "_section": key})
    first = F.struct("pos", "_title", "year", "organization", section_label(F.col("heading"), F.col("section_number"), F.col("section_path")).alias("section"))
    kept = F.collect_list(F.when(F.col("status") != "miss", F.struct("pos", "status", "sentence", "grades")))
    groups = own.groupBy(answer, "_title", "_section").agg(F.min_by(first, F.col("pos")).alias("f"), F.array_sort(kept).alias("citations"), F.bool_or(F.col("status") == "miss").alias("missed"))
    out = groups.select(answer, F.col("f.pos").alias("place"), F.col("f._title").alias("title"), "f.year", "f.organization", "f.section", F.transform("citations", lambda c: c.dropFields("pos")).alias("citations"), (F.col("missed") & (F.size("citations") == 0)).alias("consulted_only"))
    return out


def answer_view(sufficient: Column, text: Column, follow_ups: Column) -> Column:
    """struct(sufficient, text, follow_ups): an insufficient answer says so and asks nothing further."""
    enough = F.coalesce(sufficient, F.lit(False))
    return F.struct(enough.alias("sufficient"), F.when(enough, text).otherwise(F.coalesce(text, F.lit(INSUFFICIENT))).alias("text"), F.when(enough, clean_list(follow_ups)).otherwise(F.array().cast("array<string>")).alias("follow_ups"))


def sections_read(contexts: DataFrame, run: str, order: str) -> DataFrame:
    """(run, labels): the distinct sections of contexts(run, order, heading, section_number, section_path, year) in the order they were read, with their years."""
    label = section_label(F.col("heading"), F.col("section_number"), F.col("section_path"))
    told = F.when(label != "", provenance(label, F.col("year")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(told.isNotNull(), F.struct(F.col(order).alias("i"), told.alias("t"))))), lambda x: x["t"])
    return contexts.groupBy(run).agg(F.array_distinct(listed).alias("labels"))


def source_rows(chunks: DataFrame) -> DataFrame:
    """What a source shows of a chunk: title, year, organization, section."""
    return chunks.select("chunk_id", F.col("doc_title").alias("title"), "year", "organization", section_label(F.col("heading"), F.col("section_number"), F.col("section_path")).alias("section"))


def citable(text: Column, retrieval: Column, breadcrumb: Column) -> Column:
    """The text that may be quoted: as it is if the chunk has a retrieval form, else without the breadcrumb that older chunks begin with."""
    opening = F.concat(breadcrumb, F.lit("\n\n"))
    bare = F.when(text.startswith(opening), F.substr(text, F.length(opening) + 1, F.length(text))).otherwise(text)
    return F.when(F.coalesce(retrieval, F.lit("")) != "", text).otherwise(bare)


def markdown_answer(view: Column, sources: Column) -> Column:
    """An answer as Markdown: its text, its sources (array of structs as of sources_of) with their quotes, follow-up questions, the disclaimer."""
    quote = lambda c: F.concat(F.lit("  > "), F.when(c["status"] == "fuzzy", "≈ ").otherwise(""), c["sentence"], F.when(F.size(c["grades"]) > 0, F.concat(F.lit(" ("), F.array_join(c["grades"], ", "), F.lit(")"))).otherwise(""))
    one = lambda s: F.array_join(F.concat(F.array(F.concat(F.lit("- "), provenance(s["title"], s["year"]), F.lit(" — "), s["section"], F.when(s["consulted_only"], " (consultada)").otherwise(""))), F.transform(s["citations"], quote)), "\n")
    blocks = F.array(view["text"], F.when(F.size(sources) > 0, F.concat(F.lit("**Fuentes**\n"), F.array_join(F.transform(sources, one), "\n"))), F.when(F.size(view["follow_ups"]) > 0, F.concat(F.lit("**Preguntas de seguimiento**\n"), F.array_join(F.transform(view["follow_ups"], lambda q: F.concat(F.lit("- "), q)), "\n"))), F.when(view["sufficient"], F.lit(f"_{DISCLAIMER}_")))
    return F.array_join(F.array_compact(blocks), "\n\n")
