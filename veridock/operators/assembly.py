"""From lines, figures and tables of pages, as an extractor leaves them, to blocks in reading order and a document's Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions.labels import heading_level
from veridock.functions.text import expand_ligatures, strip, tidy
from veridock.operators.extraction import head_key, is_noise, outside_regions, running_heads

#: Sizes against the running text's: smaller is a superscript, larger a heading; share of a page from which an image counts as a figure.
SUPERSCRIPT, LARGE, FIGURE = 0.8, 1.08, 0.04
#: Fixed value: headings of sections that are left out.
DROPPED = r"(?i)^(bibliograf(i|í)a|referencias|comit(e|é) de redacci(o|ó)n|agradecimientos|conflicto[s]? de intere|autores|coordinador)"


def body_size(chars: DataFrame) -> DataFrame:
    """(doc_id, body): the most frequent size of chars(doc_id, size), rounded to a tenth; of equals the smaller."""
    n = chars.groupBy("doc_id", F.round("size", 1).alias("s")).agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def figures(images: DataFrame) -> DataFrame:
    """(doc_id, page, top, kind, text) of images(doc_id, page, x0, top, x1, bottom, width, height) that take FIGURE or more of their page."""
    area = F.abs(F.col("x1") - F.col("x0")) * F.abs(F.col("bottom") - F.col("top")) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    marker = F.concat(F.lit("> _[Figura omitida — p. "), F.col("page").cast("string"), F.lit(" — consultar PDF original]_"))
    return images.where(area >= FIGURE).select("doc_id", "page", "top", F.lit("omission").alias("kind"), marker.alias("text"), F.lit(None).cast("int").alias("level"))


def text_blocks(lines: DataFrame, sizes: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, top, kind, text, level) of lines(doc_id, page, line_no, x0, top, size, bold, text).

    Lines inside tables, superscripts, page and citation numbers, leaders of contents and running heads go. A styled line (large or bold) is a heading if its text says so, else the
    continuation of one.
    """
    own = lines if regions is None else outside_regions(lines, regions)
    own = own.join(sizes, "doc_id").where(F.col("size") >= SUPERSCRIPT * F.col("body")).withColumn("text", strip(expand_ligatures(F.col("text"))))
    own = own.where((F.col("text") != "") & ~is_noise(F.col("text"))).withColumn("key", head_key(F.col("text")))
    own = own.join(running_heads(lines), ["doc_id", "key"], "left_anti")
    styled = (F.col("size") > LARGE * F.col("body")) | F.col("bold")
    level = heading_level(F.col("text"))
    kind = F.when(styled & level.isNotNull(), "heading").when(styled, "heading_cont").otherwise("text")
    return own.select("doc_id", "page", "top", kind.alias("kind"), "text", F.when(styled, level).alias("level"))


def page_blocks(*parts: DataFrame) -> DataFrame:
    """All blocks of a document with their place in reading order: by page, then from the top."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "top", "kind", "text")))


def kept_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks outside dropped sections. Such a section ends at the next heading that isn't deeper than its own.

    Nested windows: of the headings up to a block, the last dropped one of each level holds if no other heading of that level or above came after it.
    """
    w = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    head, bad = F.col("kind") == "heading", (F.col("kind") == "heading") & F.col("text").rlike(DROPPED)
    inside = F.lit(False)
    for n in range(1, 7):
        last_bad = F.max(F.when(bad & (F.col("level") == n), F.col("place"))).over(w)
        last_end = F.max(F.when(head & (F.col("level") <= n), F.col("place"))).over(w)
        inside = inside | F.coalesce(last_bad == last_end, F.lit(False))
    return blocks.withColumn("_in", inside).where("NOT _in").drop("_in")


def assembled(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown) of blocks(doc_id, place, kind, text, level), in order and outside dropped sections.

    A continuation joins the heading that stands right before it, else it is a line of text. Lines join until one ends a sentence; tables and
    omissions stand alone. Each block gets the number of the paragraph it is in by a running count of where one begins.
    """
    w = Window.partitionBy("doc_id").orderBy("place")
    own = kept_blocks(blocks).withColumn("solid", F.max(F.when(F.col("kind") != "heading_cont", F.struct("place", "kind"))).over(w)["kind"])
    own = own.withColumn("role", F.when((F.col("kind") == "heading_cont") & (F.col("solid") == "heading"), "more").when(F.col("kind") == "heading_cont", "text").otherwise(F.col("kind")))
    closes = F.coalesce(F.lag((F.col("role") != "text") | (F.col("kind") == "text") & F.col("text").rlike(r"[.:?!]$")).over(w), F.lit(True))
    begins = (F.col("role") != "more") & ((F.col("role") != "text") | closes)
    own = own.withColumn("part", F.sum(begins.cast("int")).over(w))
    shown = F.when(F.col("role") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    parts = own.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), "\n\n")
    return parts.groupBy("doc_id").agg(tidy(whole).alias("markdown"))


def fill_cells(rows: DataFrame, table: str, order: str, cells: str, columns: list[int]) -> DataFrame:
    """Labels of declared columns carried down into empty cells of rows that have something in another column; numbers and grades are values and are never carried."""
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    others = F.exists(F.transform(F.col(cells), lambda c, i: (c != "") & ~i.isin(*columns)), lambda x: x)
    values = {}
    for c in columns:
        own = F.trim(F.get(cells, F.lit(c)))
        label = F.when(own != "", F.when(own.rlike(r"\d") | own.rlike(r"\b[ABC]\s*-?\s*I{1,3}\b"), "").otherwise(F.get(cells, F.lit(c))))
        carried = F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(""))
        values[c] = F.when((own == "") & others, carried).otherwise(F.get(cells, F.lit(c)))
    new = F.struct(*[v.alias(f"c{c}") for c, v in values.items()])

    def cell(x, i):
        out = x
        for c in columns:
            out = F.when(i == c, F.col("_new")[f"c{c}"]).otherwise(out)
        return out

    return rows.withColumn("_new", new).withColumn("filled", F.transform(cells, cell)).drop("_new") if columns else rows.withColumn("filled", F.col(cells))


def written_documents(documents: DataFrame) -> Column:
    """Whether a document of documents(status, markdown) is fit to be written: legible pages and some text."""
    return (F.col("status") == "native_ok") & (F.length(F.trim("markdown")) > 0)
