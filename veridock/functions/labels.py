"""Headings, section labels and rendered blocks, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridock.functions.text import RECORD_ROW, TABLE_ROW, collapse, strip

#: A numbered heading; headings without numbers and their levels, in the order in which they are tried.
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
UNNUMBERED = (
    (r"(?i)^recomendaci(o|ó)n(es)?\s*:?\s*$", 4),
    (r"(?i)^(tabla|figura)\s*\d+", 4),
    (r"(?i)^bibliograf(i|í)a", 3),
    (r"(?i)^(anexo|ap(e|é)ndice|algoritmo)", 2),
    (r"(?i)^(listado de )?abreviaturas", 2),
    (r"(?i)^metodolog(i|í)a", 2),
)
LONGEST_HEADING, DEEPEST, BREADCRUMB_TOKENS, GRID_COLUMNS, UNIT_CHARS = 160, 6, 120, 6, 40
TOKEN = r"(?U)\w+|[^\w\s]"


def heading_level(line: Column) -> Column:
    """Level from the numbering (one part is level 2), else from the genre's headings; null for body text and overlong lines."""
    level = F.when(line.rlike(NUMBERED), F.least(F.lit(DEEPEST), F.size(F.split(F.regexp_extract(line, NUMBERED, 1), r"\.")) + 1))
    for pattern, n in UNNUMBERED:
        level = level.when(line.rlike(pattern), n)
    return F.when(F.length(line) <= LONGEST_HEADING, level)


def _title(part: Column) -> Column:
    return F.when(part.rlike(NUMBERED), strip(F.regexp_extract(part, NUMBERED, 2))).otherwise(strip(part))


def section_label(heading: Column, number: Column, path: Column) -> Column:
    """What a citation is listed under: its own number, else the nearest numbered ancestor, else the chain of ancestors.

    path: headings from the top down to the chunk's own. Nulls count as empty.
    """
    heading, number = strip(F.coalesce(heading, F.lit(""))), strip(F.coalesce(number, F.lit("")))
    own = strip(F.regexp_replace(heading, r"^[\d.\s]+", ""))
    parts = F.transform(F.coalesce(path, F.array().cast("array<string>")), collapse)
    last = F.element_at(parts, -1)
    leaf = F.when(own != "", own).otherwise(_title(last))
    above = F.when((own != "") & (F.lower(last) != F.lower(collapse(heading))), parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    numbered = F.element_at(F.filter(above, lambda p: p.rlike(NUMBERED)), -1)
    located = F.concat(F.lit("§"), F.regexp_extract(numbered, NUMBERED, 1), F.lit(" "), _title(numbered), F.lit(" › "), leaf)
    chain = F.array_join(F.concat(F.transform(above, _title), F.array(leaf)), " › ")
    by_number = F.concat(F.lit("§"), number, F.when(own != "", F.concat(F.lit(" · "), own)).otherwise(F.lit("")))
    return F.when(number != "", by_number).when(F.size(parts) == 0, own).when(F.exists(above, lambda p: p.rlike(NUMBERED)), located).otherwise(chain)


def breadcrumb_prefix(path: Column, most: int = BREADCRUMB_TOKENS) -> Column:
    """`A > B` and an empty line; ancestors go from the left until the line has at most `most` tokens, a lone overlong heading is cut."""
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda i: F.array_join(F.slice(path, i, F.size(path)), " > "))
    fits = F.filter(tails, lambda x: F.regexp_count(x, F.lit(TOKEN)) <= most)
    alone = F.concat(F.rtrim(F.substring(F.element_at(tails, -1), 1, 4 * most)), F.lit("…"))
    return F.when(F.coalesce(F.size(path), F.lit(0)) <= 0, "").otherwise(F.concat(F.when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(alone), F.lit("\n\n")))


def linearised(subject: Column, relation: Column, object_: Column) -> Column:
    """A triple as a phrase."""
    return F.concat_ws(" ", strip(subject), strip(relation), strip(object_))


def digest(heading: Column, body: Column, chars: int = 200) -> Column:
    """One line of what was read: the heading and the opening of the body."""
    return F.concat(F.lit("- "), strip(F.coalesce(heading, F.lit(""))), F.lit(": "), F.substring(F.replace(strip(F.coalesce(body, F.lit(""))), F.lit("\n"), F.lit(" ")), 1, chars))


def record_line(header: Column, cells: Column) -> Column:
    """A row of a wide table as `- label: column «cell»; ….`; empty cells are left out. Null if there is no label or no cell."""
    pairs = F.transform(F.arrays_zip(header.alias("h"), cells.alias("c")), lambda x: F.struct(strip(x["h"]).alias("h"), strip(x["c"]).alias("c")))
    told = F.filter(F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0))), lambda x: (x["c"] != "") & x["h"].isNotNull())
    label = strip(F.get(cells, F.lit(0)))
    body = F.array_join(F.transform(told, lambda x: F.concat(x["h"], F.lit(" «"), x["c"], F.lit("»"))), "; ")
    return F.when((label != "") & (F.size(told) > 0), F.concat(F.lit("- "), label, F.lit(": "), body, F.lit(".")))


def rendered_table(header: Column, rows: Column) -> Column:
    """A grid up to six columns, else one record a row."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(header, lambda _: F.lit("---")), "|"), F.lit("|"))
    grid = F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")
    return F.when(F.size(header) <= GRID_COLUMNS, grid).otherwise(F.array_join(F.transform(rows, lambda r: record_line(header, r)), "\n"))


def coverage_units(markdown: Column) -> Column:
    """Pieces of a source that must reach chunks: paragraphs of 40 characters or more; of tables and records, such lines. Headings don't count."""
    blocks = F.transform(F.split(markdown, r"\n\s*\n"), lambda b: strip(b))
    rows = lambda b: F.split(b, "\n")
    tabular = lambda b: F.exists(rows(b), lambda x: x.rlike(TABLE_ROW)) | (F.size(F.filter(rows(b), lambda x: x.rlike(RECORD_ROW))) >= 2)
    pieces = F.flatten(F.transform(F.filter(blocks, lambda b: (b != "") & ~b.startswith("#")), lambda b: F.when(tabular(b), F.transform(rows(b), strip)).otherwise(F.array(b))))
    return F.filter(pieces, lambda p: F.length(p) >= UNIT_CHARS)


def clamped(x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A region kept inside its page."""
    zero = F.lit(0.0)
    return F.struct(F.greatest(zero, x0).alias("x0"), F.greatest(zero, top).alias("top"), F.least(width, x1).alias("x1"), F.least(height, bottom).alias("bottom"))


def page_range(spec: Column) -> Column:
    """Pages of `3` or `2-5`; null for no restriction."""
    ends = F.split(spec, "-", 2)
    return F.when(F.coalesce(spec, F.lit("")) != "", F.sequence(F.get(ends, F.lit(0)).cast("int"), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).cast("int")))


def abbreviation_list(names: Column) -> Column:
    """`ABBR = name` for each entry of a map, in order, comma-joined."""
    return F.array_join(F.transform(F.map_entries(names), lambda e: F.concat_ws(" = ", e["key"], e["value"])), ", ")


def clean_list(items: Column) -> Column:
    """Trimmed, without blank items: follow-up questions, unsupported claims."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")
