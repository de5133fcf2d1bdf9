"""Structured text to sections and sized chunks, and figures of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions.labels import breadcrumb_prefix
from veridock.functions.text import HEADING, RECORD_ROW, SECTION_NUMBER, TABLE_ROW, content_id, grades, section_number

#: Sizes in tokens: upper bound, aim of merging, size under which a section is merged, overlap, cap of the breadcrumb.
MAX_TOKENS, TARGET_TOKENS, MIN_TOKENS, OVERLAP_TOKENS, PREFIX_TOKENS = 900, 600, 200, 80, 120
PREAMBLE = "Preámbulo"
TOKEN = re.compile(r"\w+|[^\w\s]")
RECORD = re.compile(RECORD_ROW, re.M)


def count_tokens(text: str) -> int:
    """Words and marks: a deterministic unit of its own, not that of any model."""
    return len(TOKEN.findall(text))


def sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sec, level, heading, breadcrumb, section_number, body) of headed text, by window functions alone.

    A line's section is the number of headings up to it. For each heading, the last heading of each smaller level is an ancestor if no heading
    of a still smaller level came after it.
    """
    rows = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("level", F.length(F.regexp_extract("line", HEADING, 1)))
    order = Window.partitionBy(doc).orderBy("line_no")
    rows = rows.withColumn("sec", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(order))
    for i in range(1, 7):
        rows = rows.withColumn(f"at{i}", F.max(F.when(F.col("level") == i, F.struct("line_no", F.regexp_extract("line", HEADING, 2).alias("name")))).over(order))
    ups = []
    for i in range(1, 7):
        shallower = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"at{j}.line_no"), F.lit(-1)) for j in range(1, i)], F.lit(-1))
        ups.append(F.when(F.col(f"at{i}").isNotNull() & (F.col(f"at{i}.line_no") > shallower) & (F.lit(i) <= F.col("own")), F.col(f"at{i}.name")))
    heads = rows.where("level > 0").withColumn("own", F.col("level")).select(doc, "sec", F.col("level"), F.filter(F.array(*ups), lambda x: x.isNotNull()).alias("breadcrumb"))
    body = rows.groupBy(doc, "sec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"))
    out = body.join(heads, [doc, "sec"], "left").withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))
    out = out.withColumn("heading", F.coalesce(F.element_at("breadcrumb", -1), F.lit(PREAMBLE)))
    out = out.where("sec > 0 OR body <> ''")
    return out.select(doc, "sec", F.coalesce("level", F.lit(1)).alias("level"), "heading", F.coalesce("breadcrumb", F.array(F.lit(PREAMBLE))).alias("breadcrumb"), section_number(F.col("heading")).alias("section_number"), "body")


class Section(NamedTuple):
    level: int
    heading: str
    path: tuple[str, ...]
    body: str


def content_type(s: Section) -> str:
    """Kind of a section by ordered rules over heading and body."""
    name, rows, text = s.heading.lower(), sum(bool(re.match(TABLE_ROW, x)) for x in s.body.split("\n")), sum(bool(x.strip()) for x in s.body.split("\n"))
    if "abreviatura" in name:
        return "abbreviations"
    if re.search("recomendaci[oó]n", name) and s.level >= 4:
        return "recommendations"
    if re.match(r"(tabla|figura)\b", name):
        return "table" if rows or RECORD.search(s.body) else "text"
    if re.search(r"\banexo|algoritmo", name):
        return "appendix"
    if re.search("metodolog[ií]a", name):
        return "methodology"
    return "table" if rows >= 3 and rows > 0.6 * text else "text"


def pack(units: list[str], budget: int, joiner: str) -> list[str]:
    """Greedy packing in order: a new pack begins where the next unit would overflow; a unit over the budget stands alone."""
    out: list[str] = []
    for u in units:
        if out and count_tokens(joined := out[-1] + joiner + u) <= budget:
            out[-1] = joined
        else:
            out.append(u)
    return out


def split_table(block: str, budget: int) -> list[str]:
    """Rows are never cut; header and rule come first in every piece."""
    rows = block.split("\n")
    rule = next((i for i, r in enumerate(rows[:3]) if re.fullmatch(r"\s*\|[\s:|-]+\|\s*", r)), None)
    head = rows[: rule + 1] if rule else []
    room = max(1, budget - count_tokens("\n".join(head)))
    return ["\n".join([*head, p]) for p in pack(rows[len(head) :], room, "\n")]


def split_block(block: str, budget: int) -> list[str]:
    lines_ = block.split("\n")
    if any(re.match(TABLE_ROW, x) for x in lines_):
        return split_table(block, budget)
    if len(RECORD.findall(block)) >= 2:
        return pack(lines_, budget, "\n")
    sentences = re.split(r"(?<=[.!?])\s+", block)
    return pack(sentences, budget, " ") if len(sentences) > 1 else [block]


def tail(text: str, budget: int = OVERLAP_TOKENS) -> str:
    """Last sentences up to the budget, one at least."""
    kept: list[str] = []
    for s in reversed(re.split(r"(?<=[.!?])\s+", text)):
        if kept and count_tokens(" ".join([s, *kept])) > budget:
            break
        kept.insert(0, s)
    return " ".join(kept)


def split_section(body: str, budget: int) -> list[str]:
    """Paragraphs packed to the budget; the end of a pack is carried into the next one where it fits."""
    blocks = [b for p in re.split(r"\n\s*\n", body) if p.strip() for b in ([p] if count_tokens(p) <= budget else split_block(p, budget))]
    out: list[str] = []
    for b in blocks:
        if out and count_tokens(out[-1] + "\n\n" + b) <= budget:
            out[-1] += "\n\n" + b
            continue
        over = tail(out[-1]) if out else ""
        out.append(f"{over}\n\n{b}" if over and over != out[-1] and count_tokens(over + "\n\n" + b) <= budget else b)
    return out


def units(own: list[Section]) -> Iterator[tuple[Section, str, str, list[str]]]:
    """(first section, body, type, headings) of each chunk-to-be of a document: big sections are split, small ones merged inside their parent's subtree."""
    i = 0
    while i < len(own):
        s, kind = own[i], content_type(own[i])
        budget = max(MAX_TOKENS - min(PREFIX_TOKENS, count_tokens(" > ".join(s.path))), MIN_TOKENS)
        size = count_tokens(s.body)
        i += 1
        if not s.body.strip():
            continue
        if size > budget:
            for piece in split_section(s.body, budget):
                yield s, piece, "text" if kind == "table" and not any(re.match(TABLE_ROW, x) for x in piece.split("\n")) else kind, [s.heading]
        elif size < MIN_TOKENS and kind in ("text", "recommendations"):
            body, heads = s.body, [s.heading]
            while i < len(own) and count_tokens(body) < TARGET_TOKENS:
                t = own[i]
                if content_type(t) in ("table", "abbreviations") or t.path[: len(s.path) - 1] != s.path[:-1] or len(t.path) < len(s.path):
                    break
                more = f"\n\n{'#' * max(t.level, 2)} {t.heading}\n{t.body}" if t.body.strip() else ""
                if count_tokens(body + more) > budget:
                    break
                body, heads, i = body + more, heads + [t.heading] * bool(more), i + 1
            yield s, body, kind, heads
        else:
            yield s, s.body, kind, [s.heading]


CHUNK = "doc_id string, chunk_index int, heading string, level int, section_path array<string>, section_number string, content_type string, n_chars int, text string"
#: What a document's row of the manifest says of each of its chunks.
METADATA = ("doc_title", "specialty", "topics", "organization", "year")


def _chunks(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("sec")
    own = [Section(int(r.level), r.heading, tuple(r.breadcrumb), r.body) for r in rows.itertuples()]
    out, seen = [], set()
    for k, (s, body, kind, heads) in enumerate(units(own)):
        if body in seen:
            continue
        seen.add(body)
        numbers = [m[1].split(".") for h in heads if (m := re.match(SECTION_NUMBER, h + " "))]
        common = []
        for parts in zip(*numbers, strict=False):
            if len(set(parts)) > 1:
                break
            common.append(parts[0])
        number = ".".join(common)
        path = s.path
        if number and len(heads) > 1:  # several sections: the chunk is that of the ancestor they have in common, if it has that number
            path = next((s.path[: i + 1] for i in range(len(s.path) - 1, -1, -1) if re.match(re.escape(number) + r"\.?\s", s.path[i])), s.path)
        out.append((str(rows["doc_id"].iloc[0]), k, path[-1] if path else s.heading, s.level, list(path), number or None, kind, len(body), body))
    return pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")])


def chunks(docs: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Chunks of docs(doc_id, text), documents in parallel, with a content-addressed chunk_id, evidence grades and, of manifest(doc_id, title, ...), METADATA.

    A text without headings has its document's title as its path. text is what may be cited; text_for_retrieval has the capped breadcrumb before
    it, and n_tokens counts that.
    """
    own = sections(docs).groupBy("doc_id").applyInPandas(_chunks, CHUNK)
    known = None if manifest is None else manifest.select(F.col("doc_id").cast("string").alias("doc_id"), *[F.col("title" if c == "doc_title" else c).alias(c) for c in METADATA])
    own = own.withColumns({c: F.lit(None).cast("array<string>" if c == "topics" else "int" if c == "year" else "string") for c in METADATA}) if known is None else own.join(known, "doc_id", "left")
    bare = F.size(F.filter("section_path", lambda p: p != PREAMBLE)) == 0
    own = own.withColumn("section_path", F.when(bare & F.col("doc_title").isNotNull(), F.array("doc_title")).otherwise(F.col("section_path")))
    full = F.concat(breadcrumb_prefix(F.col("section_path"), PREFIX_TOKENS), F.col("text"))
    own = own.withColumns({"text_for_retrieval": full, "evidence_grades": grades(F.col("text")), "chunk_id": content_id(F.col("doc_id"), F.col("section_number"), F.col("heading"), F.col("text"))})
    return own.withColumn("n_tokens", F.regexp_count("text_for_retrieval", F.lit(r"(?U)\w+|[^\w\s]")))


def neighbours(df: DataFrame, group: str, order: str, text: str, window: int = 1) -> DataFrame:
    """Column `neighbours`: the texts of the rows around each, without its own."""
    w = Window.partitionBy(group).orderBy(order)
    around = F.concat(F.collect_list(text).over(w.rowsBetween(-window, -1)), F.collect_list(text).over(w.rowsBetween(1, window)))
    return df.withColumn("neighbours", F.when(F.size(around) == 0, "(sin vecinos)").otherwise(F.array_join(around, "\n---\n")))
