"""Text expressions: normalisation, keys, tokens, labels. All are Catalyst expressions; none needs a Python worker."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition (NFKD), without combining marks, is one other character, or several of ASCII."""
    one, many = {}, {}
    for c in map(chr, [*range(0xA0, 0x2E80), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one[c] = plain
        elif len(plain) > 1 and plain.isascii() and plain.isalnum():
            many[c] = plain
    return one, many


SINGLE, SEVERAL = _compatible()
#: Ligature glyphs and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Fixed value: an inline evidence grade, a heading, a section number at a heading's start, a table row.
GRADE = r"\(\s*\*{0,2}\s*([ABC])\s*-?\s*(I{1,3})\s*\*{0,2}\s*\)"
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
SECTION_NUMBER = r"^(\d+(?:\.\d+)*)\.?\s"
TABLE_ROW = r"^\s*\|.*\|\s*$"
#: Fixed value: a row of a wide table that became a record.
RECORD_ROW = r"^\s*[-*]\s+\S.*?:\s+\S"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def citation_form(x: Column) -> Column:
    """Markup and inline grades removed, marks become spaces, collapsed, lower-cased."""
    y = F.regexp_replace(x, r"[_*`\\]", "")
    y = F.regexp_replace(y, GRADE, " ")
    return F.lower(collapse(F.regexp_replace(y, r"[^\p{L}\p{N}\s]", " ")))


def _undone(x: Column) -> Column:
    split = x
    for c, plain in SEVERAL.items():
        split = F.replace(split, F.lit(c), F.lit(plain))
    y = F.translate(F.when(x.rlike("[" + "".join(SEVERAL) + "]"), split).otherwise(x), "".join(SINGLE), "".join(SINGLE.values()))
    return F.regexp_replace(y, r"\p{Mn}+", "")


def strip_accents(x: Column) -> Column:
    """Compatibility forms and accents undone (NFKD without combining marks), as far as a form stands for one character or for ASCII letters and digits.

    Only the runs of other than ASCII characters are looked at, as looking up a character costs a hundred times what copying it does.
    """
    runs = F.regexp_extract_all(x, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]+"), F.lit(0))
    each = F.transform(runs, lambda r: F.when(r.rlike(r"^[\x00-\x7f]"), r).otherwise(_undone(r)))
    return F.when(x.rlike(r"[^\x00-\x7f]"), F.array_join(each, "")).otherwise(x)


def fold(x: Column) -> Column:
    return strip_accents(F.lower(x))


def expand_ligatures(x: Column) -> Column:
    for glyph, letters in LIGATURES.items():
        x = F.replace(x, F.lit(glyph), F.lit(letters))
    return x


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^0-9a-záéíóúüñ]+", "")


def tidy(x: Column) -> Column:
    """No space before marks, no blanks at line ends, at most one empty line in a row, one line end at the end."""
    y = F.regexp_replace(x, r"[ \t]+([,.;:)])", "$1")
    y = F.regexp_replace(y, r"[ \t]+\n", "\n")
    y = F.regexp_replace(y, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(y, r"^\s+|\s+$", ""), F.lit("\n"))


def canonical_key(x: Column, names: list[tuple[str, str]]) -> Column:
    """Key of a concept: folded, full names replaced by their abbreviations (longest first), distinct words in order.

    names: (abbreviation, name), a dictionary held on the driver.
    """
    y = fold(x)
    for abbr, name in sorted(names, key=lambda p: (-len(p[1]), p[1])):
        y = F.replace(y, fold(F.lit(name)), fold(F.lit(abbr)))
    words = F.split(F.trim(F.regexp_replace(y, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.array_distinct(words), " ")


def expand_abbreviations(x: Column, names: list[tuple[str, str]]) -> Column:
    """`ABBR` becomes `name (ABBR)` unless the name is there already; longest abbreviations first, each on what the ones before made."""
    for abbr, name in sorted(names, key=lambda p: (-len(p[0]), p[0])):
        step = lambda y: F.when(F.contains(y, F.lit(abbr)) & ~F.contains(fold(y), fold(F.lit(name))), F.replace(y, F.lit(abbr), F.lit(f"{name} ({abbr})"))).otherwise(y)  # noqa: B023, E731
        x = F.get(F.transform(F.array(x), step), F.lit(0))  # a variable: else each step would make all before it anew at every mention
    return x


def grades(x: Column) -> Column:
    """Distinct grades in the order in which they first appear, as `A-II`."""
    found = F.regexp_extract_all(x, F.lit(GRADE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda g: F.concat_ws("-", F.regexp_extract(g, GRADE, 1), F.regexp_extract(g, GRADE, 2))))


def section_number(heading: Column) -> Column:
    got = F.regexp_extract(heading, SECTION_NUMBER, 1)
    return F.when(got != "", got)


def common_section_number(numbers: Column) -> Column:
    """Longest common prefix, by parts, of an array of section numbers; null if there is none."""
    parts = F.transform(numbers, lambda n: F.split(n, r"\."))
    first = parts[0]
    same = F.filter(F.sequence(F.lit(1), F.size(first)), lambda k: F.forall(parts, lambda p: F.slice(p, F.lit(1), k) == F.slice(first, F.lit(1), k)))
    depth = F.coalesce(F.array_max(same), F.lit(0))
    return F.when((F.size(numbers) > 0) & (depth > 0), F.array_join(F.slice(first, F.lit(1), depth), "."))


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def has_table(body: Column) -> Column:
    return F.exists(lines(body), lambda line: line.rlike(TABLE_ROW))


def is_mostly_table(body: Column) -> Column:
    """At least three table rows that are over 60 % of the lines with text."""
    text = F.filter(lines(body), lambda line: F.trim(line) != "")
    rows = F.size(F.filter(text, lambda line: line.rlike(TABLE_ROW)))
    return (rows >= 3) & (rows > 0.6 * F.size(text))


def has_tabular_content(body: Column) -> Column:
    """A row of a grid, or a record."""
    return F.exists(lines(body), lambda line: line.rlike(TABLE_ROW) | line.rlike(RECORD_ROW))


def clean_cell(x: Column) -> Column:
    """A table's cell on one line, without ligatures; null is empty."""
    return collapse(expand_ligatures(F.coalesce(x, F.lit(""))))


def content_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by NUL; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


#: Fixed value: the namespace of URLs of name-based UUIDs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_uuid(name: Column) -> Column:
    """Version 5 UUID of a name in the namespace of URLs, from SHA-1 and bit arithmetic on its hex digits."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8"))))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def provenance(title: Column, year: Column) -> Column:
    return F.when(year.isNull(), title).otherwise(F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")")))


def facts(items: Column) -> Column:
    """Map from `attribute: value` strings; split at the first colon, blank sides dropped, the last of equal attributes wins."""
    pairs = F.transform(items, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("v")))
    good = F.filter(F.filter(F.zip_with(items, pairs, lambda s, p: F.when(F.contains(s, F.lit(":")), p)), lambda p: p.isNotNull()), lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(F.transform(good, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(good, p["i"] + 2, F.size(good) + 1), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def facts_phrase(m: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")


def score_window(text: Column, query: Column, chars: int = 512, stop: tuple[str, ...] = ()) -> Column:
    """The stretch of `chars` characters that holds most distinct query words; the earliest of equals; short texts are returned whole.

    Windows slide by a quarter of their length. Query words are folded, of three letters or more, and no stop words.
    """
    step = max(chars // 4, 1)
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(fold(query), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*stop) if stop else F.length(w) >= 3))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - chars + step - 1, F.lit(0)), F.lit(step))
    folded = fold(text)
    tried = F.transform(starts, lambda s: F.struct(F.size(F.filter(words, lambda w: F.contains(F.substr(folded, s + 1, F.lit(chars)), w))).alias("hits"), (-s).alias("back")))
    best = F.array_max(tried)
    return F.when((F.length(text) <= chars) | (F.size(words) == 0), F.substring(text, 1, chars)).otherwise(F.substr(text, -best["back"] + 1, F.lit(chars)))
