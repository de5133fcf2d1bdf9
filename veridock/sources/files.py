"""Readers and writers of chunk files, documents, manifests and stores."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_FIELDS = ("doc_id", "title", "specialty", "organization", "year", "language", "markdown", "reference", "source_pdf")
MANIFEST = "doc_id string, title string, specialty string, topics array<string>, organization string, year int, language string, markdown string, reference string, source_pdf string, extraction map<string,string>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per non-blank line; missing fields are null."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of the *.md files of a folder."""
    own = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return own.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a TOML manifest in order. A missing required field or a repeated doc_id is an error."""
    rows, seen = [], set()
    for d in tomllib.loads(Path(path).read_text(encoding="utf-8")).get("document", []):
        if missing := [f for f in ("doc_id", "title", "specialty", "markdown") if not d.get(f)]:
            raise ValueError(f"manifest: {d.get('doc_id')} lacks {', '.join(missing)}")
        if d["doc_id"] in seen:
            raise ValueError(f"manifest: {d['doc_id']} is there twice")
        seen.add(d["doc_id"])
        rows.append(tuple({"topics": list(d.get("topics", [])), "extraction": {k: str(v) for k, v in d.get("extraction", {}).items()}}.get(k, d.get(k)) for k in [c.split()[0] for c in MANIFEST.replace("map<string,string>", "map").split(", ")]))
    return spark.createDataFrame(rows, MANIFEST)


PROFILE = "specialty string, label string, prompts map<string,string>, abbreviations map<string,string>"


def read_profiles(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One row per *.toml of a folder, in the order of names: the specialty (file name), its label, prompts and abbreviations.

    A profile without abbreviations, or with a required prompt that is missing or blank, is an error.
    """
    rows = []
    for file in sorted(Path(path).glob("*.toml")):
        own = tomllib.loads(file.read_text(encoding="utf-8"))
        prompts, names = own.get("prompts", {}), own.get("abbreviations", {})
        if lacking := [k for k in required if not str(prompts.get(k, "")).strip()] + ["abbreviations"] * (not names):
            raise ValueError(f"{file.name} lacks {', '.join(lacking)}")
        rows.append((file.stem, own.get("label", file.stem), {k: str(v) for k, v in prompts.items()}, names))
    return spark.createDataFrame(rows, PROFILE)


def all_abbreviations(profiles: DataFrame) -> DataFrame:
    """(abbreviation, name) over all profiles; the first specialty by name that has one defines it."""
    each = profiles.select("specialty", F.explode("abbreviations").alias("abbreviation", "name"))
    return each.groupBy("abbreviation").agg(F.min_by("name", "specialty").alias("name"))


def decoded_vectors(encoded: DataFrame, dim: int) -> DataFrame:
    """(row, v) of encoded(matrix, rows): base64 of little-endian float32 matrices, `rows` by `dim`. A matrix of another size is an error."""
    bits = F.hex(F.unbase64("matrix"))
    checked = encoded.select(F.when(F.length(bits) == 8 * dim * F.col("rows"), bits).otherwise(F.raise_error(F.lit("matrix size differs from rows x dim"))).alias("bits"), "rows")
    each = checked.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.substr("bits", r * (8 * dim) + 1, F.lit(8 * dim)))).alias("row", "bits"))
    return each.select("row", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: float32(F.substr("bits", 8 * i + 1, F.lit(8)))).alias("v"))


def float32(bits: Column) -> Column:
    """The finite number whose little-endian bytes the eight hex digits are, by IEEE 754."""
    n = F.conv(F.concat(*[F.substr(bits, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    exponent, fraction = F.shiftright(n, 23).bitwiseAND(F.lit(255)), n.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
    size = F.when(exponent == 0, fraction * 2.0**-149).otherwise((1 + fraction * 2.0**-23) * F.pow(F.lit(2.0), exponent - 127))
    return F.when(n >= 1 << 31, -size).otherwise(size).cast("float")


def pending(asked: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key an append-only output doesn't have yet."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old and new; of equal keys the new one."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
