"""Stores of chunks, points and graphs, and what writes them: keyed upserts, appends that can be resumed, extracted documents, reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.functions.text import stable_uuid
from veridock.operators.lineage import cut
from veridock.sources.files import pending


class Generation(NamedTuple):
    """Names of all that derives from one generation of a corpus, under one root."""

    key: str
    root: str

    @property
    def chunks(self) -> str:
        return f"{self.root}/{self.key}/chunks"

    @property
    def points(self) -> str:
        return f"{self.root}/{self.key}/points"

    @property
    def graph(self) -> str:
        return f"{self.root}/{self.key}/graph"


#: Generations whose chunks say what specialty they belong to.
SCOPABLE = ("v2",)


def configured(spark: SparkSession, root: str, default: str = "v1") -> tuple[Generation, str | None]:
    """(generation, specialty) from the session's settings veridock.corpus.version and veridock.specialty; the latter only where the generation can be scoped."""
    key = spark.conf.get("veridock.corpus.version", default)
    return Generation(key, root), (spark.conf.get("veridock.specialty", "") or None) if key in SCOPABLE else None


def document_for(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(file_name) with their rows of the manifest, by the last part of its path; a file that isn't listed is an error when it is read."""
    known = manifest.withColumn("file_name", F.substring_index("markdown", "/", -1)).withColumnRenamed("markdown", "markdown_path")
    both = files.join(known, "file_name", "left")
    return both.withColumn("doc_id", F.when(F.col("doc_id").isNull(), F.raise_error(F.concat(F.lit("not in the manifest: "), F.col("file_name")))).otherwise(F.col("doc_id")))


def paired_sources(markdown: DataFrame, manifest: DataFrame, references: DataFrame) -> DataFrame:
    """(name, markdown, reference) of markdown(file_name, text) with the reference text of its row of the manifest; without row or file it is null."""
    last = lambda c: F.substring_index(c, "/", -1)
    known = manifest.select(last("markdown").alias("name"), last("reference").alias("_r"))
    texts = references.select(F.col("file_name").alias("_r"), F.col("text").alias("reference"))
    own = markdown.select(F.col("file_name").alias("name"), F.col("text").alias("markdown"))
    return own.join(known, "name", "left").join(texts, "_r", "left").select("name", "markdown", "reference")


def enriched_chunks(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """chunks with `context` from contexts(chunk_id, context) before their retrieval form; chunks without stay as they are."""
    told = F.coalesce("context", F.lit(""))
    form = F.when(told == "", F.col("text_for_retrieval")).otherwise(F.concat(told, F.lit("\n\n"), F.col("text_for_retrieval")))
    return chunks.join(contexts.select("chunk_id", "context"), "chunk_id", "left").withColumns({"context": told, "text_for_retrieval": form})


def points(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, dense, indexed, payload): the rows of an index. embed gives the vector of the indexed text; the payload has all columns of a chunk."""
    own = chunks.withColumn("_t", F.coalesce(F.nullif("text_for_retrieval", F.lit("")), F.col("text")))
    return own.select(stable_uuid(F.col("chunk_id")).alias("id"), embed(F.col("_t")).alias("dense"), F.col("_t").alias("indexed"), F.struct(*chunks.columns).alias("payload"))


def batched(rows: DataFrame, key: str, size: int = 96) -> DataFrame:
    """rows with `batch`: about `size` rows each, dealt by a hash of the key, so that a repeated run makes the same batches."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)))


def upsert_points(spark: SparkSession, path: str, new: DataFrame, key: str = "id", recreate: bool = False) -> None:
    """Writes rows by key: what is stored under a key of `new` is replaced, and running it twice changes nothing. The old rows are read to the shared
    folder before they are overwritten."""
    own = new.dropDuplicates([key])
    if not recreate and _exists(spark, path):
        old = spark.read.parquet(path)
        own = cut(old.join(own.select(key), key, "left_anti").unionByName(own))
    own.write.mode("overwrite").parquet(path)


def append_pending(spark: SparkSession, path: str, asked: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], schema: str) -> int:
    """Appends work's rows for the keys that the output doesn't have yet, and tells how many were asked for. What a broken run has appended stays."""
    done = spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    left = cut(pending(asked, done, key))
    n = left.count()
    if n:
        work(left).write.mode("append").json(path)
    return n


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, settings: dict) -> None:
    """A graph's tables and a manifest with their counts and the settings they were built with."""
    counts = {}
    for name, rows in (("nodes", nodes), ("edges", edges), ("vectors", vectors)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = nodes.sparkSession.read.parquet(f"{path}/{name}").count()
    told = [(json.dumps(settings, sort_keys=True), *(counts[n] for n in ("nodes", "edges", "vectors")))]
    nodes.sparkSession.createDataFrame(told, "settings string, nodes long, edges long, vectors long").write.mode("overwrite").parquet(f"{path}/manifest")


def read_graph(spark: SparkSession, path: str, dim: int) -> dict[str, DataFrame]:
    """The tables of write_graph; an error if the settings name another dimension than `dim`."""
    said = spark.read.parquet(f"{path}/manifest").first()
    if (found := json.loads(said["settings"]).get("dim")) != dim:
        raise ValueError(f"the graph was built with vectors of {found} numbers, not {dim}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "vectors")}


def write_extracted(documents: DataFrame, path: str) -> DataFrame:
    """Writes documents(doc_id, status, markdown, reference) that are fit, a folder per document and part; gives the others with what is wrong with them."""
    fit = documents.where("status = 'native_ok' AND length(trim(markdown)) > 0")
    for part in ("markdown", "reference"):
        fit.select("doc_id", F.col(part).alias("value")).where("value IS NOT NULL").write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(f"{path}/{part}")
    return documents.join(fit.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.when(F.col("status") == "native_ok", "empty").otherwise(F.col("status")).alias("why"))


def write_report(records: DataFrame, path: str) -> None:
    """Evaluation records as CSV with a header."""
    records.write.mode("overwrite").option("header", True).csv(path)


def embedding_cost(chunks: DataFrame, price: float, dry_run: bool = True) -> DataFrame:
    """(chunks, tokens, cost): what embedding would cost at `price` a million tokens, and, unless dry, nothing else changes."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), (F.coalesce(F.sum("n_tokens"), F.lit(0)) * price / 1_000_000).alias("cost"))


def probe(chunks: DataFrame, around: Callable[[DataFrame], DataFrame], source: str | None = None, limit: int | None = None) -> DataFrame:
    """around(chunks) (neighbours of the whole document), then only those whose source contains a string, then the first `limit` by id."""
    own = around(chunks)
    own = own if not source else own.where(F.contains("source_file", F.lit(source)))
    return own if limit is None else own.orderBy("source_file", "chunk_index").limit(limit)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
