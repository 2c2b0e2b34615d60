"""File scans: registry, whole texts, log lines and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from causeway import fixed_values as fv
from causeway.functions import text as tx

_LINE_END = r"\r\n|\r|\n"
_NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def file_registry(spark: SparkSession, path: str, investigation_id: Column) -> DataFrame:
    """One row per file, from metadata only: the contents are not read here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return register(
        files.select(
            F.col("path").alias("stored_path"),
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("uploaded_at"),
            investigation_id.alias("investigation_id"),
        )
    )


def register(files: DataFrame, max_bytes: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """Add the document type and, for files above the cap, why they are rejected.

    Every file keeps its row; one oversize file does not hold up the others.
    """
    return files.withColumns(
        {
            "doc_type": tx.document_type(F.col("filename")),
            "rejected": F.when(F.col("size_bytes") > max_bytes, "exceeds the size cap"),
        }
    )


def accepted(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("rejected").isNull())


def rejected(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("rejected").isNotNull())


def whole_texts(spark: SparkSession, path: str, max_bytes: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """``(stored_path, text, rejected)`` of every file.

    A PDF (whose text comes from its pages) and a file beyond the cap have a null text and
    the reason; the filters reach the scan, so neither is ever opened. Bytes that are not
    UTF-8 are dropped and line ends become ``\\n``. Logs beyond the cap can be read by
    ``text_lines``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    paged = F.lower("path").endswith(".pdf")
    readable = (F.col("length") <= max_bytes) & ~paged
    raw = files.filter(readable)
    left_out = files.filter(~readable).select(
        F.col("path").alias("stored_path"),
        F.lit(None).cast("string").alias("text"),
        F.when(paged, "paged").otherwise("exceeds the size cap").alias("rejected"),
    )
    body = F.col("content").cast("string")
    clean = F.when(F.is_valid_utf8(body), body).otherwise(
        F.replace(F.make_valid_utf8(body), F.lit("�"), F.lit(""))
    )
    return raw.select(
        F.col("path").alias("stored_path"),
        F.regexp_replace(clean, r"\r\n?", "\n").alias("text"),
        F.lit(None).cast("string").alias("rejected"),
    ).unionByName(left_out)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(stored_path, line_number, raw)`` of text files of any size.

    A large file is read by many tasks. A line's number is its place in its split after
    the lines of the file's earlier splits, whose counts are one row for each split.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("stored_path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("value").alias("raw"),
        )
        .withColumn("at", F.monotonically_increasing_id())
    )
    earlier = Window.partitionBy("stored_path").orderBy("split")
    splits = (
        lines.groupBy("stored_path", "split")
        .agg(F.count("*").alias("n"), F.min("at").alias("first"))
        .withColumn("before", F.sum("n").over(earlier) - F.col("n"))
    )
    return lines.join(splits, ["stored_path", "split"]).select(
        "stored_path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_number"), "raw"
    )


def line_fields(lines: DataFrame, *keys: str, syslog_first: bool = False) -> DataFrame:
    """Lines of ``text_lines`` that are not blank, with their time and level."""
    return lines.filter(F.col("raw").rlike(_NOT_BLANK)).select(
        *keys,
        "line_number",
        "raw",
        tx.line_timestamp(F.col("raw"), syslog_first).alias("timestamp"),
        tx.log_level(F.col("raw")).alias("level"),
    )


def log_lines(texts: DataFrame, *keys: str, syslog_first: bool = False) -> DataFrame:
    """Lines of each ``text`` with their physical number, time and level.

    Blank lines are left out but counted.
    """
    lines = texts.select(
        *keys, F.posexplode(F.split("text", _LINE_END)).alias("pos", "raw")
    ).filter(F.col("raw").rlike(_NOT_BLANK))
    return lines.select(
        *keys,
        (F.col("pos") + 1).alias("line_number"),
        "raw",
        tx.line_timestamp(F.col("raw"), syslog_first).alias("timestamp"),
        tx.log_level(F.col("raw")).alias("level"),
    )


def log_text(text: Column) -> Column:
    """Text of a log without its blank lines, one ``\\n`` between lines."""
    lines = F.filter(F.split(text, _LINE_END), lambda line: line.rlike(_NOT_BLANK))
    return F.array_join(lines, "\n")


def page_texts(pages: DataFrame, *keys: str) -> DataFrame:
    """Text of paged documents: non-blank pages in order, under their own number.

    A group is one document, whose size the registry has capped.
    """
    body = tx.strip(F.col("text"))
    part = F.concat(F.lit("[page "), F.col("page_no").cast("string"), F.lit("]\n"), body)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "part")))
    return (
        pages.filter(F.col("text").rlike(_NOT_BLANK))
        .select(*keys, "page_no", part.alias("part"))
        .groupBy(*keys)
        .agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n").alias("text"))
    )


def load_texts(documents: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """Text of every document: PDF from its pages, LOG by lines, else as is.

    A document that has a reason in ``rejected`` has no text here.
    """
    if "rejected" in documents.columns:
        documents = accepted(documents)
    is_pdf = F.lower("filename").endswith(".pdf")
    paged = page_texts(
        pages.join(documents.filter(is_pdf).select(*keys), list(keys), "left_semi"), *keys
    )
    plain = documents.filter(~is_pdf).select(
        *keys,
        F.when(F.col("doc_type") == "LOG", log_text(F.col("text")))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    return paged.unionByName(plain)
