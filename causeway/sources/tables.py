"""Reading and writing the tables of the data model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a table too small to fill them.

    A file with one row group is one task however many cores there are. A table that
    yields enough splits of its own is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * _SPLIT_BYTES else df


def table(spark: SparkSession, folder: str, name: str, *keys: str) -> DataFrame:
    """A table of ``folder``, spread by ``keys`` if it is small."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, *keys) if keys else df


_VECTOR_KEY = ["investigation_id", "document_id", "chunk_id"]
_VECTORS = (
    "chunk_id string, document_id string, doc_seq bigint, chunk_index bigint, text string, "
    "embedding array<{}>, version bigint, investigation_id string"
)


def stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The parquet table at ``path``, or None if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_vectors(chunks: DataFrame, path: str, version: int = 0) -> None:
    """Append chunks that have a vector, as one ``version`` of their documents.

    A chunk already stored in this version is not stored again. Whether a key comes twice is asked
    of the keys alone, so texts and vectors move for it only if one does. A corrected upload is
    written with a higher version, which replaces the whole document for readers. Ids count
    within their investigation. Of the store, only the keys of the investigations being
    written are read. Files are laid out by investigation; rebalancing splits the partition
    of a large one into several files and joins those of small ones.
    """
    spark = chunks.sparkSession
    new = (
        chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .select(*_VECTOR_KEY, "doc_seq", "chunk_index", "text", "embedding")
        .withColumn("version", F.lit(version).cast("bigint"))
    )
    if not chunks.groupBy(*_VECTOR_KEY).count().filter("count > 1").isEmpty():
        new = new.dropDuplicates(_VECTOR_KEY)
    before = stored(spark, path, new.schema)
    if before is not None:
        names = [r[0] for r in new.select("investigation_id").distinct().limit(4097).collect()]
        before = before.filter(F.col("version") == version)
        if len(names) <= 4096:  # a filter that picks folders; beyond it all keys are read
            before = before.filter(F.col("investigation_id").isin(names))
        new = new.join(before.select(*_VECTOR_KEY), _VECTOR_KEY, "left_anti")
    new.hint("rebalance", "investigation_id").write.mode("append").partitionBy(
        "investigation_id"
    ).parquet(path)


def read_vectors(spark: SparkSession, path: str, element: str = "double") -> DataFrame:
    """The newest version of each stored document.

    A filter on ``investigation_id`` reads only its folder. Versions are compared on the
    keys alone; texts and vectors are not shuffled for it unless documents have several.
    """
    rows = spark.read.schema(_VECTORS.format(element)).parquet(path)
    document = ["investigation_id", "document_id"]
    versions = rows.groupBy(*document).agg(F.min("version").alias("old"), F.max("version").alias("newest"))
    outdated = versions.filter("old < newest").select(*document, "newest")
    return (
        rows.join(outdated, document, "left")
        .filter(F.col("newest").isNull() | (F.col("version") == F.col("newest")))
        .drop("newest")
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.hint("rebalance", "investigation_id").write.mode("overwrite").partitionBy(
            "investigation_id"
        ).parquet(f"{path}/{name}")


def read_graph(
    spark: SparkSession, path: str, investigation_id: str, schemas
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one investigation, reading only its folder."""
    return tuple(
        spark.read.schema(schema)
        .parquet(f"{path}/{name}")
        .filter(F.col("investigation_id") == investigation_id)
        for name, schema in zip(("nodes", "edges"), schemas)
    )
