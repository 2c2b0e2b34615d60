"""Tables of results keyed by what they were made from, which outlive the run that made them.

A store is a folder of Parquet files to which tasks add, each on its own: what a task has
written stays, even if the job breaks off afterwards. So a result may stand there more than
once, and readers take one row for each digest.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from causeway.session import shared_folder
from causeway.sources.tables import stored


def digest(*parts: Column) -> Column:
    """SHA-256 of texts; their lengths keep apart what differs only in where a text ends."""
    texts = [F.coalesce(p, F.lit("")) for p in parts]
    return F.sha2(F.concat(*[c for t in texts for c in (F.length(t).cast("string"), F.lit(":"), t)]), 256)


def results(spark: SparkSession, path: str, schema: str, better: Column) -> DataFrame:
    """One row for each digest, the one for which ``better`` is largest."""
    rows = stored(spark, path, schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    fields = [f for f in rows.columns if f != "digest"]
    best = F.max_by(F.struct(*fields), better)
    return rows.groupBy("digest").agg(best.alias("best")).select("digest", "best.*")


def _share() -> Column:
    """The first 28 bits of a digest. Digests are uniform, so these deal rows about evenly."""
    return F.conv(F.substring("digest", 1, 7), 16, 10).cast("bigint")


def _dealt(rows: DataFrame, n: int, tasks: int) -> DataFrame:
    """About ``n`` rows in tasks whose sizes differ by one at most, so that a lost task costs no more than its share.

    Rows are numbered in order of their digests, in cells of about 1,024 after the rows of the cells before.
    """
    cells = max(1, n // 1024)
    celled = rows.withColumn("cell", F.floor(_share() * cells / F.lit(float(1 << 28))))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy("cell").agg(F.count("*").alias("rows")).select(
        "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    at = F.row_number().over(Window.partitionBy("cell").orderBy("digest")) - 1
    numbered = celled.withColumn("at", at).join(starts, "cell")
    task = ((F.col("start") + F.col("at")) % tasks).cast("int")
    return numbered.withColumn("task", task).repartitionById(tasks, "task").select(*rows.columns)


def fill(
    wanted: DataFrame,
    known: DataFrame,
    path: str,
    make: Callable[[DataFrame], DataFrame],
    wave: int,
    per_task: int,
) -> None:
    """Add to the store what is ``wanted(digest, ...)`` and not yet ``known(digest)``.

    Each digest is made once. The rows to make are written down first, dealt by their
    digest into waves of about ``wave`` rows and tasks of about ``per_task``; a wave is one
    job. Tasks of a wave commit their files themselves, so a lost executor costs what its
    tasks had in hand, and a broken run what its last tasks had.
    """
    spark = wanted.sparkSession
    wanted = wanted.join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    planned = f"{shared_folder(spark).rstrip('/')}/wanted-{uuid.uuid4().hex}"
    wanted.write.parquet(planned)
    rows = spark.read.schema(wanted.schema).parquet(planned)
    n = rows.count()
    waves = math.ceil(n / wave)
    for number in range(waves):
        part = rows.filter(F.pmod(_share(), F.lit(waves)) == number) if waves > 1 else rows
        tasks = max(1, math.ceil(n / waves / per_task))
        made = make(_dealt(part, n // waves, tasks))
        made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
