"""Times of events as timestamps: a time of day takes the date of the last dated row before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway.functions import text as tx

_DATE = r"\d{4}-\d{2}-\d{2}(?=[T ]\d{2}:\d{2}:\d{2})"


def _parsed(day: Column, clock: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm:ss"))


def event_times(
    rows: DataFrame, keys: list[str], order: str, text: str = "text", keep: tuple[str, ...] = (), block: int = 4096
) -> DataFrame:
    """``keys``, ``order``, ``keep``, the leftmost ``timestamp`` of each row as text, and its ``event_ts``.

    Rows are the lines or chunks of the documents that ``keys`` name, numbered by ``order``
    (a whole number, each once in its document). A time without a date is of the day last
    named in an earlier row, whatever the hour; without one, or where the text is no time,
    ``event_ts`` is null. A null text has no time.

    The date is carried in two levels: within blocks of ``block`` numbers, and over the last
    dates of the blocks, so no document is gathered. Texts are not moved.
    """
    time = tx.event_timestamp(F.col(text))
    found = rows.select(
        *keys, F.col(order), *keep, F.floor(F.col(order) / block).alias("_block"), time.alias("timestamp"),
        F.regexp_extract_all(F.col(text), F.lit(_DATE), F.lit(0)).alias("_days"),
    )
    valid = F.filter("_days", lambda d: _parsed(d, F.lit("00:00:00")).isNotNull())
    found = found.withColumn("_day", F.try_element_at(valid, F.lit(-1))).drop("_days")

    earlier = lambda *names: Window.partitionBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        found.groupBy(*keys, "_block")
        .agg(F.max_by("_day", F.when(F.col("_day").isNotNull(), F.col(order))).alias("_last"))
        .withColumn("_before", F.last("_last", ignorenulls=True).over(earlier(*keys).orderBy("_block")))
        .select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_before")
    )
    within = F.last("_day", ignorenulls=True).over(earlier(*keys, "_block").orderBy(order))
    same = F.col("_block") == F.col("_b")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_{i}"))
    dated = F.length("timestamp") > 8
    own = _parsed(F.substring("timestamp", 1, 10), F.substring("timestamp", 12, 8))
    carried = _parsed(F.coalesce("_within", "_before"), F.col("timestamp"))
    return (
        found.withColumn("_within", within)
        .join(blocks, same, "left")
        .select(*keys, order, *keep, "timestamp", F.when(dated, own).otherwise(carried).alias("event_ts"))
    )


def chunk_times(chunks: DataFrame) -> DataFrame:
    """``event_ts`` of each chunk, for ``timelines``."""
    return event_times(
        chunks, ["investigation_id", "document_id"], "chunk_index", keep=("chunk_id",)
    ).select("investigation_id", "chunk_id", "event_ts")
