"""Overlapping word windows, for whole texts and for logs of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway import fixed_values as fv
from causeway.functions import text as tx
from causeway.session import materialize

_RUN = 64  # chunks of a document that are cut together


def window_count(words: Column, size: int, step: int) -> Column:
    """Number of windows over ``words`` words; the last one reaches the end."""
    more = F.ceil((words - size) / F.lit(float(step))) + 1
    return F.when(words == 0, 0).when(words <= size, 1).otherwise(more).cast("bigint")


def _settings(size: int | None, overlap: int | None) -> tuple[int, int]:
    size = fv.CHUNK_WORDS if size is None else size
    overlap = fv.CHUNK_OVERLAP if overlap is None else overlap
    return size, max(size - overlap, 1)


def windows(words: Column, size: int | None = None, overlap: int | None = None, start: Column | None = None) -> Column:
    """The chunks, from number ``start`` on, of a text given as its words; null without any.

    They are cut inside one expression, so the word list is not copied once per chunk.
    """
    size, step = _settings(size, overlap)
    start = F.lit(0).cast("bigint") if start is None else start
    n = F.size(words)
    last = window_count(n, size, step) - 1
    numbers = F.when((n > 0) & (start <= last), F.sequence(start, last))
    return F.transform(
        numbers,
        lambda i: F.struct(
            i.alias("chunk_index"),
            (i * step).alias("word_start"),
            F.least(i * step + size, n.cast("bigint")).alias("word_end"),
            F.array_join(
                F.slice(words, (i * step + 1).cast("int"), size), " "
            ).alias("text"),
        ),
    )


def chunk_texts(
    texts: DataFrame, *keys: str, size: int | None = None, overlap: int | None = None
) -> DataFrame:
    """Chunks of every ``text``, without a shuffle."""
    split = texts.select(*keys, tx.tokens(F.col("text")).alias("words"))
    cut = windows(F.col("words"), size, overlap)
    return split.select(*keys, F.explode(cut).alias("c")).select(*keys, "c.*")


def chunk_lines(
    lines: DataFrame,
    *keys: str,
    order: str,
    text: str = "raw",
    size: int | None = None,
    overlap: int | None = None,
    block: int = 65536,
) -> DataFrame:
    """Chunks of documents that come as lines, of any length.

    No document is ever gathered in one place. ``order`` is a non-negative number that
    orders the lines of a document: a line number, or one with gaps, as long as ``block``
    successive values hold many lines (a time stamp needs a larger ``block``). Word positions are a prefix sum in two levels: per
    block of ``block`` order values, then over the few block totals. Each line then
    sends its words to the runs of windows that hold them, so the largest group is one run
    of ``_RUN`` chunks, which are cut from its words without a row for each line and chunk.
    The words of the lines are written once, as both levels read them.
    """
    size, step = _settings(size, overlap)
    keys = list(keys)
    counted = materialize(
        lines.select(
            *keys,
            F.col(order).alias("line_order"),
            F.floor(F.col(order) / block).alias("block"),
            tx.spaced(F.col(text)).alias("said"),
        ).withColumn("n", tx.spaced_words(F.col("said")))
    )

    per_document = Window.partitionBy(*keys)
    before = per_document.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        counted.groupBy(*keys, "block")
        .agg(F.sum("n").alias("block_words"))
        .select(
            *keys,
            "block",
            F.coalesce(F.sum("block_words").over(before), F.lit(0)).alias("block_start"),
            F.sum("block_words").over(per_document).alias("total"),
        )
    )

    in_block = Window.partitionBy(*keys, "block").orderBy("line_order")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        counted.withColumn("in_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(blocks, [*keys, "block"])
        .filter(F.col("n") > 0)
        .select(
            *keys, "said", "n", "total", (F.col("block_start") + F.col("in_block")).alias("at")
        )
    )

    run = _RUN * step  # words from the start of a run to that of the next
    reach = (_RUN - 1) * step + size  # words of a run, with those that its last window shares
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("at") - reach) / F.lit(float(run))) + 1)
    last = F.least(
        F.floor((window_count(F.col("total"), size, step) - 1) / F.lit(float(_RUN))),
        F.floor((F.col("at") + F.col("n") - 1) / F.lit(float(run))),
    )

    start = F.greatest(F.col("run") * run - F.col("at"), F.lit(0).cast("bigint"))
    stop = F.least(F.col("run") * run + reach - F.col("at"), F.col("n"))
    cut = F.slice(F.split("said", " "), (start + 1).cast("int"), (stop - start).cast("int"))
    whole = (start == 0) & (stop == F.col("n"))
    pieces = placed.withColumn("run", F.explode(F.sequence(first, last))).select(
        *keys,
        "run",
        "total",
        (F.col("at") + start).alias("at"),
        F.when(whole, F.col("said")).otherwise(F.array_join(cut, " ")).alias("said"),
    )
    joined = F.array_sort(F.collect_list(F.struct("at", "said")))
    runs = pieces.groupBy(*keys, "run").agg(
        F.split(F.array_join(F.transform(joined, lambda p: p["said"]), " "), " ").alias("words"),
        F.max("total").alias("total"),
    )

    def window(i: Column) -> Column:
        at = (i - F.col("run") * _RUN) * step
        return F.struct(
            i.alias("chunk_index"),
            (i * step).alias("word_start"),
            F.least(i * step + size, F.col("total")).alias("word_end"),
            F.array_join(F.slice("words", (at + 1).cast("int"), size), " ").alias("text"),
        )

    windows = F.sequence(
        F.col("run") * _RUN,
        F.least(F.col("run") * _RUN + (_RUN - 1), window_count(F.col("total"), size, step) - 1),
    )
    return runs.select(*keys, F.explode(F.transform(windows, window)).alias("c")).select(*keys, "c.*")


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """The same chunk gets the same id on every run."""
    return chunks.withColumn(
        "chunk_id", F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"))
    )
