"""Prompts and texts to be made are dealt to tasks in equal shares."""

from pyspark.sql import functions as F

from causeway.sources import content


def test_tasks_of_a_wave_hold_equal_shares(spark):
    rows = spark.range(5000).select(content.digest(F.col("id").cast("string")).alias("digest"), F.lit("x").alias("prompt"))
    few = rows.limit(40)
    for part, n, tasks in ((rows, 5000, 70), (few, 40, 40), (few, 40, 7), (few.limit(0), 0, 1)):
        dealt = content._dealt(part, n, tasks)
        assert dealt.columns == ["digest", "prompt"] and dealt.distinct().count() == dealt.count() == n
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert not sizes or max(sizes) - min(sizes) <= 1 and len(sizes) == tasks
