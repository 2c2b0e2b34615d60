"""Confidence expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def path_confidence(length: Column) -> Column:
    return F.round(
        F.least(F.lit(0.5).cast("double") + F.lit(0.05).cast("double") * length,
                F.lit(0.85).cast("double")),
        2,
    )


def root_cause_confidence(path_length: Column, has_ranked_nodes: Column) -> Column:
    """By evidence: a causal path, else only ranked nodes, else nothing."""
    return (
        F.when(path_length > 0, path_confidence(path_length))
        .when(has_ranked_nodes, F.lit(0.35))
        .otherwise(F.lit(0.1))
        .cast("double")
    )


def percent(confidence: Column) -> Column:
    """Whole percent, cut off (0.29 gives 28 in binary floating point)."""
    return (confidence * F.lit(100.0)).cast("int")


def confidence_band(confidence: Column) -> Column:
    pct = F.floor(confidence * F.lit(100.0) + F.lit(0.5))
    return F.when(pct >= 70, "high").when(pct >= 40, "medium").otherwise("low")
