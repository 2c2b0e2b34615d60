"""Inference that outlives lost executors: answers are logged by the digest of their prompt."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from causeway.operators.prompts import Model, infer
from causeway.sources import content

_ANSWERS = "digest string, response string, error string"
_DIGEST = "prompt_digest"


def infer_logged(
    prompts: DataFrame,
    load: Model | None,
    path: str,
    tries: int = 3,
    wait: Callable[[float], None] = time.sleep,
    system: str | None = None,
    name: str = "",
    wave: int = 1_000_000,
    per_task: int = 64,
) -> DataFrame:
    """As ``infer``, but a prompt answered before, in this run or an earlier one, is not asked again.

    The log at ``path`` is keyed by the prompt, the ``system`` instruction and the ``name``
    of the model, so several stages and models may share it. Equal prompts are asked once.
    A prompt that failed for good is asked again by the next run; its error stands until it
    is answered. Answers are logged by tasks of ``per_task`` prompts, in waves of ``wave``:
    a run that was broken off goes on where its tasks had come to. Only prompts that a lost
    task had in hand can be asked twice. A null prompt is not asked: its response is empty.
    Prompts are in no order afterwards; an empty table asks nothing.
    """
    if load is None:
        return infer(prompts, None)
    key = content.digest(F.lit(name), F.lit(system or ""), F.col("prompt"))
    asked = prompts.filter(F.col("prompt").isNotNull())
    answered = F.struct(F.col("error").isNull(), "response", "error")

    def log() -> DataFrame:
        return content.results(prompts.sparkSession, path, _ANSWERS, answered)

    content.fill(
        asked.select(key.alias("digest"), "prompt"),
        log().filter(F.col("error").isNull()),
        path,
        lambda rows: infer(rows, load, tries, wait, system).select("digest", "response", "error"),
        wave, per_task,
    )
    answers = log().withColumnRenamed("digest", _DIGEST)
    found = asked.withColumn(_DIGEST, key).join(answers, _DIGEST, "left").select(
        *prompts.columns, "response", "error"
    )
    unasked = prompts.filter(F.col("prompt").isNull()).select(
        "*", F.lit("").alias("response"), F.lit(None).cast("string").alias("error")
    )
    return found.unionByName(unasked)
