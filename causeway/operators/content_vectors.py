"""Embeddings by content: equal and unchanged texts are embedded once over all uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causeway.functions.embedding import Embedder, embed_documents
from causeway.sources import content

_VECTORS = "digest string, embedding array<double>"
_DIGEST = "text_digest"


def embed_by_content(
    chunks: DataFrame,
    embedder: Embedder,
    path: str,
    name: str = "",
    text: str = "text",
    wave: int = 10_000_000,
    per_task: int = 4096,
) -> DataFrame:
    """As ``embed_documents``, with the vectors kept at ``path`` by the digest of their text.

    Only texts that no earlier upload held are given to ``embedder``, each once however
    many chunks hold it. ``name`` tells the embedder: one store may hold the vectors of
    several. A null text has the vector of an empty one. A run that was broken off goes on
    with the texts that its tasks had not yet written.
    """
    key = content.digest(F.lit(name), F.col(text))
    best = F.size("embedding")

    def store() -> DataFrame:
        return content.results(chunks.sparkSession, path, _VECTORS, best)

    content.fill(
        chunks.select(key.alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")),
        store(),
        path,
        lambda rows: embed_documents(rows, embedder).select("digest", "embedding"),
        wave, per_task,
    )
    vectors = store().withColumnRenamed("digest", _DIGEST)
    return chunks.withColumn(_DIGEST, key).join(vectors, _DIGEST, "left").drop(_DIGEST)
