"""Token counts without ids: a broadcast table of frequent units, a worker cache for the rest."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from causeway.llm.common import ids_and_texts, worker_state
from causeway.llm.token_ids import encoder, portions, strings

_TABLE = "units array<string>, counts array<long>"
_LONGEST = 64  # bytes of a unit in the table


def _table(counts: Counter, most: int) -> pa.RecordBatch:
    best = counts.most_common(most)
    return pa.record_batch(
        [
            pa.array([[u for u, _ in best]], type=pa.list_(pa.string())),
            pa.array([[n for _, n in best]], type=pa.list_(pa.int64())),
        ],
        ["units", "counts"],
    )


def frequent_units(docs: DataFrame, tokenizer: str, most: int = 32_768) -> list[str]:
    """The units that occur most, about, over all texts: at most ``most`` of 64 bytes.

    Every task keeps the ``most`` heaviest of its own and hands on one row; 64 tasks merge
    those, one task their tables, and the driver reads its one. No unit is ever a shuffle key, and what
    moves is bounded by ``most`` for each task. The table changes speed only, never a count.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, counts = encoder(tokenizer), Counter()
        for part in portions(batches):
            units, codes, _ = codec.units(strings(part.column("text")))
            n = np.bincount(codes, minlength=len(units))
            n[pc.greater(pc.binary_length(units), _LONGEST).to_numpy(zero_copy_only=False)] = 0
            top = np.argsort(-n, kind="stable")[:most]
            top = top[n[top] > 1]
            counts.update(dict(zip(units.take(pa.array(top)).to_pylist(), n[top].tolist())))
            if len(counts) > 4 * most:
                counts = Counter(dict(counts.most_common(most)))
        yield _table(counts, most)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for units, n in zip(batch.column("units").to_pylist(), batch.column("counts").to_pylist()):
                counts.update(dict(zip(units, n)))
                if len(counts) > 4 * most:
                    counts = Counter(dict(counts.most_common(most)))
        yield _table(counts, most)

    tables = docs.mapInArrow(own, _TABLE).repartition(64).mapInArrow(merged, _TABLE)
    row = tables.repartition(1).mapInArrow(merged, _TABLE).first()
    counts = Counter(dict(zip(row.units, row.counts))) if row else Counter()
    return [u for u, _ in counts.most_common(most)]


class Lengths:
    """Ids in each unit: the broadcast table first, then what this worker has met.

    The worker keeps two generations of ``kept`` units; the rest of a batch is encoded at
    once.
    """

    def __init__(self, tokenizer: str, units: list[str], lengths: list[int], kept: int = 200_000):
        self.codec = encoder(tokenizer)
        self.table = pa.array(units, type=pa.large_string())
        self.lengths = np.array([*lengths, 0], dtype=np.int64)
        self.kept, self.new, self.old = kept, {}, {}

    def of(self, units: pa.Array) -> np.ndarray:
        at = pc.index_in(units, value_set=self.table)
        missed = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        out = self.lengths[pc.fill_null(at, len(self.lengths) - 1).to_numpy(zero_copy_only=False)]
        if not len(missed):
            return out
        names = units.take(pa.array(missed)).to_pylist()
        new, old = self.new, self.old
        known = [new.get(u) or old.get(u) or 0 for u in names]
        unknown = [i for i, n in enumerate(known) if not n]
        if unknown:
            rest = pa.array([names[i] for i in unknown], type=pa.large_string())
            for i, n in zip(unknown, self.codec.unit_ids(rest)[1].tolist()):
                known[i] = n
        if len(new) > self.kept:
            self.old, self.new = new, {}
        self.new.update((u, n) for u, n in zip(names, known) if n and len(u) <= _LONGEST)
        out[missed] = known
        return out


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 512,
    frequent: int = 32_768,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row, without a shuffle of texts.

    A null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are counted
    row by row; an empty table gives no rows.
    """
    rows = ids_and_texts(docs, id_col, text_col)
    units = frequent_units(rows, tokenizer, frequent)
    lengths = encoder(tokenizer).unit_ids(pa.array(units, type=pa.large_string()))[1].tolist()
    table, key = docs.sparkSession.sparkContext.broadcast((units, lengths)), f"lengths {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        known = state.get(key) or state.setdefault(key, Lengths(tokenizer, *table.value))
        for part in portions(batches):
            texts = strings(part.column("text"))
            distinct, codes, counts = known.codec.units(texts)
            sums = np.concatenate([[0], np.cumsum(known.of(distinct)[codes])])
            ends = np.cumsum(counts)
            n = sums[ends] - sums[ends - counts]
            yield pa.record_batch(
                [part.column("doc_id"), pc.binary_length(texts), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

