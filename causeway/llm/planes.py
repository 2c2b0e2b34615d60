"""Token ids in files of bit or byte planes: blocks of ids are transposed, planes compressed."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts, ordered_buckets, partitions
from causeway.llm.token_ids import encoder, portions, strings
from causeway.session import shared_folder

CHUNK = (
    "shard int, chunk int, first long, n_ids long, block_ids int, planes string, doc_ids array<long>, "
    "doc_tokens array<long>, index array<int>, payload binary"
)
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of a block of ids, lowest first."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        octets = np.stack([np.frombuffer(p, dtype=np.uint8) for p in parts], axis=1)
    else:
        rows = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in parts]
        octets = np.packbits(np.stack(rows, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def write_chunk(ids: np.ndarray, block_ids: int, planes: str, level: int = 3) -> tuple[bytes, list[int]]:
    """The compressed planes of all blocks, and the index: where each plane of each block ends."""
    compressor, parts, index, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for begin in range(0, len(ids), block_ids):
        for plane in to_planes(ids[begin : begin + block_ids], planes):
            parts.append(compressor.compress(plane))
            at += len(parts[-1])
            index.append(at)
    return b"".join(parts), index


def read_blocks(
    payload: bytes, index: list[int], n_ids: int, block_ids: int, planes: str, first: int = 0, last: int | None = None
) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (exclusive; all by default), and of no others."""
    count = 4 if planes == "byte" else 32
    last = -(-n_ids // block_ids) if last is None else last
    decompressor, out = zstandard.ZstdDecompressor(), [np.zeros(0, dtype="<u4")]
    for block in range(first, last):
        n = min(block_ids, n_ids - block * block_ids)
        ends = index[block * count : (block + 1) * count]
        begins = [index[block * count - 1] if block else 0, *ends[:-1]]
        out.append(from_planes([decompressor.decompress(payload[a:b]) for a, b in zip(begins, ends)], n, planes))
    return np.concatenate(out)


def chunks(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    block_ids: int = 16_384,
    chunk_ids: int = 1 << 18,
    planes: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The chunks of a file set, in ascending ``doc_id``; ties follow the text.

    Texts are shuffled once, into ranges of ids. A chunk is a run of whole documents, closed
    at ``chunk_ids`` ids; its last block may be short. A null or empty text is a document of
    the end id alone; null ids come first; repeated rows are documents each.
    """
    ranged, n = ordered_buckets(ids_and_texts(docs, id_col, text_col), "doc_id", partitions(docs))
    ordered = ranged.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        shard, chunk, first = None, 0, 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        doc_tokens: list[int] = []
        gathered = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, first, gathered
            if not doc_ids:
                return
            ids = np.concatenate(held)
            payload, index = write_chunk(ids, block_ids, planes)
            row = (shard, chunk, first, len(ids), block_ids, planes, list(doc_ids), list(doc_tokens), index, payload)
            chunk, first, gathered = chunk + 1, first + len(ids), 0
            for each in (held, doc_ids, doc_tokens):
                each.clear()
            yield _row(row)

        for part in portions(batches):
            ids, bounds = codec.encode(strings(part.column("text")))
            buckets = part.column("bucket").to_pylist()
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                if buckets[i] != shard:
                    yield from close()
                    shard, chunk, first = buckets[i], 0, 0
                held.append(np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)))
                doc_ids.append(doc)
                doc_tokens.append(len(held[-1]))
                gathered += len(held[-1])
                if gathered >= chunk_ids:
                    yield from close()
        yield from close()

    return ordered.mapInArrow(run, CHUNK)


def _row(row: tuple) -> pa.RecordBatch:
    kinds = [
        pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()),
        pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(),
    ]
    names = [part.split()[0] for part in CHUNK.split(", ")]
    return pa.record_batch([pa.array([v], type=k) for v, k in zip(row, kinds)], names)


def write_planes(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> str:
    """Write the files; returns their folder, by default a new one in the shared folder."""
    path = path or f"{shared_folder(docs.sparkSession).rstrip('/')}/planes-{uuid.uuid4().hex}"
    chunks(docs, tokenizer, **options).write.option("compression", "none").parquet(path)
    return path


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: its place in the whole order, length, checksum.

    The driver gathers one number for each shard, the ids in it; documents are read in
    parallel, chunk by chunk.
    """
    stored = spark.read.schema(CHUNK).parquet(path)
    totals = {r.shard: r.n for r in stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard], at = at, at + totals[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                ids = read_blocks(row["payload"], row["index"], row["n_ids"], row["block_ids"], row["planes"])
                sizes = np.array(row["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[e - n : e]) for n, e in zip(sizes, ends)]
                starts = ends - sizes + base[row["shard"]] + row["first"]
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], type=pa.int64()), pa.array(starts), pa.array(sizes), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return stored.mapInArrow(run, READ)
