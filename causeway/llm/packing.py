"""Sum-of-squares online packing of documents into windows of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from causeway.llm.common import ids_and_texts
from causeway.llm.token_ids import encoder, portions, strings

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_TASK_SPAN = 1 << 40  # sequence numbers of a task
HELD = 64 << 20  # bytes that open windows hold, at most
_PIECE = 256  # bytes of a piece besides its ids, about


class Packer:
    """Places pieces online; ``out`` gathers the rows of those whose place is final.

    A window's level is its fill in steps of ``capacity / levels`` tokens, rounded up, and
    ``counts`` holds the number of open windows at each level. A document goes where the sum
    of the squared counts becomes least, a new window included; of equals, into the fullest.
    A window with less than one step left is closed and its gap remembered. ``finish`` fills
    the gaps with cuts of the documents in the emptiest open windows, and cuts what remains
    into sequences whose lengths are powers of two, which need no padding. The same is done
    with all open windows whenever they hold more than ``held_bytes``, as where no two of
    very many documents fit together.
    """

    def __init__(self, capacity: int = 2048, levels: int = 64, first: int = 0, held_bytes: int = HELD):
        self.capacity, self.levels, self.held_bytes = capacity, levels, held_bytes
        self.step = -(-capacity // levels)
        self.counts = np.zeros(levels + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(levels + 1)]
        self.gaps: list[tuple[int, int]] = []  # (sequence, fill) of closed windows
        self.next, self.out = first, []
        self.held = 0  # bytes in open windows

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        self.out.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        """All ids of one document; whole windows' worth of them are sequences of their own."""
        total, most = len(ids), self.capacity
        whole = total - total % most
        for at in range(0, whole, most):
            self._emit((doc, at, ids[at : at + most], total), self._number(), 0)
        if whole < total:
            self._place((doc, whole, ids[whole:].copy(), total))

    def _place(self, piece: tuple) -> None:
        size, counts = len(piece[2]), self.counts
        fits = (self.capacity - size) // self.step  # the fullest level that surely has room
        steps = -(-size // self.step)
        here = np.arange(fits + 1)
        there = np.minimum(here + steps, self.levels)
        change = np.where(there < self.levels, 2 * counts[there] + 1, 0) - 2 * counts[: fits + 1] + 1
        change[0] += 2 * counts[0] - 1  # a new window leaves no level
        usable = counts[: fits + 1] > 0
        usable[0] = True
        best = int(fits - np.argmin(np.where(usable, change, np.iinfo(np.int64).max)[::-1]))
        window = self.open[best].pop() if best else [0, []]
        counts[best] -= best > 0
        window[0] += size
        window[1].append(piece)
        self.held += piece[2].nbytes + _PIECE
        if self.capacity - window[0] < self.step:
            sequence = self._write(window)
            self.held -= sum(p[2].nbytes + _PIECE for p in window[1])
            if window[0] < self.capacity:
                self.gaps.append((sequence, window[0]))
        else:
            level = -(-window[0] // self.step)
            self.open[level].append(window)
            counts[level] += 1
            if self.held > self.held_bytes:
                self.finish()

    def _write(self, window: list) -> int:
        sequence, offset = self._number(), 0
        for piece in window[1]:
            self._emit(piece, sequence, offset)
            offset += len(piece[2])
        return sequence

    def finish(self) -> None:
        windows = [w for level in self.open for w in level]  # emptiest first
        room = sum(self.capacity - fill for _, fill in self.gaps) + sum(self.capacity - w[0] for w in windows)
        cut = 0  # the windows whose documents are cut to fill the others
        spare = 0
        while cut < len(windows) and spare < room:
            spare += windows[cut][0]
            room -= self.capacity - windows[cut][0]
            cut += 1
        for window in windows[cut:]:
            self.gaps.append((self._write(window), window[0]))
        pieces = [p for w in windows[:cut] for p in w[1]]
        places = [(s, fill, self.capacity - fill) for s, fill in self.gaps]
        left = spare - sum(n for _, _, n in places)
        while left > 0:
            n = min(self.capacity, 1 << (left.bit_length() - 1))
            places.append((self._number(), 0, n))
            left -= n
        at = iter(places)
        sequence, offset, free = next(at, (0, 0, 0))
        for doc, start, ids, total in pieces:
            done = 0
            while done < len(ids):
                n = min(free, len(ids) - done)
                if n:
                    self._emit((doc, start + done, ids[done : done + n], total), sequence, offset)
                done, offset, free = done + n, offset + n, free - n
                if not free:
                    sequence, offset, free = next(at, (0, 0, 0))
        self.open, self.gaps, self.held = [[] for _ in range(self.levels + 1)], [], 0
        self.counts[:] = 0

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    levels: int = 64,
    held_bytes: int = HELD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``capacity`` tokens.

    Every task packs the rows of its partition in one pass as they come, without a shuffle;
    it holds its open windows, at most ``held_bytes`` of them: beyond that all open windows are
    finished, the emptiest cut to fill the others, which loses nothing and pads no more, as what
    remains falls into sequences without padding. Sequence numbers are unique over all tasks. ``capacity`` must be a power of two.

    A null or empty text is a document of the end id alone. Null ids and repeated rows are
    packed like any others, row by row. An empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codec = None, encoder(tokenizer)
        packer = Packer(capacity, levels, TaskContext.get().partitionId() * _TASK_SPAN, held_bytes)
        for part in portions(batches):
            ids, bounds = codec.encode(strings(part.column("text")))
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                packer.add(doc, own)
            yield _batch(packer.rows())
        packer.finish()
        yield _batch(packer.rows())

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, type=pa.int64()) for c in columns], names)
