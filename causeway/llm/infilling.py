"""Fill-in-the-middle documents, cut at unit boundaries that a compressed set selects by rank."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPAN = 1 << 16  # values of a container
_WORDS = np.arange(64, dtype=np.uint64)


class BoundarySet:
    """Ascending offsets in containers of 65,536 consecutive values each.

    A container keeps the low 16 bits of its offsets in the smallest of three forms: a sorted
    array (2 bytes an offset), a bitmap (8 KB, with the running number of set bits before each
    word) or runs (4 bytes each: first value, and the number of offsets before it). Containers
    are found by their cumulative cardinalities.
    """

    def __init__(self):
        self.bases: list[int] = []
        self.kinds: list[str] = []
        self.parts: list[tuple] = []
        self.ends: list[int] = []

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, base: int, low: np.ndarray) -> None:
        """A container of the ascending values ``low`` (below 65,536) beyond ``base``."""
        n = len(low)
        if not n:
            return
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 4 * len(first) < min(2 * n, _SPAN // 8):
            kind, part = "run", (low[first].astype(np.uint16), first.astype(np.uint16))
        elif 2 * n <= _SPAN // 8:
            kind, part = "array", (low.astype(np.uint16),)
        else:
            bits = np.zeros(_SPAN, dtype=np.uint8)
            bits[low] = 1
            words = np.packbits(bits, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            kind, part = "bitmap", (words, np.cumsum(counts) - counts)
        self.bases.append(base)
        self.kinds.append(kind)
        self.parts.append(part)
        self.ends.append(len(self) + n)

    def select(self, rank: int) -> int:
        """The offset with ``rank`` smaller ones; ``rank`` is below the set's length."""
        at = bisect_right(self.ends, rank)
        rank -= self.ends[at - 1] if at else 0
        part = self.parts[at]
        if self.kinds[at] == "array":
            low = int(part[0][rank])
        elif self.kinds[at] == "run":
            run = int(np.searchsorted(part[1], rank, side="right")) - 1
            low = int(part[0][run]) + rank - int(part[1][run])
        else:
            word = int(np.searchsorted(part[1], rank, side="right")) - 1
            held = np.flatnonzero((part[0][word] >> _WORDS) & np.uint64(1))
            low = 64 * word + int(held[rank - int(part[1][word])])
        return self.bases[at] + low


def unit_ends(text: str) -> BoundarySet:
    """Where the units of ``text`` end, in code points: a run of A-Z and a-z is one unit, any
    other code point one of its own. Texts are looked at in blocks, so that what is held
    beside a text does not grow with it but for the set."""
    ends = BoundarySet()
    for base in range(0, len(text), _SPAN):
        raw = text[base : base + _SPAN + 1].encode("utf-32-le")
        letter = ((np.frombuffer(raw, dtype="<u4") | 0x20) - np.uint32(97)) < 26
        inside = letter[:-1] & letter[1:]  # a letter that another follows ends nothing
        low = np.flatnonzero(~inside) if len(letter) > _SPAN else np.append(np.flatnonzero(~inside), len(letter) - 1)
        ends.add(base + 1, low)
    return ends


def cuts(ends: BoundarySet, one: int, other: int) -> tuple[int, int]:
    """Both cut offsets: after ``one`` and ``other`` modulo the number of units plus one."""
    low, high = sorted((one % (len(ends) + 1), other % (len(ends) + 1)))
    return (ends.select(low - 1) if low else 0), (ends.select(high - 1) if high else 0)


def rearranged(
    text: str, draws: tuple[int, int, int, int], plain: int = 10, spm: int = 20
) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, lengths of prefix and middle, and the rearranged text.

    ``draws`` are four numbers that stand for chance: the first two choose the cuts, the third
    leaves ``plain`` texts of a hundred as they are, the fourth puts the suffix first in
    ``spm`` of a hundred.
    """
    ends = unit_ends(text)
    if not text or draws[2] % 100 >= 100 - plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    a, b = cuts(ends, draws[0], draws[1])
    head, middle, tail = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if draws[3] % 100 < spm:
        return len(ends), "spm", a, b - a, tail + head + middle
    return len(ends), "psm", a, b - a, head + tail + middle


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's text, rearranged for fill-in-the-middle training: ``doc_id``, ``n`` units,
    ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``text``.

    Forms: ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle), ``spm`` (``<S>`` suffix
    ``<P>`` prefix ``<M>`` middle) and ``plain``, the text as it is, with null lengths. What is
    drawn for a row depends on ``seed`` and its id alone (SHA-256 of ``seed:id``), so that
    retried tasks and other partitionings give the same rows. Rows never move.

    A null text is an empty one, and empty texts and texts with one of the three marks are
    plain. Rows without an id are drawn as an empty id; repeated rows give a row each; an
    empty table gives no rows.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = ids_and_texts(docs, id_col, text_col).select("doc_id", "text", drawn.alias("drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            drawn = batch.column("drawn").to_pylist()
            for at, size in _slices(texts):
                made = []
                for text, hexed in zip(texts.slice(at, size), drawn[at : at + size]):
                    draws = tuple(int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
                    made.append(rearranged(text.as_py(), draws, plain, spm))
                columns = [pa.array(c, type=k) for c, k in zip(zip(*made), kinds)]
                yield pa.record_batch([ids.slice(at, size), *columns, texts.slice(at, size)], NAMES)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, text string")


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text"]


def _slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Where to cut a batch: starts and numbers of rows, of about ``most`` bytes each."""
    sizes = [0] + list(accumulate(len(t.as_buffer()) if t.as_buffer() is not None else 0 for t in texts))
    at = 0
    while at < len(texts):
        end = max(at + 1, bisect_left(sizes, sizes[at] + most))
        yield at, min(end, len(texts)) - at
        at = end


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an output of ``fill_in_middle``.

    No part of a rearranged text holds a mark, and no mark can begin within another, so each
    stands once.
    """
    psm = F.regexp_replace(output, rf"(?s)^{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)^{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with SHA-256 digests of the output and of the text rebuilt from
    output and form in place of the texts."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
