"""BPE by tree concatenation: halves of a long text are encoded apart and joined exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts, partitions, worker_state
from causeway.llm.planes import from_planes, to_planes
from causeway.llm.token_ids import Encoder, encoder, portions, strings

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_WINDOW = 4096
_RUN = 256  # characters; a longer unit falls into pieces at its tokens


@dataclass
class Encoded:
    """A stretch of text as pieces: where each begins and ends, and its ids."""

    begins: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    def part(self, a: int, b: int) -> Encoded:
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        return Encoded(self.begins[a:b], self.ends[a:b], self.sizes[a:b], self.ids[at[a] : at[b]])

    def piece(self, i: int) -> tuple:
        at = int(self.sizes[:i].sum())
        return int(self.begins[i]), int(self.ends[i]), self.ids[at : at + int(self.sizes[i])].tobytes()


def packed(encoded: Encoded) -> bytes:
    """An encoding that begins at 0, small: gaps and lengths of pieces, in compressed byte planes."""
    gaps = encoded.begins - np.concatenate([[0], encoded.ends[:-1]])
    counts = np.array([len(encoded.sizes), len(encoded.ids)])
    numbers = np.concatenate([counts, gaps, encoded.ends - encoded.begins, encoded.sizes, encoded.ids])
    return zstandard.compress(b"".join(to_planes(numbers.astype("<u4"), "byte")), 1)


def unpacked(raw: bytes, at: int = 0) -> Encoded:
    """What ``packed`` made, moved to begin at ``at``."""
    planes = zstandard.decompress(raw)
    n = len(planes) // 4
    numbers = from_planes([planes[i * n : (i + 1) * n] for i in range(4)], n, "byte").astype(np.int64)
    pieces = int(numbers[0])
    gaps, lengths, sizes = numbers[2 : 2 + 3 * pieces].reshape(3, pieces)
    ends = np.cumsum(gaps + lengths) + at
    return Encoded(ends - lengths, ends, sizes, numbers[2 + 3 * pieces :].astype(np.uint32))


def concatenated(parts: list[Encoded]) -> Encoded:
    return Encoded(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("begins", "ends", "sizes", "ids")))


def pieces(codec: Encoder, text: str, at: int = 0) -> Encoded:
    """``text``, which begins at ``at``, encoded: a piece for each unit between spaces, and
    for each token, or tokens within one character, of units longer than 256 characters."""
    units = text.replace("\n", " ").split(" ")
    begins = np.cumsum([0, *(len(u) + 1 for u in units)])[:-1] + at
    long = [i for i, u in enumerate(units) if len(u) > _RUN]
    short = ["" if len(u) > _RUN else u for u in units]
    if len(text) < _WINDOW:  # a window around a join: setting up a batch would cost more
        found = [codec.one(u) for u in short]
        ids, sizes = np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)
    else:
        ids, sizes = codec.unit_ids(pa.array(short, type=pa.large_string()))
    whole = Encoded(begins, begins + [len(u) for u in units], sizes, ids)
    if not long:
        return _filled(whole)
    out, last = [], 0
    for i in long:
        out += [whole.part(last, i), _tokens(codec, units[i], int(begins[i]))]
        last = i + 1
    return _filled(concatenated([*out, whole.part(last, len(units))]))


def pieces_of_each(codec: Encoder, texts: pa.Array) -> Iterator[Encoded]:
    """``pieces`` of each of many texts, from 0, with each distinct unit encoded once."""
    words, codes, counts = codec.units(texts)
    pool, sizes = codec.unit_ids(words)
    starts = np.cumsum(sizes) - sizes
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        own = codes[a:b]
        if (lengths[own] > _RUN).any():
            yield pieces(codec, texts[i].as_py())
            continue
        begins = np.cumsum(lengths[own] + 1) - lengths[own] - 1
        n = sizes[own]
        total = np.cumsum(n)
        take = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts[own] - (total - n), n)
        yield _filled(Encoded(begins, begins + lengths[own], n, pool[take]))


def _filled(encoded: Encoded) -> Encoded:
    keep = encoded.sizes > 0
    return Encoded(encoded.begins[keep], encoded.ends[keep], encoded.sizes[keep], encoded.ids)


def _tokens(codec: Encoder, unit: str, at: int) -> Encoded:
    """A long unit by the library, cut between its tokens wherever no character is shared."""
    found = codec.library.encode(unit, add_special_tokens=False)
    begins, ends, sizes = [], [], []
    for a, b in found.offsets:
        if ends and a < ends[-1]:
            ends[-1], sizes[-1] = max(b, ends[-1]), sizes[-1] + 1
        else:
            begins.append(a)
            ends.append(b)
            sizes.append(1)
    whole = (np.array(x, dtype=np.int64) for x in (begins, ends, sizes))
    begins, ends, sizes = whole
    return Encoded(begins + at, ends + at, sizes, np.array(found.ids, dtype=np.uint32))


def join(codec: Encoder, text: str, left: Encoded, right: Encoded, a: int, cut: int, b: int, window: int = 64) -> Encoded:
    """The encoding of ``text[a:b]`` from those of its halves, which meet at ``cut``.

    A window around the cut is encoded and grown until it and each half have a run of four
    equal pieces, or until it reaches that half's far end. A token sequence is the one BPE
    gives if each adjacent pair is, so such a run makes the outcome exact.
    """
    while True:
        low, high = max(a, cut - window), min(b, cut + window)
        middle = pieces(codec, text[low:high], low)
        n = len(middle.begins)
        head = (0, 0) if low == a else _agreement(middle, left, range(1, n - 4), lambda x: x.ends[-1] <= cut)
        tail = (n, len(right.begins))
        if high < b:
            tail = _agreement(middle, right, range(n - 5, -1, -1), lambda x: x.begins[0] >= cut)
        if head and tail and head[0] <= tail[0]:
            kept = left.part(0, head[1]), middle.part(head[0], tail[0]), right.part(tail[1], len(right.begins))
            return concatenated([*kept])
        window *= 2


def _agreement(middle: Encoded, half: Encoded, tries: range, usable) -> tuple[int, int] | None:
    """Where four pieces of both are equal, clear of the ends of both: the places of the third."""
    for i in tries:
        four = middle.part(i, i + 4)
        if not usable(four):
            continue
        j = int(np.searchsorted(half.begins, four.begins[0]))
        if 0 < j and j + 4 < len(half.begins):
            own = half.part(j, j + 4)
            if all(np.array_equal(x, y) for x, y in zip(vars(four).values(), vars(own).values())):
                return i + 2, j + 2
    return None


def encode_tree(codec: Encoder, text: str, leaves: list[Encoded], leaf: int) -> np.ndarray:
    """All ids of ``text`` from the encodings of its stretches of ``leaf`` characters."""
    level = [(x, i * leaf, min(len(text), (i + 1) * leaf)) for i, x in enumerate(leaves)]
    while len(level) > 1:
        paired = []
        for (x, a, cut), (y, _, b) in zip(level[::2], level[1::2]):
            paired.append((join(codec, text, x, y, a, cut, b), a, b))
        level = paired + ([level[-1]] if len(level) % 2 else [])
    return level[0][0].ids


class Decoder:
    """Token strings by id; a text is what the library's decode gives with special tokens."""

    def __init__(self, codec: Encoder):
        self.library = codec.library
        size = self.library.get_vocab_size(True)
        self.names = pa.array([self.library.id_to_token(i) or "" for i in range(size)])
        self.numbers = pa.array([str(i) for i in range(size)])

    def digests(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str, str]]:
        """Length and digests of the listed ids and of the decoded text, for each stretch of ids."""
        listed = _joined(self.numbers, ids, bounds)
        if self.library.decoder is None:  # then tokens are parted by spaces
            decoded = _joined(self.names, ids, bounds)
        else:
            parts = (ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:]))
            decoded = (self.library.decode(x, skip_special_tokens=False).encode() for x in parts)
        return [
            (int(n), hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest())
            for n, x, y in zip(np.diff(bounds), listed, decoded)
        ]


def _joined(names: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
    """The names of each stretch of ids, with spaces between, in UTF-8."""
    for a in range(0, len(bounds) - 1, 4096):
        own = bounds[a : a + 4097]
        values = names.take(pa.array(ids[own[0] : own[-1]]))
        if len(values) < 1 << 26:
            lists = pa.ListArray.from_arrays(pa.array(own - own[0], type=pa.int32()), values)
            for text in pc.binary_join(lists, " "):
                yield text.as_buffer().to_pybytes()
        else:  # beyond what 32-bit offsets hold
            for x, y in zip(own[:-1] - own[0], own[1:] - own[0]):
                yield " ".join(values[int(x) : int(y)].to_pylist()).encode()


def encode_decode(
    docs: DataFrame,
    tokenizer: str,
    leaf: int = 16_384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of the ids and of the decoded text, for every row.

    Texts up to ``leaf`` characters are leaves, encoded where they are read. Longer ones are
    cut into leaves that are dealt out over all tasks; the leaves of a text meet again in
    one task, which joins them in pairs, level by level. What a task holds is one text.

    A null or empty text has no ids. Null ids and repeated rows give a row each; an empty
    table gives no rows.
    """
    rows = ids_and_texts(docs, id_col, text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        decoder = _decoder(tokenizer)
        for part in portions(batches):
            ids, bounds = codec.encode(strings(part.column("text")))
            yield _batch(part.column("doc_id"), decoder.digests(ids, bounds))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        for part in portions(batches):
            found = [packed(x) for x in pieces_of_each(codec, strings(part.column("text")))]
            names = ["doc_id", "text_key", "leaf", "text"]
            columns = [part.column(name) for name in names]
            yield pa.record_batch([*columns, pa.array(found, type=pa.binary())], [*names, "encoded"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        codec = encoder(tokenizer)
        copies = int((group["leaf"] == 0).sum())  # a repeated row brings its leaves again
        own = group.drop_duplicates("leaf").sort_values("leaf")
        encoded = [unpacked(r.encoded, r.leaf * leaf) for r in own.itertuples()]
        ids = encode_tree(codec, "".join(own["text"]), encoded, leaf)
        (found,) = _decoder(tokenizer).digests(ids, np.array([0, len(ids)]))
        row = (own["doc_id"].iloc[0], *found)
        return pd.DataFrame([row] * copies, columns=[c.split()[0] for c in RESULT.split(", ")])

    length = F.length("text")
    short = rows.filter(length <= leaf).mapInArrow(whole, RESULT)
    cut = (
        rows.filter(length > leaf)
        .select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.expr(f"sequence(0, (length(text) - 1) div {leaf})").alias("at"))
        .select("doc_id", "text_key", F.posexplode("at").alias("leaf", "at"), "text")
        .select("doc_id", "text_key", "leaf", F.expr(f"substring(text, leaf * {leaf} + 1, {leaf})").alias("text"))
    )
    dealt = cut.repartition(partitions(docs), "doc_id", "text_key", "leaf").mapInArrow(
        leaves,
        "doc_id long, text_key long, leaf int, text string, encoded binary",
    )
    return short.unionByName(dealt.groupBy("doc_id", "text_key").applyInPandas(joined, RESULT))


def _decoder(path: str) -> Decoder:
    """The worker's decoder for ``path``, made once."""
    state = worker_state()
    return state.get(("decoder", path)) or state.setdefault(("decoder", path), Decoder(encoder(path)))


def _batch(doc_ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    n, ids, decoded = zip(*found) if found else ((), (), ())
    return pa.record_batch(
        [doc_ids, pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )
