"""Token ids of a tokenizers file, a batch of texts at a time, equal to the library's own.

A text falls at spaces into units that the library would encode alike on their own. Arrow
numbers the units of a batch; each distinct one is encoded once, all in one call, by the
merge ranks of the same file. Units that need more than lower case (rare characters, strings
of special tokens, extreme length) go through the tokenizers library itself. Nothing is kept
between batches, so memory follows the batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from causeway.llm.common import worker_state

# The patterns by which the two public vocabularies cut words.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+"

_END = "\x01"  # marks the end of a word for the merges; plain units never hold it
# Not plain: needs normalising, or is classed by a version of Unicode, or may be special.
_HARD = r"[^\n -~\x{a1}-\x{ac}\x{ae}-\x{ff}]|<\|"
_LONG = 4000
# White space after a space, or a space at the end: the space does not begin a unit there.
_WIDE = (
    r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}\x{feff}]| $"
)


def byte_letters() -> str:
    """The character by which a byte-level vocabulary writes each byte, by its number.

    Printable Latin-1 characters stand for themselves, all other bytes for the characters
    from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


class Encoder:
    """Ids of whole texts by one tokenizers file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"
        if not self.words and (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: neither a byte-level nor a word vocabulary")
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = "|".join(map(re.escape, sorted(special))) or r"[^\s\S]"
        letters = {c: b for b, c in enumerate(byte_letters())}
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in special:
                body = token.removesuffix("</w>") if self.words else token
                ranks[bytes(letters[c] for c in body) + (_END.encode() if body != token else b"")] = number
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, number in ranks.items():
            self.sizes[number] = len(token)
        pattern = f"[^{_END}]+{_END}" if self.words else BYTE_PATTERN
        self.merges = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def one(self, text: str) -> np.ndarray:
        """Ids of one text by the tokenizers library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units, the number of each unit in order, and units for each text."""
        if self.words:
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            numbered = parts.flatten().dictionary_encode()
            return (
                numbered.dictionary,
                numbered.indices.to_numpy(zero_copy_only=False),
                pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64),
            )
        odd = pc.match_substring_regex(texts, f"{_WIDE}|{self.special}")
        parts = pc.split_pattern(pc.if_else(odd, _text(""), texts), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        numbered = parts.flatten().dictionary_encode()
        words = pc.binary_join_element_wise(_text(""), numbered.dictionary, _text(" "))
        codes = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(counts):
            return words, codes, counts
        # The first unit of a text has no space before it.
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        firsts, place = np.unique(codes[starts], return_inverse=True)
        codes[starts] = len(words) + place
        words = pa.concat_arrays([words, numbered.dictionary.take(pa.array(firsts))])
        strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(strange):
            pieces, more = np.split(codes, starts[1:]), []
            for i in strange:
                text = texts[int(i)].as_py()
                own = [text] if re.search(self.special, text) else _spaced(text)
                pieces[i] = np.arange(len(own)) + len(words) + len(more)
                counts[i] = len(own)
                more += own
            words = pa.concat_arrays([words, pa.array(more, type=pa.large_string())])
            codes = np.concatenate(pieces)
        return words, codes, counts

    def unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units one after another, and the number of ids of each."""
        hard = pc.or_(pc.match_substring_regex(units, _HARD), pc.greater(pc.binary_length(units), _LONG))
        hard = hard.to_numpy(zero_copy_only=False)
        easy = units.filter(pa.array(~hard))
        if self.words:
            easy = pc.replace_substring_regex(pc.utf8_lower(easy), WORD_PATTERN, "\\0" + _END)
        sizes = np.zeros(len(units), dtype=np.int64)
        alone = np.zeros(len(easy), dtype=bool)
        if not self.words:  # what does not begin with a space can't be joined to others
            alone = pc.invert(pc.starts_with(easy, " ")).to_numpy(zero_copy_only=False)
        together = easy.filter(pa.array(~alone)) if alone.any() else easy
        ids, own = self._joined(together)
        sizes[np.flatnonzero(~hard)[~alone]] = own
        if not hard.any() and not alone.any():
            return ids, sizes
        found = [None] * len(units)
        for i, part in zip(np.flatnonzero(~hard)[~alone], np.split(ids, np.cumsum(own)[:-1]) if len(own) else []):
            found[i] = part
        for i, text in zip(np.flatnonzero(~hard)[alone], easy.filter(pa.array(alone)).to_pylist()):
            found[i] = np.array(self.merges.encode_ordinary(text), dtype=np.uint32)
        for i, text in zip(np.flatnonzero(hard), units.filter(pa.array(hard)).to_pylist()):
            found[i] = self.one(text)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.concatenate(found), sizes

    def _joined(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``unit_ids`` for plain units, encoded as one string."""
        if not len(units):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        lengths = pc.binary_length(units).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(units.buffers()[1], dtype=np.int64)[units.offset : units.offset + len(units) + 1]
        text = units.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes().decode() if offsets[-1] else ""
        ids = np.array(self.merges.encode_ordinary(text), dtype=np.uint32)
        ends = np.cumsum(self.sizes[ids])
        upto = np.searchsorted(ends, np.cumsum(lengths), side="right")
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32), and where each text's begin."""
        words, codes, counts = self.units(texts)
        pool, sizes = self.unit_ids(words)
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (ends - n), n)
        bounds = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]).astype(np.int64)
        return pool[take], bounds


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, type=pa.large_string())


def _spaced(text: str) -> list[str]:
    """``text`` cut before each space that a visible character follows."""
    cuts = [m.start() for m in re.finditer("(?s)(?<=.) (?=[^\\s᠎​﻿])", text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, made once."""
    state = worker_state()
    return state.get(("encoder", path)) or state.setdefault(("encoder", path), Encoder(path))


def portions(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in portions of about ``most`` bytes of text, at least one row."""
    held, weight = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, n in enumerate(lengths.tolist()):
            if weight and weight + n > most:
                yield _merged([*held, batch.slice(at, i - at)])
                held, weight, at = [], 0, i
            weight += n
        held.append(batch.slice(at))
    if held:
        yield _merged(held)


def _merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    merged = pa.Table.from_batches(batches).combine_chunks().to_batches()
    return merged[0] if merged else batches[0]


def strings(column: pa.Array) -> pa.Array:
    """A batch's column of texts with 64-bit offsets, which no batch can exceed."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def public_tokenizer(name: str) -> str:
    """Where the file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
