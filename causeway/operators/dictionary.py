"""Which words of a dictionary, given as a table of any size, stand in each text.

The words become one automaton in flat arrays: for each state and class of characters the
next state, and for each state the words that end there. A text is read once, whatever
the number of words; many texts advance together, a character at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

_PIECE = 512  # characters of a text that advance as one, at least
_CELLS = 1 << 22  # characters that advance together, about
_CLASS_BYTES = 2 * 0x110000  # of the classes of all characters, which each automaton holds
_PASS_BYTES = 32 << 20  # of automata that read the texts in one pass, about
_AT, _LOWER = "dictionary_word_at", "dictionary_text"  # columns that live inside only


class Automaton:
    """All words at once; ``words`` are distinct and not empty."""

    def __init__(self, words: list[str]):
        self.longest, self.words = max(map(len, words)), len(words)
        alphabet = sorted({c for w in words for c in w})
        self.classes = np.zeros(0x110000, dtype=np.uint16)  # 0: in no word
        for i, c in enumerate(alphabet, 1):
            self.classes[ord(c)] = i
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, word in enumerate(words):
            at = 0
            for c in self.classes[[ord(c) for c in word]].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][c]
            ends[at].append(number)
        self.next = np.zeros((len(children), len(alphabet) + 1), dtype=np.int32)
        behind = [0] * len(children)  # the state of the longest proper suffix
        for c, child in children[0].items():
            self.next[0, c] = child
        waiting = deque(children[0].values())
        while waiting:
            state = waiting.popleft()
            ends[state] += ends[behind[state]]
            self.next[state] = self.next[behind[state]]
            for c, child in children[state].items():
                behind[child] = int(self.next[behind[state], c])
                self.next[state, c] = child
                waiting.append(child)
        self.starts = np.cumsum([0] + [len(e) for e in ends])
        self.ends = np.array([n for e in ends for n in e], dtype=np.int32)
        self.final = np.diff(self.starts) > 0

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.classes, self.next, self.starts, self.ends, self.final))

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and word, each once, by text."""
        pieces, owner = [], []
        length = max(_PIECE, 8 * self.longest)  # a piece starts with the end of the one before
        for i, text in enumerate(texts):
            for at in range(0, max(len(text), 1), length):
                pieces.append(text[max(0, at - self.longest + 1) : at + length])
                owner.append(i)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        hits = []
        while order:
            width = max(1, _CELLS // max(1, len(pieces[order[0]])))
            some, order = order[:width], order[width:]
            hits.append(self._advanced([pieces[i] for i in some], np.array([owner[i] for i in some])))
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
        return pairs // self.words, pairs % self.words

    def _advanced(self, pieces: list[str], owner: np.ndarray) -> np.ndarray:
        """Pairs of owner and word, as one number, of pieces in descending order of length."""
        lengths = np.array([len(p) for p in pieces])
        grid = np.zeros((int(lengths[0]), len(pieces)), dtype=np.uint16)
        for i, piece in enumerate(pieces):
            grid[: len(piece), i] = self.classes[np.frombuffer(piece.encode("utf-32-le"), dtype="<u4")]
        state, hits = np.zeros(len(pieces), dtype=np.int32), [np.zeros(0, dtype=np.int64)]
        for step in range(len(grid)):
            on = int(np.searchsorted(-lengths, -step))  # pieces with a character here
            state = self.next[state[:on], grid[step, :on]]
            at = np.flatnonzero(self.final[state])
            if len(at):
                n = self.starts[state[at] + 1] - self.starts[state[at]]
                each = np.repeat(self.starts[state[at]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                hits.append(np.repeat(owner[at], n) * self.words + self.ends[each])
        return np.unique(np.concatenate(hits))


def _matched(texts: list[str], parts: list[tuple[Automaton, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text and word of several automata, by text; each counts its words from a number on."""
    found = [(row, word + start) for part, start in parts for row, word in [part.found(texts)]]
    row, word = (np.concatenate(side) for side in zip(*found))
    order = np.argsort(row, kind="stable")
    return row[order], word[order]


def _grouped(words: list[str], states: int) -> list[list[str]]:
    """Sorted words in runs whose automaton has at most ``states`` states, or one word."""
    groups: list[list[str]] = []
    used, before = states, ""
    for word in words:
        new = len(word) - len(commonprefix([before, word]))  # neighbours share their prefix's states
        if used + new > states:
            groups.append([])
            used, new = 1, len(word)
        groups[-1].append(word)
        used, before = used + new, word
    return groups


def dictionary_matches(texts: DataFrame, dictionary: DataFrame, text: str = "text", most_bytes: int = 32 << 20) -> DataFrame:
    """``texts``, all columns but ``text``, with ``word`` for each word that its text contains.

    As ``lower(text) contains lower(word)`` of all pairs, each once: ``dictionary(word)`` may
    repeat words, and empty ones count for nothing. The dictionary's size is checked: words whose
    automaton takes at most ``most_bytes`` go to the tasks with the job; a larger
    dictionary is dealt into parts of that size, by its letters. Texts are read once for as many
    parts as ``_PASS_BYTES`` hold, one at least; the words of these share automata by their prefixes. Texts are not shuffled.
    """
    words = dictionary.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
    letters = words.select(F.explode(F.split("word", "")).alias("c"))
    sizes = letters.agg(F.count("*").alias("states"), F.countDistinct("c").alias("letters")).first()
    state = 4 * (sizes.letters + 1) + 16  # bytes of a state
    parts = max(1, -(-sizes.states * state // most_bytes))
    at_once = max(1, _PASS_BYTES // (most_bytes + _CLASS_BYTES))
    rest = [f for f in texts.schema.fields if f.name != text]
    numbers = StructType([*rest, StructField(_AT, ArrayType(IntegerType()))])
    lowered = texts.select(*[f.name for f in rest], F.lower(text).alias(_LOWER))
    out = None
    for first in range(0, parts, at_once):
        part = F.pmod(F.xxhash64("word"), F.lit(parts))
        own = sorted(r.word for r in words.filter(part.between(first, first + at_once - 1)).collect())
        if not own:
            continue
        groups = _grouped(own, most_bytes // state)
        starts = np.cumsum([0, *map(len, groups)]).tolist()
        automata = [(Automaton(group), start) for group, start in zip(groups, starts)]
        known = lowered.sparkSession.sparkContext.broadcast(automata)

        def match(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, word = _matched([t or "" for t in batch.column(_LOWER).to_pylist()], known.value)
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(word.astype(np.int32)))
                columns = [batch.column(f.name) for f in rest] + [lists]
                yield pa.record_batch(columns, [*(f.name for f in rest), _AT])

        found = lowered.mapInArrow(match, numbers).select(*[f.name for f in rest], F.explode(_AT).alias(_AT))
        table = lowered.sparkSession.createDataFrame(list(enumerate(own)), f"{_AT} int, word string")
        matches = found.join(F.broadcast(table), _AT).drop(_AT)  # of the automata's words, whose size is checked
        out = matches if out is None else out.unionByName(matches)
    empty = lowered.select(*[f.name for f in rest], F.lit("").alias("word")).limit(0)
    return empty if out is None else out
