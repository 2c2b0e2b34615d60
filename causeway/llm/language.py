"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts, partitions
from causeway.session import materialize

ORDERS = (2, 3, 4)
_BITS = 15
_SIZE = len(ORDERS) << _BITS  # grams of all orders
_COUNTS = 1 << 12  # counts in a row that tasks hand on
_STEP = 256  # a weight of one unit of log odds, as an integer
_BLOCK = 1 << 17  # bytes looked at together
_STEADY = 8  # grams that a text is taken to have beside its own, of no bit

# Bytes as the classifiers see them: all of ASCII but letters is a gap.
_SEEN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, lower-cased, three gaps between any two, and where each begins."""
    parts = [b" " + t.lower().encode().translate(_SEEN) + b"  " for t in texts]
    starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


def gram_blocks(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of ``raw``: the first place, and the numbers of the grams of each order that
    begin at each place. A gram with two gaps side by side, and so any gram of two texts, has
    the number ``_SIZE``."""
    for at in range(0, len(raw), _BLOCK):
        v = raw[at : at + _BLOCK + ORDERS[-1] - 1]
        n = min(_BLOCK, len(raw) - at)
        v = np.concatenate([v, np.full(n + ORDERS[-1] - 1 - len(v), 32, dtype=np.uint8)]).astype(np.uint32)
        gap = v == 32
        twice = gap[:-1] & gap[1:]
        out = np.empty((len(ORDERS), n), dtype=np.int64)
        code, void = v, np.zeros(len(v), dtype=bool)
        for order in range(2, ORDERS[-1] + 1):
            code = (code[:-1] << np.uint32(8)) | v[order - 1 :]
            void = void[:-1] | twice[order - 2 :]
            if order in ORDERS:
                i = ORDERS.index(order)
                number = ((code * np.uint32(2654435761)) >> np.uint32(32 - _BITS)).astype(np.int64)
                out[i] = np.where(void, _SIZE, number + (i << _BITS))[:n]
        yield at, out


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Ranges of texts of about ``most`` characters each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def gram_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """How often each gram stands in all texts of ``rows(text, lang)`` of each language.

    A task adds up its texts and hands on blocks of counts that are not all zero; blocks are
    added up by Spark. The driver gets one table of ``languages`` by grams.
    """
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()])
            texts = batch.column("text").to_pylist()
            for which in np.unique(langs).tolist():
                own = [texts[i] for i in np.flatnonzero(langs == which)]
                sums = total.setdefault(which, np.zeros(_SIZE + 1, dtype=np.int64))
                for some in _groups(own):
                    for _, grams in gram_blocks(joined(own[some])[0]):
                        sums += np.bincount(grams.ravel(), minlength=_SIZE + 1)
        yield from _blocks(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for which, block, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "counts"))):
                sums = total.setdefault(which, np.zeros(_SIZE + 1, dtype=np.int64))
                sums[block * _COUNTS : (block + 1) * _COUNTS] += np.frombuffer(counts, dtype="<i8")
        yield from _blocks(total)

    form = "lang int, block int, counts binary"
    parts = rows.select("text", "lang").mapInArrow(count, form)
    sums = parts.repartition(max(1, min(partitions(rows), _SIZE // _COUNTS)), "block").mapInArrow(add, form)
    out = np.zeros((len(languages), _SIZE), dtype=np.int64)
    for r in sums.collect():
        out[r.lang, r.block * _COUNTS : (r.block + 1) * _COUNTS] = np.frombuffer(r.counts, dtype="<i8")
    return out


def _blocks(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for which, sums in total.items():
        table = sums[:_SIZE].reshape(-1, _COUNTS)
        some = np.flatnonzero(table.any(axis=1)).tolist()
        if some:
            columns = [
                pa.array([which] * len(some), type=pa.int32()), pa.array(some, type=pa.int32()),
                pa.array([table[b].astype("<i8").tobytes() for b in some], type=pa.binary()),
            ]
            yield pa.record_batch(columns, ["lang", "block", "counts"])


def codewords(k: int) -> np.ndarray:
    """A codeword of 1 and -1 for each of ``k`` languages.

    Rows of a Hadamard matrix of order 8 or more without the first column: any two words
    differ in half the order.
    """
    words = np.ones((1, 1), dtype=np.int64)
    while len(words) < max(8, k + 1):
        words = np.block([[words, words], [words, -words]])
    words = words[1 : k + 1, 1:]
    useful = [b for b in range(words.shape[1]) if k == 1 or abs(int(words[:, b].sum())) < k]
    return words[:, useful]


@dataclass
class Codes:
    """Languages, their codewords, the weights of every bit's classifier, the weights of bits."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray | None = None

    @property
    def radius(self) -> int:
        """Wrong bits that still leave a codeword the nearest."""
        if len(self.words) < 2:
            return self.words.shape[1]
        apart = (self.words[:, None, :] != self.words[None, :, :]).sum(axis=2)
        return (int(apart[np.triu_indices(len(self.words), 1)].min()) - 1) // 2

    def margins(self, texts: list[str]) -> np.ndarray:
        """Each bit's margin for each text: the mean log odds of its grams, drawn towards 0 where
        they are few. Sums are of integers, so that they do not depend on the blocks."""
        raw, starts = joined(texts)
        sums = np.zeros((len(texts), self.weights.shape[1]), dtype=np.int64)
        for at, grams in gram_blocks(raw):
            first = int(np.searchsorted(starts, at, side="right")) - 1
            last = int(np.searchsorted(starts, at + grams.shape[1], side="left"))
            bounds = np.maximum(starts[first:last] - at, 0)
            each = self.weights[grams[0]].astype(np.int32)
            for more in grams[1:]:
                each += self.weights[more]
            sums[first:last] += np.add.reduceat(each, bounds, axis=0, dtype=np.int64)
        grams = sums[:, -1:]
        return _STEADY * sums[:, :-1] / _STEP / (grams + _STEADY)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row the language's number, its score, how many bits are off its codeword,
        and whether that leaves another codeword as near.

        The loss of a codeword is the logistic loss of all its bits, each weighted by how often
        that bit is right for texts of the language.
        """
        signed = margins[:, None, :] * self.words[None, :, :]
        loss = (np.logaddexp(0, -signed) * self.trust[None, :, :]).sum(axis=2) * self.words.shape[1]
        best = loss.argmin(axis=1)
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        off = (np.where(signed > 0, 1, -1) < 0).sum(axis=2)
        mine = off[np.arange(len(off)), best]
        return best, 1 / odds.sum(axis=1), mine, mine > self.radius


def bit_weights(counts: np.ndarray, words: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """The log odds of each gram for each bit, as integers, and a last column that counts grams.

    A bit's classifier sets the languages with 1 in their codewords against those with -1, each
    language with the same weight however many texts it has.
    """
    rates = np.empty(counts.shape)
    for i in range(len(ORDERS)):
        own = slice(i << _BITS, (i + 1) << _BITS)
        part = counts[:, own] + smooth
        rates[:, own] = part / part.sum(axis=1, keepdims=True)
    out = np.zeros((_SIZE + 1, words.shape[1] + 1), dtype=np.int16)
    for b in range(words.shape[1]):
        sides = [rates[words[:, b] == s] for s in (1, -1)]
        if all(map(len, sides)):
            odds = np.log(sides[0].mean(axis=0)) - np.log(sides[1].mean(axis=0))
            out[:-1, b] = np.clip(np.rint(odds * _STEP), -(2**15) + 1, 2**15 - 1)
    out[:-1, -1] = 1
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: one in four, by the checksum of the id's digits."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(
    docs: DataFrame, most: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Every row's language by what the others say: ``doc_id``, ``held_out``, ``lang_pred``,
    ``score``, ``bits_off`` and ``ambiguous``.

    Learned from are all rows that are not held out and have an id and a language; where they
    name more than ``most`` languages, the ``most`` frequent are learned (ties by name), which
    bounds the model. Texts are read twice, whole: grams are counted by language, then every
    text gets the margins of all bits, which are written with the row. From those of the rows
    learned from comes the weight of each bit for each language, and the decoding. Scores see
    nothing but the text; ``bits_off`` counts bits against the chosen codeword, and
    ``ambiguous`` says that they are more than the code can correct.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is every
    text where nothing can be learned; with a single language all others get it. Rows without
    an id are not learned from; repeated rows count each; an empty table gives no rows.
    """
    rows = ids_and_texts(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    learned = ~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
    known = rows.filter(learned).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    languages = sorted(r.lang for r in known)
    if not languages:
        nothing = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).alias("bits_off"), F.lit(False).alias("ambiguous")]
        return rows.select("doc_id", "held_out", *nothing)
    words = codewords(len(languages))
    training = rows.filter(learned & F.col("lang").isin(languages))
    codes = Codes(languages, words, bit_weights(gram_counts(training, languages), words))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [codes.margins(texts[some]) for some in _groups(texts)] or [np.zeros((0, words.shape[1]))]
            margins = pa.array(list(np.concatenate(found)), type=pa.list_(pa.float64()))
            letters = pa.array([any(map(str.isalpha, t)) for t in texts], type=pa.bool_())
            columns = [batch.column(c) for c in ("doc_id", "held_out", "lang")]
            yield pa.record_batch([*columns, margins, letters], ["doc_id", "held_out", "lang", "margins", "letters"])

    form = "doc_id long, held_out boolean, lang string, margins array<double>, letters boolean"
    measured = materialize(rows.mapInArrow(measure, form))
    codes.trust = _trust(measured.filter(learned & F.col("lang").isin(languages)), codes)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, "und"], dtype=object)
        for batch in batches:
            margins = batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(-1, words.shape[1])
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            best, score, off, unsure = codes.decode(margins)
            columns = [
                batch.column("doc_id"), batch.column("held_out"),
                pa.array(names[np.where(letters, best, len(languages))], type=pa.string()),
                pa.array(np.where(letters, score, 0.0)),
                pa.array(off.astype(np.int32)), pa.array(unsure | ~letters),
            ]
            yield pa.record_batch(columns, ["doc_id", "held_out", "lang_pred", "score", "bits_off", "ambiguous"])

    result = "doc_id long, held_out boolean, lang_pred string, score double, bits_off int, ambiguous boolean"
    return measured.mapInArrow(decide, result)


def _trust(rows: DataFrame, codes: Codes) -> np.ndarray:
    """The share of texts of each language for which each bit is right, as weights of sum 1."""
    at = F.array_position(F.array(*[F.lit(x) for x in codes.languages]), F.col("lang"))
    right = [
        F.avg((F.col("margins")[b] * F.get(F.array(*[F.lit(int(w)) for w in codes.words[:, b]]), at - 1) > 0).cast("double")).alias(f"b{b}")
        for b in range(codes.words.shape[1])
    ]
    shares = np.full(codes.words.shape, 0.5)
    for r in rows.filter("letters").groupBy("lang").agg(*right).collect():
        shares[codes.languages.index(r.lang)] = [r[f"b{b}"] for b in range(shares.shape[1])]
    shares = shares + 1e-3
    return shares / shares.sum(axis=1, keepdims=True)
