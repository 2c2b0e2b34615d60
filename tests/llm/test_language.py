"""Languages against classifiers worked out with dictionaries, and on rows held out."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from causeway.llm import language

FORM = "doc_id long, text string, lang string"
NAMES = ["doc_id", "held_out", "lang_pred", "score", "bits_off", "ambiguous"]


def _grams(text):
    b = b" " + text.lower().encode() + b" "
    b = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in b)
    return [b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1) if b"  " not in b[i : i + n]]


def _number(gram):
    return ((len(gram) - 2) << 15) + ((int.from_bytes(gram, "big") * 2654435761 % 2**32) >> 17)


def _out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _brute(rows):
    train = [(t or "", l) for d, t, l in rows if l is not None and d is not None and not _out(d)]
    langs = sorted({l for _, l in train})
    words = language.codewords(len(langs))
    bits = range(words.shape[1])
    counts = defaultdict(Counter)
    for t, l in train:
        counts[l].update(_number(g) for g in _grams(t))
    totals = {(l, n): sum(c for g, c in counts[l].items() if g >> 15 == n) + 0.5 * 2**15 for l in langs for n in range(3)}

    def rate(l, g):
        return (counts[l][g] + 0.5) / totals[l, g >> 15]

    def margins(text):
        numbers = [_number(g) for g in _grams(text)]
        out = []
        for b in bits:
            sides = [[l for i, l in enumerate(langs) if words[i, b] == s] for s in (1, -1)]
            total = sum(round(256 * (math.log(sum(rate(l, g) for l in sides[0]) / len(sides[0])) - math.log(sum(rate(l, g) for l in sides[1]) / len(sides[1])))) for g in numbers)
            out.append(8 * total / 256 / (len(numbers) + 8))
        return out

    letters = [(m, l) for m, l in ((t, l) for t, l in train) if any(map(str.isalpha, m))]
    right = {l: [[1e-3 + (m * words[i, b] > 0) for b, m in enumerate(margins(t))] for t, x in letters if x == l] for i, l in enumerate(langs)}
    trust = [np.mean(right[l], axis=0) / np.mean(right[l], axis=0).sum() for l in langs]
    out = []
    for d, t, _ in rows:
        t = t or ""
        if not any(map(str.isalpha, t)):
            out.append((d, _out(d), "und", 0.0))
            continue
        m = margins(t)
        loss = [sum(trust[i][b] * math.log1p(math.exp(-words[i, b] * m[b])) for b in bits) * len(bits) for i in range(len(langs))]
        best = loss.index(min(loss))
        out.append((d, _out(d), langs[best], round(1 / sum(math.exp(loss[best] - x) for x in loss), 6)))
    return out


def _key(row):
    return tuple((x is not None, x) for x in row)


def _got(df):
    assert df.columns == NAMES
    return sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in df.collect()), key=_key)


def test_languages_equal_dictionaries(spark):
    texts = {"aa": "lemo ka tovi sure", "bb": "sköt ärun fild", "cc": "ouan peille trè", "dd": "wor ist zuch"}
    rows = [(i, " ".join(t.split()[j % 3 :] + [str(i)] * (i % 3) + [w[: 1 + i % 4] for w in t.split()]), l) for i, (j, (l, t)) in enumerate((j, x) for j in range(9) for x in texts.items())]
    rows += [(None, "lemo ka", "aa"), (200, None, "bb"), (201, "", "bb"), (202, "12 . 7\n!", "cc"), (203, "lemo", None), (204, "x", None)]
    rows += [(300, "tovi", "aa"), (300, "tovi", "aa"), (301, "ÄRUN  fild\t" * 2000 + "ß" * 3000, "bb")]
    docs = spark.createDataFrame(rows, FORM)
    for name in ("held_out", "margins", "letters", "count", "block", "counts", "__l"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert _got(language.identify_languages(docs)) == sorted(_brute(rows), key=_key)
    assert _got(language.identify_languages(docs.repartition(7))) == _got(language.identify_languages(docs))


def test_nothing_or_one_language_to_learn(spark):
    rows = [(i, "some text", None) for i in range(9)] + [(9, None, None), (10, "7", None)]
    docs = spark.createDataFrame(rows, FORM)
    assert {(r.lang_pred, r.score) for r in language.identify_languages(docs).collect()} == {("und", 0.0)}
    assert language.identify_languages(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(d, t, "xx" if d % 2 else None) for d, t, _ in rows], FORM)
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(one).collect()}
    assert got == {d: "xx" if d < 9 else "und" for d in range(11)}
    two = spark.createDataFrame([(d, "lo ve" if d % 3 else "ka sti", ["xx", "yy"][d % 3 > 0]) for d in range(30)], FORM)
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(two).collect()}
    assert got == {d: "yy" if d % 3 else "xx" for d in range(30)}
    most = {r.lang_pred for r in language.identify_languages(two, most=1).collect()}
    assert most == {"yy"}


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r.held_out]
    assert len(found) == docs.count() and 150 < len(out) < 350
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_codewords_correct_errors():
    for k in (1, 2, 3, 4, 7, 20, 64):
        words = language.codewords(k)
        assert len({tuple(w) for w in words.tolist()}) == k and words.shape[1] > 0
    words = language.codewords(4)
    codes = language.Codes(list("abcd"), words, np.zeros((0, 0)), np.full(words.shape, 1 / words.shape[1]))
    assert codes.radius == 1
    for i, word in enumerate(words):
        for b in range(words.shape[1]):
            wrong = 4.0 * word
            wrong[b] *= -1
            best, _, off, unsure = codes.decode(wrong[None])
            assert best[0] == i and off[0] == 1 and not unsure[0]
