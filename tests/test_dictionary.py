"""The dictionary automaton against substring tests of all pairs."""

import random

import numpy as np
import pytest

from causeway.operators import dictionary
from causeway.operators.dictionary import Automaton, dictionary_matches


def _brute(rows, words):
    words = {w.lower() for w in words if w}
    return sorted((i, w) for i, t in rows for w in words if t is not None and w in t.lower())


def _got(df):
    return sorted((r.id, r.word) for r in df.collect())


def test_words_within_words_and_over_pieces():
    words = ["he", "she", "hers", "his", "e", "x" * 50, "aba", "é", "ba ab"]
    rnd = random.Random(4)
    texts = ["", "ushers", "x" * 49, "x" * 5000, "aba ababa ab", "É é", "a" * 4095 + "ba ab"]
    texts += ["".join(rnd.choice("hesirba x") for _ in range(rnd.randrange(9000))) for _ in range(40)]
    row, word = Automaton(words).found(texts)
    assert list(zip(row.tolist(), word.tolist())) == sorted((i, n) for i, t in enumerate(texts) for n, w in enumerate(words) if w in t)


@pytest.mark.parametrize("most", [32 << 20, 100_000])
def test_ten_thousand_words_equal_the_substring_join(spark, most):
    rnd = random.Random(5)
    words = list({"".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))) for _ in range(11_000)})
    words = words[:10_000] if most > 1 << 20 else words[:2_000]
    rows = [(i, " ".join(rnd.choice(words).upper() + rnd.choice("xyz ") for _ in range(rnd.randrange(30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "ab" * 9000)]
    texts = spark.createDataFrame(rows, "id int, text string").repartition(3)
    dictionary = spark.createDataFrame([(w,) for w in words + words[:9] + ["", None]], "word string")
    found = dictionary_matches(texts, dictionary, most_bytes=most)
    assert _got(found) == _brute(rows, [w for w in words if w])


def test_no_words_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "text")], "id int, text string")
    none = spark.createDataFrame([], "word string")
    assert dictionary_matches(texts, none).columns == ["id", "word"] and dictionary_matches(texts, none).count() == 0
    some = spark.createDataFrame([("ex",)], "word string")
    assert dictionary_matches(texts.limit(0), some).count() == 0 and _got(dictionary_matches(texts, some)) == [(1, "ex")]


def test_arrays_are_flat_and_small():
    automaton = Automaton([f"{i}word" for i in range(1000)])
    assert automaton.next.dtype == np.int32 and automaton.nbytes < 4 << 20


def test_texts_are_read_once_for_many_parts(spark, monkeypatch):
    words = [f"{a}{b}{c}word" for a in "abcde" for b in "fghij" for c in "klmno"]
    rows = [(i, f"{w} and {w}s") for i, w in enumerate(words)]
    texts = spark.createDataFrame(rows, "id int, text string")
    dictionary_words = spark.createDataFrame([(w,) for w in words], "word string")
    for most, passes in ((64 << 20, 1), (16_000, 1), (16_000, 2)):
        if passes > 1:  # two parts in a pass
            monkeypatch.setattr(dictionary, "_PASS_BYTES", 2 * (most + dictionary._CLASS_BYTES))
        found = dictionary_matches(texts, dictionary_words, most_bytes=most)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("MapInArrow") > 1) == (passes > 1)
        assert _got(found) == _brute(rows, words)


def test_neighbours_share_states_within_the_limit():
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(900)} | {"c" * 70})
    groups = dictionary._grouped(words, 60)
    assert [w for g in groups for w in g] == words
    assert all(len(Automaton(g).next) <= 60 or len(g) == 1 for g in groups)
    assert len(groups) < sum(map(len, words)) / 60 / 1.5
