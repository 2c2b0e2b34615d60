"""Fill-in-the-middle rows against plain lists of units."""

import hashlib
import random
import re

import pytest

from causeway.llm import infilling

from .conftest import documents

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
MARKS = ("<P>", "<S>", "<M>")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    drawn = _sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, _sha(text), _sha(text))
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    a, b, c = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return (doc_id, len(units), form, len(a), len(b), _sha(out), _sha(text))


def _same(docs):
    got = sorted(map(repr, map(tuple, infilling.digests(infilling.fill_in_middle(docs)).collect())))
    return got == sorted(repr(_brute(r.doc_id, r.text)) for r in docs.collect())


def test_rows_equal_brute_force(spark, odd, real, none):
    assert _same(odd) and _same(real)
    assert infilling.fill_in_middle(none).count() == 0
    marked = [(i, t) for i, t in enumerate(["<P>", "a<S>b", "<M", "<" * 9, "<P<S<M", "S>M>", "\r\n", " x\n", "é\U0001f600z"] * 9)]
    assert _same(documents(spark, marked))


def test_very_long_texts(spark):
    rnd = random.Random(5)
    texts = [
        "".join(rnd.choice("ab \U0001f600") for _ in range(400_000)), "word " * 300_000, "z" * 500_000, "\n" * 70_000,
        "".join(rnd.choice(["a" * 50, " ", "é"]) for _ in range(20_000)),
    ]
    assert _same(documents(spark, list(enumerate(texts))))


def test_shares_of_the_forms(spark):
    docs = documents(spark, [(i, "some words to cut") for i in range(4000)])
    forms = [r.form for r in infilling.fill_in_middle(docs, plain=25, spm=50).collect()]
    assert abs(forms.count("plain") - 1000) < 120 and abs(forms.count("spm") - 1500) < 150
    again = [r.output for r in infilling.fill_in_middle(docs.repartition(7)).orderBy("doc_id").collect()]
    assert again == [r.output for r in infilling.fill_in_middle(docs).orderBy("doc_id").collect()]
    other = [r.output for r in infilling.fill_in_middle(docs, seed=2).orderBy("doc_id").collect()]
    assert again != other


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("", set()), ("a", {"array"}), ("a" * 65536, {"array"}), ("a" * 65537 + " b", {"run"}), (" " * 200_000, {"run"}),
        ("ab " * 100_000, {"bitmap"}), ("ab " * 21_845 + "abc" * 30_000, {"array"}), (" " * 65536 + "ab " * 30_000, {"run", "bitmap"}),
    ],
)
def test_boundary_set_selects_every_rank(text, kinds):
    ends, wanted = infilling.unit_ends(text), [m.end() for m in UNIT.finditer(text)]
    assert len(ends) == len(wanted) and kinds <= set(ends.kinds)
    step = max(1, len(wanted) // 5000)
    assert all(ends.select(k) == wanted[k] for k in range(0, len(wanted), step))
    assert not wanted or ends.select(len(wanted) - 1) == wanted[-1]
