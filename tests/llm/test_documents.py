"""Dedup, fingerprints, near groups, shards, licences and quality against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import components, exact_dedup, fingerprints, licenses, quality, sharding, simhash

from .conftest import ODD, documents

GAP = re.compile(r"[\x20\x09-\x0D]+")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- exact duplicates -------------------------------------------------------------------


def _exact(rows):
    rows = [(d, _sha(GAP.sub(" ", t or ""))) for d, t in rows]
    groups = defaultdict(list)
    for d, s in rows:
        groups[s].append(d)
    out, seen = Counter(), set()
    for d, s in rows:
        known = [x for x in groups[s] if x is not None]
        keep = min(known) if known else None
        kept = d == keep and (d, s) not in seen
        seen.add((d, s))
        out[(d, keep, len(groups[s]), kept, s)] += 1
    return out


def test_exact_groups(spark, odd, real, none):
    for docs in (odd, real):
        got = Counter(map(tuple, exact_dedup.exact_groups(docs).collect()))
        assert got == _exact([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dedup.exact_groups(none).count() == 0


def test_one_text_may_hold_a_third_of_all_rows(spark):
    docs = documents(spark, [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    got = Counter(map(tuple, exact_dedup.exact_groups(docs).collect()))
    assert got == _exact([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dedup.drop_duplicates(docs).count() == 2001
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns


def test_cuckoo_index_grows_and_forgets():
    index, live = exact_dedup.CuckooIndex(rows=2), {}
    rnd = np.random.default_rng(3)
    for step in range(4000):
        digest = _sha(str(int(rnd.integers(0, 900))))
        if digest in live and rnd.random() < 0.5:
            assert index.delete(digest)
            del live[digest]
        elif digest not in live:
            index.insert(digest, [step, 1])
            live[digest] = [step, 1]
    assert index.resized > 3 and index.stored == live
    for i in range(900):
        digest = _sha(str(i))
        assert index.find(digest) == live.get(digest)
    assert not index.delete("absent")


def test_changes_delete_digests(spark):
    rows = [("aa" * 32, 5, 2), ("bb" * 32, 9, 1), ("aa" * 32, 3, 1), ("bb" * 32, 9, -1), ("aa" * 32, 3, -1), ("cc" * 32, 1, -1)]
    changes = spark.createDataFrame(rows, "digest string, doc_id long, n long")
    got = exact_dedup.apply_changes(changes, 3).select("digest", "keep_id", "group_size").collect()
    assert [tuple(r) for r in got] == [("aa" * 32, 3, 2)]


# -- fingerprints -----------------------------------------------------------------------


def test_peeling_recovers_the_difference():
    rnd = np.random.default_rng(4)
    sets, pairs = [], []
    for n, m, common in ((0, 0, 0), (1, 0, 0), (3, 2, 10), (40, 60, 500), (700, 1, 3), (0, 0, 50)):
        keys = np.unique(rnd.integers(0, 2**64, n + m + common, dtype=np.uint64))
        sets += [keys[: n + common], np.concatenate([keys[n : n + common], keys[n + common :]])]
        pairs.append((len(sets) - 2, len(sets) - 1))
    left, right, took, _ = fingerprints.differences(sets, pairs)
    for (a, b), x, y in zip(pairs, left, right):
        assert set(x.tolist()) == set(sets[a].tolist()) - set(sets[b].tolist())
        assert set(y.tolist()) == set(sets[b].tolist()) - set(sets[a].tolist())
    assert took[2] == 24 and took[4] > 700  # a larger difference takes a larger table


def test_digests_of_a_text_differ():
    text = "a a a b. a. b. a\n" * 500 + "n. " * 3000
    digests = fingerprints.paragraph_digests(text, words=1)
    assert len(digests) == len(set(digests.tolist())) == len(text.replace(".", " ").split())


def _likeness(a, b):
    a, b = (set(fingerprints.paragraph_digests(t).tolist()) for t in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("table", ["odd", "real"])
def test_fingerprints(spark, table, request):
    docs = request.getfixturevalue(table)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect())
    expected, by_text = Counter(), {}
    for i, (known, doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][2]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        near = round(_likeness(text, changed), 9), round(_likeness(text, following), 9)
        expected[(doc if known else None, len(text), _sha(changed), *near)] += 1
    got = Counter()
    for r in fingerprints.fingerprint_documents(docs).collect():
        got[(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))] += 1
        assert by_text.setdefault(r.edited_sha256, r.edited_fingerprint) == r.edited_fingerprint
        assert len(base64.b64decode(r.fingerprint)) == 24 * 16
    assert got == expected


def test_fingerprints_of_one_or_no_row(spark, none):
    assert fingerprints.fingerprint_documents(none).count() == 0
    (row,) = fingerprints.fingerprint_documents(documents(spark, [(1, "one two three. four")])).collect()
    assert row.near_next == 1.0


# -- near duplicates --------------------------------------------------------------------


def _fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(points, bits):
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    points = sorted(points)
    for i, p in enumerate(points):
        for q in points[i + 1 :]:
            if (p ^ q).bit_count() <= bits:
                parent[max(root(p), root(q))] = min(root(p), root(q))
    return {p: root(p) for p in points}


def _near(rows, bits=4):
    prints = [(d, _fingerprint(t)) for d, t in rows]
    roots = _components({f for _, f in prints}, bits)
    least = {}
    for d, f in prints:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    return Counter((d, f"{f:016x}", least.get(roots[f])) for d, f in prints)


def _edits():
    words = [f"word{i}" for i in range(400)]
    out = []
    for i in range(60):
        own = list(words)
        own[(i * 13) % 400] = f"changed{i}"
        out.append((1000 + i, " ".join(own)))
    return out


def test_near_groups(spark, odd, real, none):
    for docs in (odd, real.limit(120).unionByName(spark.createDataFrame(_edits(), "doc_id long, text string"), True)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert Counter(map(tuple, simhash.near_groups(docs).collect())) == _near(rows)
    assert simhash.near_groups(none).count() == 0


def test_links_of_dense_and_spread_points(spark):
    rnd = np.random.default_rng(5)
    spread = rnd.integers(0, 2**64, 1500, dtype=np.uint64)
    centre = np.uint64(0x123456789ABCDEF0)
    dense = np.array([centre ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rnd.integers(0, 64, (800, 2))], dtype=np.uint64)
    chain = [int(spread[0])]
    for i in range(40):
        chain.append(chain[-1] ^ (0b1111 << (i % 60)))
    points = np.unique(np.concatenate([spread, dense, np.array(chain, dtype=np.uint64)]))
    expected = _components([int(p) for p in points], 4)
    matcher = simhash.Matcher(points, 4)
    old, simhash._BLOCK = simhash._BLOCK, 4096
    matcher.pairs(np.arange(len(points)))
    simhash._BLOCK = old
    roots = matcher.forest.roots(np.arange(len(points)))
    assert {int(p): int(points[r]) for p, r in zip(points, roots)} == expected
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    links = simhash.links_within(frame, 4, share=4)
    sets = _components_of([(r.a % 2**64, r.b % 2**64) for r in links.collect()], expected)
    assert sets == expected


def _components_of(links, points):
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        assert (a ^ b).bit_count() <= 4
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 9), (9, 7), (8, 8)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 700)} | {7: 7, 9: 7}
    assert {r.node: r.root for r in got} == expected and len(got) == len(expected)


# -- shards -----------------------------------------------------------------------------


def _minimax(sizes, shards):
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [
            min([best[j]] + [max(best[i], sum(sizes[i:j])) for i in range(j)]) if j else 0 for j in range(len(sizes) + 1)
        ]
    return best[-1]


def test_smallest_capacity_is_the_best_of_all_partitions():
    rnd = np.random.default_rng(6)
    for _ in range(40):
        sizes = rnd.integers(1, 50, int(rnd.integers(1, 14)))
        if rnd.random() < 0.3:
            sizes[int(rnd.integers(0, len(sizes)))] = 300
        shards = int(rnd.integers(1, 6))
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == _minimax(sizes.tolist(), shards)
        places = [0, *sharding.cut_places(sizes, shards)]
        parts = [int(sizes[a:b].sum()) for a, b in zip(places, places[1:])]
        assert places[-1] == len(sizes) and len(parts) == shards and max(parts) <= capacity


@pytest.mark.parametrize("table", ["odd", "real"])
def test_shards(spark, table, request):
    docs, shards = request.getfixturevalue(table), 6
    rows = sharding.assign_shards(docs, shards).collect()
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    of_text, slots, totals = {}, defaultdict(list), Counter()
    for r in rows:
        assert of_text.setdefault((r["size"], r.text_crc32), r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        totals[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    keys = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("g"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("s"))
    for r in keys.collect():
        groups[r.g] += r.s
    best = sharding.smallest_capacity(np.array([groups[g] for g in sorted(groups)]), shards)
    assert max(totals.values()) <= best


def test_blocks_are_split_until_exact(spark):
    rows = [(i * 3 + 1, 16 + i % 7) for i in range(3000)] + [(5, 4000)] * 2
    sizes = spark.createDataFrame(rows, "group long, size long")
    exact = Counter()
    for g, s in rows:
        exact[g] += s
    best = sharding.smallest_capacity(np.array([exact[g] for g in sorted(exact)]), 7)
    blocks = sharding.group_blocks(sizes, 7, bits=2)
    assert sharding.smallest_capacity(blocks.size, 7) == best and blocks.size.sum() == sum(exact.values())


def test_shards_of_no_row(none):
    assert sharding.assign_shards(none).count() == 0


# -- licences ---------------------------------------------------------------------------


def _scan(text):
    words = re.findall(licenses.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    def places(phrase):
        own = phrase.split()
        return [i for i in range(len(words)) if words[i : i + len(own)] == own]

    found = {label: places(phrase) for phrase, label in licenses.BASE.items()}
    keys = {t[0]: bool(places(t[2])) for t in licenses.TEMPLATES}
    at = sorted(i for own in found.values() for i in own)
    return (
        len(words), len(at), at[0] if at else None, at[-1] if at else None,
        ",".join(sorted(k for k, v in found.items() if v)),
    ), keys


def test_licences(spark, odd, real):
    lines = [
        (101, "x Licensed under the Apache License, Version 2.0."), (102, "apache license version 2 0"),
        (103, "All rights\nreserved. MIT license mit license"), (104, "license mit"), (105, "CC-BY-NC 4.0"),
        (106, "Licensed under CC BY-NC 4.0. ümit license MIT  License"), (107, "gnu general public general public license"),
    ]
    for docs in (odd, real, documents(spark, lines)):
        expected = Counter((r.doc_id, *_scan(r.text)[0]) for r in docs.collect())
        rows = licenses.scan_licenses(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == expected
        for r in rows:
            assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    got = {r.doc_id: (r.labels, r.score) for r in rows}
    assert got[101] == ("apache,apache-2.0", 1.0) and got[103][0] == "mit,reserved" and got[104] == ("", 0.0)
    assert "cc-by-nc" in got[106][0] and got[106][1] == 1.0


# -- quality ----------------------------------------------------------------------------


def test_quality(spark, real, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.score_quality(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    own = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert len(own) > 50 and sum(a == b for a, b in own) >= 0.95 * len(own)
    assert quality.score_quality(odd, labels).count() == len(ODD)
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted)


def test_no_score_depends_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: round(r.score, 6) for r in quality.score_quality(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_whitened_distances_are_log_densities():
    rnd = np.random.default_rng(8)
    x, mean = rnd.normal(size=(5, 3)), rnd.normal(size=3)
    root = rnd.normal(size=(3, 3))
    spread = root @ root.T + np.eye(3)
    factor = np.linalg.cholesky(spread)
    model = quality.Discriminant(
        np.array([mean, mean + 1]), np.array([np.linalg.inv(factor)] * 2), np.array([-np.log(np.diag(factor)).sum()] * 2)
    )

    def log_density(m):
        off = x - m
        return -0.5 * (np.einsum("ij,jk,ik->i", off, np.linalg.inv(spread), off) + np.linalg.slogdet(spread)[1])

    assert np.allclose(model.scores(x), 1 / (1 + np.exp(log_density(mean) - log_density(mean + 1))))
