"""What the packer holds where no two documents fit together."""

from collections import defaultdict

import numpy as np

from causeway.llm import packing


def test_open_windows_hold_bounded_bytes():
    packer, most, rows = packing.Packer(held_bytes=1 << 20), 0, []
    for doc in range(3000):
        packer.add(doc, np.full(1100, doc, dtype="<u4"))
        most = max(most, sum(p[2].nbytes for level in packer.open for w in level for p in w[1]))
        rows += packer.rows()
    assert most <= 1 << 20
    packer.finish()
    rows += packer.rows()
    sequences, docs = defaultdict(list), defaultdict(list)
    for doc, start, length, _, total, sequence, offset in rows:
        assert total == 1100
        sequences[sequence].append((offset, length))
        docs[doc].append((start, length))
    assert len(docs) == 3000
    for pieces in (*sequences.values(), *docs.values()):
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
    assert all(sum(n for _, n in x) <= 2048 for x in sequences.values())
    assert all(sum(n for _, n in x) == 1100 for x in docs.values())


def _padding(lengths, held_bytes):
    packer = packing.Packer(held_bytes=held_bytes)
    for doc, n in enumerate(lengths):
        packer.add(doc, np.full(n, doc, dtype="<u4"))
    packer.finish()
    filled = defaultdict(int)
    for _, _, length, _, _, sequence, _ in packer.rows():
        filled[sequence] += length
    assert sum(filled.values()) == sum(lengths)
    return sum(2048 - n for n in filled.values() if n & (n - 1)) / sum(lengths)


def test_padding_stays_low_however_little_is_held():
    rnd = np.random.default_rng(2)
    for lengths in (rnd.lognormal(6, 1, 4000).astype(int) + 1, np.full(4000, 1100), rnd.integers(1025, 2048, 3000)):
        pads = [_padding(lengths.tolist(), held) for held in (1 << 40, 8 << 20, 1 << 20, 1 << 16)]
        assert max(pads) < 0.02, pads


def _brute_levels(lengths, capacity=2048, levels=64):
    """The windows that each document shares, trying every level and adding up the squares anew."""
    step, windows, out = capacity // levels, [], []
    for doc, size in enumerate(lengths):
        counts = np.zeros(levels + 1, dtype=int)
        for fill, _ in windows:
            counts[-(-fill // step)] += 1
        best = None
        for level in range((capacity - size) // step + 1):
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            there = min(level + -(-size // step), levels)
            if there < levels:
                after[there] += 1
            cost = int((after[1:levels] ** 2).sum())
            if best is None or cost <= best[0]:
                best = (cost, level)
        at = next((w for w in reversed(windows) if -(-w[0] // step) == best[1]), None) if best[1] else None
        if at is None:
            at = [0, []]
        else:
            windows.remove(at)
        at[0] += size
        at[1].append(doc)
        out.append(at)
        if capacity - at[0] >= step:
            windows.append(at)
    return {frozenset(w[1]) for w in out if capacity - w[0] < step}


def test_placement_equals_sums_of_squares_tried_out():
    rnd = np.random.default_rng(9)
    lengths = np.minimum(rnd.lognormal(5.5, 1, 400).astype(int) + 1, 2000).tolist()
    packer = packing.Packer()
    for doc, n in enumerate(lengths):
        packer.add(doc, np.full(n, doc, dtype="<u4"))
    closed = defaultdict(set)
    for doc, _, _, _, _, sequence, _ in packer.rows():
        closed[sequence].add(doc)
    assert {frozenset(x) for x in closed.values()} == _brute_levels(lengths) and len(closed) > 20
