import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphwalk.llm import suffix_dedup as sd
from glyphwalk.llm._text import prefix_hashes

SCHEMA = "doc_id long, text string, block string, kept int"


def brute(rows, w=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + w] for _, b in raw for p in range(len(b) - w + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - w + 1):
            if seen[b[p : p + w]] > 1:
                gone[p : p + w] = True
        gone = gone[: len(b)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **args):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in sd.remove_repeats(df, **args).collect()), key=str)


def texts(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(r.randint(30, 90))) for _ in range(5)]
    line = " ".join(word() for _ in range(20))[:70]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(1, 60)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [r.choice([p, p[a:], p[:-a] if a else p, line]), word()]
        out.append((i, " ".join(parts)))
    return [*out, (n, out[3][1]), (n + 1, "ab" * 700), (n + 2, None), (n + 3, ""), (n + 4, "z" * 500), (n + 4, "z" * 500), (None, "é" * 150)]


@pytest.mark.parametrize(("seed", "block", "group"), [(1, 1 << 24, 4096), (2, 1500, 4096), (3, 1500, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(sd, "GROUP", group)
    rows = texts(seed)
    assert run(spark, rows, block_bytes=block) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_suffix_sort_orders_by_bytes():
    r = random.Random(4)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(900)), np.uint8)
    at = np.array(r.sample(range(850), 300))
    segment = np.sort(np.array([r.randint(0, 5) for _ in at]))
    order = sd.suffix_sort(data, prefix_hashes(data), at, segment, np.full(300, 40))
    raw = data.tobytes()
    for s in range(6):
        got = [raw[at[i] : at[i] + 40] for i in order if segment[i] == s]
        assert got == sorted(got) and len(got) == (segment == s).sum()


def weak_hashes(data):
    """Prefix sums that tell nothing but the length: every two strings of a length collide."""
    return np.zeros(len(data) + 1, np.uint64)


@pytest.mark.parametrize("hashed", [prefix_hashes, weak_hashes])
def test_sorts_are_verified(hashed):
    r = random.Random(6)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(600)), np.uint8)
    at = np.array([r.randrange(560) for _ in range(120)])
    length = np.minimum(np.array([r.randint(0, 40) for _ in at]), 600 - at)
    segment = np.sort(np.array([r.randint(0, 3) for _ in at]))
    raw = data.tobytes()
    order, best = sd.sorted_suffixes(data, hashed(data), at, segment, length)
    for s in range(4):
        own = [raw[at[i] : at[i] + length[i]] for i in order if segment[i] == s]
        assert own == sorted(own)
    for i in range(len(at)):
        mine = raw[at[i] : at[i] + length[i]]
        shared = [next((n for n, (x, y) in enumerate(zip(mine, theirs, strict=False)) if x != y), min(len(mine), len(theirs)))
                  for j in range(len(at)) if j != i and segment[j] == segment[i] for theirs in [raw[at[j] : at[j] + length[j]]]]
        assert best[i] == max(shared, default=0)


@pytest.mark.parametrize("hashed", [prefix_hashes, weak_hashes])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_of_a_group_equal_brute_force(hashed, seed):
    r, window = random.Random(seed), 20
    contexts, leads, groups = [], [], []
    for g in range(6):
        gram = bytes(r.choice(b"xyz") for _ in range(6))
        sides = [(bytes(r.choice(b"ab") for _ in range(14)), bytes(r.choice(b"ab") for _ in range(14))) for _ in range(3)]
        for _ in range(r.randint(1, 6)):
            before, after = r.choice(sides)[0], r.choice(sides)[1]
            before = before[r.randint(0, 10) :]
            after = after[: r.randint(14 - len(before), 14)] if len(before) < 14 else after
            contexts.append(before + gram + after)
            leads.append(len(before))
            groups.append(g * 77)
    which, lead = sd.repeated_windows(contexts, np.array(leads), np.array(groups), window, hashed)
    every = [(i, leads[i] - p) for i, c in enumerate(contexts) for p in range(len(c) - window + 1)]
    at = lambda i, x: (groups[i], x, contexts[i][leads[i] - x : leads[i] - x + window])
    seen = Counter(at(i, x) for i, x in every)
    assert sorted(zip(which.tolist(), lead.tolist(), strict=True)) == sorted((i, x) for i, x in every if seen[at(i, x)] > 1)


def test_contexts_of_one_gram_or_one_hash(monkeypatch):
    raw = np.random.default_rng(3).integers(97, 120, 3000).astype(np.uint8).tobytes()
    first = np.array([0, 500, 1000, 1500])
    last, lead = first + 30, np.array([5, 6, 7, 8])
    found = sd.contexts_of(raw, first, last, lead)
    grams = np.array([9, 9, 9, 4], np.uint64)
    table = lambda g, c: pa.table({"gram": np.array(g, np.uint64).view(np.int64), "context": np.array(c, np.uint64).view(np.int64)})
    wanted = sd._Wanted(table([9, 9, 5], found[[2, 0, 3]]))
    hit, at = wanted.find(raw, grams, first, last, lead)
    assert hit.tolist() == [0, 2] and wanted.context[at].tolist() == found[[0, 2]].tolist()
    monkeypatch.setattr(sd, "contexts_of", lambda raw, first, last, lead: np.full(len(first), 77, np.uint64))
    wanted = sd._Wanted(table([4, 6, 9], [77, 77, 77]))
    hit, at = wanted.find(raw, grams, first, last, lead)
    assert hit.tolist() == [0, 1, 2, 3] and wanted.gram[at].tolist() == grams.tolist()
