import random

import pytest

from glyphwalk.llm import chosen_path as cp

SCHEMA = "doc_id long, text string, component_id long, rep string"


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k=3, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows, **args):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in cp.components(df, **args).collect())


def near_copies(seed, groups=12):
    r, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([5, 40, 120]))]
        for _ in range(r.randint(1, 9)):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(["Zz", "W1", "new"])
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    assert run(spark, rows) == brute(rows)


def test_branching_of_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(cp, "NODE_SETS", 4)
    rows = near_copies(3, 6)
    assert run(spark, rows, k=5, percent=80) == brute(rows, 5, 80)


def templated(seed, n, pairs):
    """Pages of one template that are alike to about 0.7, a few of them with a near copy."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"own{i}_{x}" for x in range(14)]
        page = [f"t{x}" for x in range(90)] + own + [f"s{x}" for x in range(10)]
        rows.append((2 * i, " ".join(page)))
        if i < pairs:
            page[r.randrange(95, 100)] = "Zz"
            rows.append((2 * i + 1, " ".join(page)))
    return rows


@pytest.mark.parametrize("last", [4, 6])
def test_large_nodes_of_unlinked_sets(spark, monkeypatch, last):
    monkeypatch.setattr(cp, "NODE_SETS", 8)
    monkeypatch.setattr(cp, "MAX_DEPTH", last)
    rows = templated(5, 24, 8)
    want = brute(rows)
    assert run(spark, rows) == want and len({c for _, _, c, _ in want}) == 24


def test_recall_at_every_depth():
    for j in (0.80, 0.85):
        assert min(cp.survival(j, d) for d in range(cp.DEPTH, cp.MAX_DEPTH + 1, 2)) > 0.9998


def test_ids_with_several_texts(spark):
    rows = []
    for i in range(20):
        for version in "ab":
            words = [f"{version}{i}_{x}" for x in range(60)]
            rows.append((i, " ".join(words)))
            words[59] = "other"
            rows.append((100 + 2 * i + (version == "b"), " ".join(words)))
    want = {100 + n: n // 2 for n in range(40)} | {i: i for i in range(20)}
    got = run(spark, rows)
    assert len(got) == 80 and all(c == want[d] for d, _, c, _ in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "x " * 3000), (6, "x " * 3000), (7, "é")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_null_ids(spark):
    got = cp.components(spark.createDataFrame([(None, "a b c d", 1, ""), (3, "a b c d", 1, ""), (None, "q r s t", 1, "")], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 3, False), (3, 3, True)]


def test_two_sets_are_compared_whatever_their_size(spark, monkeypatch):
    monkeypatch.setattr(cp, "NODE_SHINGLES", 10)
    rows = []
    for g in range(12):
        words = [f"w{g}_{i}" for i in range(200)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join("Zz" if i % 40 == 20 else w for i, w in enumerate(words)))]
    assert run(spark, rows) == brute(rows)
