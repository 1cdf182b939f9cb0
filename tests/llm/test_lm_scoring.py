import math
import random

from glyphwalk.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, score string"


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = ["the", "tion", "ébène", "a", "in", "stand", "Zed"]
    return [(i, "".join(r.choice(words) + r.choice([" ", "\n"]) for _ in range(r.randint(0, 30)))) for i in range(n)]


def brute(rows):
    trie, counts = lm.Trie(), {}
    train = [t for i, t in rows if not lm.held_out(i)]
    for t in train:
        trie.train(t)
        for w in [*(t or "").encode().lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        toks = [*(t or "").encode().lower().split(), None]
        out.setdefault(i, []).append((len(toks), sum(w in counts for w in toks), n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in toks), trie.score(t)))
    return out


def check(spark, rows, **args):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = lm.score_texts(df, **args).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == lm.held_out(r["doc_id"])
        assert any(
            (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and abs(r["base_score"] - w[3]) < 1e-6 and abs(r["score"] - w[4]) < 1e-6
            for w in want[r["doc_id"]]
        ), (r, want[r["doc_id"]])


def test_equals_plain_trie_with_many_blocks(spark):
    check(spark, corpus(), block_bytes=300)


def test_null_empty_repeated_and_long_texts(spark):
    check(spark, [(1, None), (2, ""), (3, "a" * 5000), (3, "a" * 5000), (None, "b"), (4, "  \n ")])


def test_empty_table(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distribution_sums_to_one():
    trie = lm.Trie(2)
    for _, t in corpus(8):
        trie.train(t)
    for context in (b"th", b"\xfe\xfe", b"qq", b"io"):
        total = sum(10 ** trie.log10(context, s) for s in range(256) if s != lm.START)
        assert abs(total - 1) < 1e-9


def test_held_out_texts_score_above_their_reverse():
    # Words drawn independently are what the unigram base assumes, so the base is no yardstick here.
    rows, trie = corpus(400, 5), lm.Trie()
    for i, t in rows:
        if not lm.held_out(i):
            trie.train(t)
    held = [t for i, t in rows if lm.held_out(i) and len(t) > 40]
    assert held and all(trie.score(t) > trie.score(t[::-1]) for t in held)


def test_adaptive_learns(spark):
    df = spark.createDataFrame([(1, "abcabcabc" * 20)], "doc_id long, text string")
    adaptive = lm.adaptive_scores(df).first()["score"]
    assert adaptive > lm.Trie().score("abcabcabc" * 20)
