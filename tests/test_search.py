import math
import os
import random

import pytest
from pyspark.sql import functions as F

from glyphwalk import engine
from glyphwalk.catalog import searches
from glyphwalk.operators.language_model import BOS, EOS, LanguageModel, character_pairs, ngram_counts
from glyphwalk.operators.search import compile_query
from glyphwalk.operators.vocabulary import Vocabulary, lift_edges, to_bytes, tokenizations
from glyphwalk.plans.automaton import Automaton, Infinite
from glyphwalk.plans.query import Order, PatternQuery, Preprocessing, SearchOptions, Text, Tokens

THE = Vocabulary({"the": 1169, "t": 83, "h": 71, "e": 68, "th": 400, "he": 258}, eos=5)


@pytest.fixture(scope="module", params=[True, False], ids=["in process", "frontier tables"])
def toy(spark, request):
    """An order-1 model over a, b, c and the end mark, and its rows by context."""
    r, rows = random.Random(4), []
    for c in (BOS, 97, 98, 99):
        w = [r.random() for _ in range(4)]
        if c == 98:
            w[1] = 0
        rows += [([c], t, x / sum(w)) for t, x in zip((97, 98, 99, EOS), w, strict=True) if x]
    table = {}
    for c, t, p in rows:
        table.setdefault(c[0], {})[t] = p
    vocabulary = Vocabulary.characters("abc")
    return engine.Engine(LanguageModel.of_rows(spark, rows, vocabulary=vocabulary).settled(), request.param), table


def brute(table, query, max_len):
    """All answers (tokens, cost) by walking every path with the policy applied to whole rows."""
    plan = compile_query(query, Vocabulary.characters("abc"))
    o, out = plan.options, []

    def policy(context, pstate):
        p = table.get(context, {})
        top = sorted(p, key=lambda t: (-p[t], t))[: o.top_k] if o.top_k else list(p)
        allowed = [x for lo, hi, _ in plan.prefix.arcs[pstate] for x in range(lo, hi + 1)] if plan.prefix and pstate is not None else []
        q = {t: p[t] for t in top}
        for t in allowed:
            q[t] = p.get(t, 0.0) if o.penalize_prefix else 1.0
        if o.stay_in_prefix and allowed:
            q = {t: x for t, x in q.items() if t in allowed}
        z = sum(q.values())
        cost = {t: -math.log(x / z) for t, x in q.items() if x > 0}
        if o.top_k and not o.penalize_prefix:
            cost |= dict.fromkeys(allowed, 0.0)
        return cost

    def walk(state, pstate, context, tokens, cost):
        if state in plan.automaton.finals:
            out.append((tokens, cost))
        if len(tokens) == min(max_len, plan.max_len):
            return
        for t, c in policy(context, pstate).items():
            if (to := plan.automaton.step(state, t)) is not None:
                after = plan.prefix.step(pstate, t) if plan.prefix and pstate is not None else None
                total = max(cost, c) if o.aggregation == "max" else cost + c
                walk(to, after, t, [*tokens, t], round(total, 9))

    walk(0, 0 if plan.prefix else None, BOS, [], 0.0)
    return sorted(out, key=lambda x: (x[1], x[0]))


QUERIES = {
    "finite": PatternQuery(Text("(a|b)c?(ab|c)"), limit=5),
    "empty answer": PatternQuery(Text("(a|b)?"), limit=5),
    "cyclic": PatternQuery(Text("[abc]+"), limit=6, max_len=4),
    "top k": PatternQuery(Text("(a|b|c){1,3}"), limit=8, top_k=2),
    "prefix": PatternQuery(Text("ab(a|b|c){1,2}", prefix="ab"), limit=8, top_k=1),
    "prefix, all of it": PatternQuery(Text("a(b|c)", prefix="a(b|c)"), limit=3, top_k=1),
    "end": PatternQuery(Text("a[abc]{0,2}", end=True), limit=4),
    "excluded": PatternQuery(Text("[abc]{1,2}"), limit=4, preprocessing=Preprocessing(exclude="a.?|b")),
    "stays": PatternQuery(Text("(ab|b)[abc]", prefix="ab|b"), tokens=Tokens.PREFIX_CANONICAL, limit=9, top_k=2),
    "nothing": PatternQuery(Text("[^a-z]"), limit=3),
}


def close(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-7 for g, w in zip(got, want, strict=True))


def test_likeliest_answers_equal_brute_force(toy):
    eng, table = toy
    rows = eng.search(QUERIES).collect()
    for name, q in QUERIES.items():
        got = sorted((r["rank"], list(r["tokens"]), r["cost"]) for r in rows if r["query_id"] == name)
        close([(t, c) for _, t, c in got], brute(table, q, 9)[: q.limit])
    for r in rows:
        assert r["text"] == "".join(chr(t) for t in r["tokens"] if t != EOS)


@pytest.mark.parametrize("options", [
    {"order": Order.LIKELIEST, "aggregation": "max", "limit": 6},
    {"order": Order.LIKELIEST, "prefix": "a", "limit": 6},
    {"order": Order.LIKELIEST, "prefix": "a", "top_k": 1, "limit": 6},
    {"order": Order.LIKELIEST, "prefix": "[ab]", "stay_in_prefix": True, "limit": 6},
])
def test_low_level_options(toy, options):
    eng, table = toy
    o = SearchOptions(pattern="[abc]{1,3}", **options)
    with pytest.warns(UserWarning):
        from glyphwalk.plans.query import as_options

        as_options(o)
    got = [(list(r["tokens"]), r["cost"]) for r in eng.search(o).orderBy("rank").collect()]
    close(got, brute(table, o, 3)[:6])


def test_beam_greedy_and_enumeration(toy):
    eng, table = toy
    full = brute(table, SearchOptions(pattern="[abc]{2}", order=Order.LIKELIEST, limit=None), 2)
    wide = eng.search(SearchOptions(pattern="[abc]{2}", order=Order.BEAM, beam=99, limit=3)).orderBy("rank").collect()
    close([(list(r["tokens"]), r["cost"]) for r in wide], full[:3])
    best = eng.search(SearchOptions(pattern="[abc]{3}", order=Order.GREEDY, limit=1)).collect()[0]
    at, path = BOS, []
    for _ in range(3):
        at = min((t for t in table[at] if t != EOS), key=lambda t: (-table[at][t], t))
        path.append(at)
    assert list(best["tokens"]) == path
    texts = [r["text"] for r in eng.search(SearchOptions(pattern="a|ab|abc|c", limit=3)).orderBy("rank").collect()]
    assert texts == ["a", "c", "ab"]
    k1 = {r["text"] for r in eng.search(SearchOptions(pattern="[abc]", limit=None, top_k=1)).collect()}
    likeliest = min(table[BOS], key=lambda t: (-table[BOS][t], t))
    assert k1 == ({chr(likeliest)} if likeliest != EOS else set())
    assert {r["text"] for r in eng.search(SearchOptions(pattern="[abc]", prefix="c", limit=None, top_k=1)).collect()} >= {"c"}


def test_samples_follow_the_model(toy):
    eng, table = toy
    q = PatternQuery(Text("a|b"), order=Order.RANDOM, limit=400, seed=3)
    rows = eng.search(q).collect()
    assert len(rows) == 400 and {r["text"] for r in rows} <= {"a", "b"}
    # First step by p(a), p(b) (a walk that can't end would restart; both can).
    share = table[BOS][97] / (table[BOS][97] + table[BOS][98])
    n = sum(r["text"] == "a" for r in rows)
    chi2 = (n - 400 * share) ** 2 / (400 * share) + (n - 400 * share) ** 2 / (400 * (1 - share))
    assert chi2 < 12
    assert sorted(map(tuple, rows)) == sorted(map(tuple, eng.search(q).collect()))
    even = eng.search(PatternQuery(Text("(a|bb|bc|ba)", prefix="(a|bb|bc|ba)"), order=Order.RANDOM, limit=400)).collect()
    counts = [sum(r["text"] == t for r in even) for t in ("a", "bb", "bc", "ba")]
    assert sum(counts) == 400 and sum((c - 100) ** 2 / 100 for c in counts) < 18


def test_vocabulary_golden(spark):
    assert set(THE.encodings("the")) == {(1169,), (83, 258), (400, 68), (83, 71, 68)} and set(THE.encodings("he")) == {(258,), (71, 68)}
    assert THE.canonical("the") == (1169,) and list(THE.encodings("thx")) == [] and THE.decode([83, 258, 5]) == "the"
    assert set(THE.lift(Automaton.of_pattern("the")).strings()) == set(THE.encodings("the"))
    assert set(THE.lift_canonical(Automaton.of_pattern("t?he")).strings()) == {(1169,), (258,)}
    with pytest.raises(Infinite):
        THE.lift_canonical(Automaton.of_pattern("t*"))
    got = tokenizations(spark.createDataFrame([("the",), ("he",), ("",), (None,), ("xx",)], "text string"), THE.frame(spark)).collect()
    assert {(r["text"], tuple(r["tokens"])) for r in got} == {(t, e) for t in ("the", "he", "") for e in THE.encodings(t)}
    a = Automaton.of_pattern("(the|he)*t?")
    lifted = {tuple(r) for r in lift_edges(a.edges(spark), THE.frame(spark)).collect()}
    assert {(s, t) for s, t, _ in lifted} == {(s, t) for s in range(len(a.arcs)) for p, t in THE.ids.items() if a.run(p, s) is not None}
    sentence = Vocabulary({"a": 1, " b": 2, "a ": 3, "b": 4, " ": 5})
    assert set(sentence.sentence_encodings("a b")) == {(1, 2), (1, 5, 4)} and (3, 4) in set(sentence.encodings("a b"))


def test_byte_level_vocabulary():
    import importlib.util
    import os

    folder = os.environ.get("TOKENIZERS", "/opt/tokenizers")
    path = f"{folder}/byte_bpe_50k.tiktoken"
    if not os.path.exists(path) or importlib.util.find_spec("tiktoken") is None:
        pytest.skip("no public vocabulary here")
    v = Vocabulary.from_tiktoken(path, eos=50256)
    assert set(v.encodings("the")) >= {(1169,), (83, 258), (400, 68), (83, 71, 68)} and v.canonical("the") == (1169,)
    assert set(v.encodings("π")) == {(139, 222), (46582,)}
    assert v.decode(v.canonical("Grüße, 世界 🙂")) == "Grüße, 世界 🙂"
    assert set(v.lift(Automaton.of_pattern("the|π")).strings()) == set(v.encodings("the")) | set(v.encodings("π"))


def test_utf8_automaton():
    for pattern, yes, no in ((".", "aéπ世🙂\r", "\n"), ("[é-世]{1,2}", "éπ", "a"), (r"[\x{7f}-\x{800}]", "\x7fࠀ߿", "ࠁ~"), (r"[\x{ff00}-\x{10ffff}]", "！🙂\U0010ffff", "世")):
        b = to_bytes(Automaton.of_pattern(pattern))
        assert all(b.accepts(list(c.encode())) for c in yes) and not any(b.accepts(list(c.encode())) for c in no)
        assert not b.accepts([0xC0, 0x80])


def test_canonical_search_and_dynamic_check(spark):
    vocabulary = Vocabulary({"a": 0, "b": 1, "ab": 2}, eos=9)
    model = LanguageModel.of_rows(spark, [([], t, p) for t, p in ((0, 0.4), (1, 0.4), (2, 0.15), (9, 0.05))], order=0, eos=9, vocabulary=vocabulary)
    eng = engine.prepare(model)
    every = [tuple(r["tokens"]) for r in eng.search(PatternQuery(Text("ab"), limit=9)).orderBy("rank").collect()]
    assert every == [(0, 1), (2,)] or every == [(2,), (0, 1)]
    for q in (PatternQuery(Text("ab"), tokens=Tokens.CANONICAL, limit=9), SearchOptions(pattern="ab", order=Order.LIKELIEST, dynamic_canonical=True, limit=9)):
        assert [tuple(r["tokens"]) for r in eng.search(q).collect()] == [(2,)]
    assert [tuple(r["tokens"]) for r in eng.search(SearchOptions(pattern="ab", tokens=Tokens.CHARACTERS, order=Order.LIKELIEST, limit=3)).collect()] == [(0, 1)]


def test_options_are_checked():
    with pytest.raises(AttributeError):
        SearchOptions(pattern="a").nonsense = 1
    with pytest.raises(ValueError):
        SearchOptions()
    low = PatternQuery(Text("a"), order=Order.RANDOM).lower()
    assert low.end and not low.penalize_prefix and low.directed and not SearchOptions(pattern="a").directed
    assert PatternQuery(Text("a")).lower().penalize_prefix and PatternQuery(Text("a"), tokens=Tokens.PREFIX_CANONICAL).lower().stay_in_prefix


def test_model_reshaping_and_scores(spark):
    model = LanguageModel.of_rows(spark, [([BOS], 1, 0.5), ([BOS], 2, 0.3), ([BOS], 3, 0.2), ([1], 2, 1.0)])
    rows = lambda m: {(r["context"][0], r["token"]): (round(r["p"], 6), r["rank"]) for r in m.rows.collect()}
    assert rows(model)[BOS, 2] == (0.3, 2)
    assert rows(model.top_k(2)) == {(BOS, 1): (0.625, 1), (BOS, 2): (0.375, 2), (1, 2): (1.0, 1)}
    assert rows(model.top_p(0.6))[BOS, 2] == (0.375, 2) and (BOS, 3) not in rows(model.top_p(0.6))
    assert rows(model.temper(0.5))[BOS, 1] == (round(0.25 / 0.38, 6), 1)
    seqs = spark.createDataFrame([(1, [1, 2]), (2, [3, 2])], "id int, tokens array<int>")
    got = {r["id"]: r for r in model.sequence_scores(seqs).collect()}
    assert abs(got[1]["log_p"] - math.log(0.5)) < 1e-9 and abs(got[1]["perplexity"] - 0.5**-0.5) < 1e-9 and got[2]["log_p"] is None
    assert {r["id"]: r["possible"] for r in model.can_generate(seqs, 1).collect()} == {1: True, 2: False}
    assert all(list(r["tokens"]) in ([1, 2], [2], [3]) for r in model.sample(spark, 20, 2).collect())
    scored = LanguageModel.from_scorer(spark.createDataFrame([([0],), ([1],)], "context array<int>"), lambda c: [[0.25, 0.75]] * len(c), 1)
    assert rows(scored)[0, 1] == (0.75, 1)
    second = LanguageModel.of_characters(spark.createDataFrame([("abab",), (None,), ("",)], "text string"), order=2, eos=EOS)
    assert {(tuple(r["context"]), r["token"]): r["p"] for r in second.rows.collect()}[(97, 98), 97] == 0.5


def test_character_pairs_by_words(spark):
    docs = spark.createDataFrame([("a bc  d",), (" x ",), ("",), (None,), (" ",), ("é🙂 b\nb",)], "text string")
    tokens = docs.select(F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c)).alias("tokens"))
    plain = lambda df: sorted((r["context"][0], r["token"], r["n"]) for r in df.collect())
    for eos in (None, EOS):
        assert plain(character_pairs(docs, "text", eos=eos)) == plain(ngram_counts(tokens, eos=eos))


@pytest.mark.skipif(not os.path.exists(searches.BPE), reason="no vocabulary file here")
def test_byte_level_bpe(spark):
    vocabulary, texts = searches.bpe_vocabulary(), [" the", " then", " thing", " nation", " é"]
    learned = {r["token"]: r["p"] for r in searches.bpe_model(spark.createDataFrame([(" the thing the",), (None,)], "text string")).rows.collect()}
    assert {vocabulary.decode([t]): round(p, 9) for t, p in learned.items()} == {" the": round(2 / 3, 9), " thing": round(1 / 3, 9)}
    ways = {x: list(map(tuple, vocabulary.encodings(x))) for x in texts}
    r = random.Random(5)
    weight = {t: r.random() for t in sorted({t for es in ways.values() for e in es for t in e}) if r.random() < 0.8}
    p = {t: w / sum(weight.values()) for t, w in weight.items()}
    model = LanguageModel.of_rows(spark, [([], t, q) for t, q in p.items()], 0, eos=vocabulary.eos, vocabulary=vocabulary)
    want = sorted((round(sum(-math.log(p[t]) for t in e), 6), e) for es in ways.values() for e in es if all(t in p for t in e))
    assert len(want) > 20
    for in_process in (True, False):
        found = engine.Engine(model.settled(), in_process).search(PatternQuery(Text(" (the|then|thing|nation|é)"), limit=1000))
        assert sorted((round(r["cost"], 6), tuple(r["tokens"])) for r in found.collect()) == want
        assert {r["text"] for r in found.collect()} <= set(texts)


def test_what_is_known_before_a_search():
    plan = compile_query(PatternQuery(Text("t(h|he)?e?")), THE)
    known = plan.stats()
    assert known["cardinality"] == plan.automaton.cardinality() and known["bytes"] == 4 * known["cardinality"] * plan.max_len
    assert len(known["sample"]) == 10 and set(known["sample"]) <= set(plan.automaton.strings())
    with pytest.warns(UserWarning, match="infinite"):
        assert compile_query(PatternQuery(Text("t+")), THE).stats()["bytes"] is None
