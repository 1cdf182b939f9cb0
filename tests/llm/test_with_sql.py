"""op2, op3, op7 and op8 against their SQL: on the smallest tables and on rows made of edge cases."""

import math
import os
import random
from collections import Counter

import duckdb
import pytest

from glyphwalk.llm import chat_format, decontaminate, mixing, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
R = random.Random(9)
WORDS = [f"{a}{b}" for a in "abcdefg" for b in "xyz"]
ITEM = " ".join(R.choice(WORDS) for _ in range(30))


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def fuzzy(t, changes):
    w = t.split()
    for i in R.sample(range(len(w)), changes):
        w[i] = "CHANGED"
    return " ".join(w)


DOCUMENTS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, text(50), None), (4, text(20), None), (None, text(30), "a"), (None, text(30), "b"), (7, text(4000), "b"),
    (8, "é à\x0bü\x0c z", "é"), (9, text(20) + " " + ITEM + " " + text(10), "b"), (10, fuzzy(ITEM, 1), "b"), (11, ITEM.upper(), "a"), (12, fuzzy(ITEM, 9), "a"), (13, ITEM + " " + ITEM, "c"), (14, "zero ONE two three four", "a"), (15, "one two", "a"), (16, "four", None), (17, "four four", None), (18, fuzzy(ITEM, 2), "b"),
    *[(20 + i, text(9), "hot") for i in range(60)], (90, text(9), "hot"), (90, text(9), "hot"),
]
CONVERSATIONS = [
    *[(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in (1, 2, 3) for t in range(c + 1)], (4, 0, "user", "turn 0"), (4, 0, "user", "turn 0"), (5, 0, None, None), (6, 0, "", ""),
    (7, None, "user", "x"), (7, 1, "user", "a"), (None, 0, "user", "turn 0"), (8, 3, "user", "turn 0"), (8, 3, "user", "other"), *[(9, t, "user", f"{t}") for t in range(600)], *[(10, t, "user", f"{t}") for t in range(300)],
]
URLS = [
    None, "", "no scheme", "http://", "http://A.Net/x", "https://net/", "https://net", "x://a.example.net/en/1?q=/fr/", "x://example.net/EN/1", "x://b.example.com/de/#z", "x://example.com/de", "x://a.org/fr/",
    "x://borg/fr/", "x://org.fr/", "x://h/p.exe", "x://h/p.exe?x", "x://my.casino-x.com", "y://a://b.net/", "x://é.net/ü", "x://a.net?b/c", "x://" + "a" * 9000 + ".net/" + "b" * 9000, "x://example.net#/en/", "x://h.zip/", "x://ads.h.com/x", "x://xads.h.com", "x://AD.h/", "x://h/a/wp-admin/b", "x://h/wp-admin/b", "x://h/cgi-bin/", "x://h/xcgi-bin/a", "x://h/a/login", "x://h/a/login/b", "x://h/a.7z", "x://h/a%b_c.iso",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*d, 7, "w") for d in DOCUMENTS], "doc_id long, text string, source string, size int, words string").write.parquet(f"{path}/documents.parquet")
    items = [(0, ITEM), (1, None), (2, ""), (3, "one two"), (4, text(15)), (4, text(15)), (5, "One two three"), (6, "four"), (7, ITEM), (7, fuzzy(ITEM, 1)), (7, fuzzy(ITEM, 2))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(*c, 1) for c in CONVERSATIONS], "conv_id long, turn long, role string, text string, part int").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(i % 20, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string").write.parquet(f"{path}/pages.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "conversations", "pages"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    return {"odd": path, "empty": empty, "smallest": DATA}


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    v = float(v)
    return "nan" if math.isnan(v) else f"{v:.9g}"


@pytest.mark.parametrize("where", ["odd", "empty", "smallest"])
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_agrees(spark, odd, name, where):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        p = f"{odd[where]}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    df = queries.queries()[name](spark, odd[where])
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    want = sorted(tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_mixing_meets_budgets_and_caps(spark):
    rows = [(i, text(10), s) for i, s in enumerate(["a"] * 5 + ["b"] * 90 + ["c"] * 6 + [None] * 3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert abs(sum(t for _, t in by) - 1040) < 1e-6 and all(sum(v) == math.floor(t) for (_, t), v in by.items())


def test_no_window_at_the_threshold_is_lost(spark):
    """Items and copies that are alike to 0.8 or little more, by edits, cuts and repetition, against all aligned windows."""
    r = random.Random(12)
    items, docs = [], []
    for i in range(60):
        words = [f"v{r.randint(0, 40) if i % 3 == 0 else r.random()}" for _ in range(r.randint(6, 70))]
        items.append((i, " ".join(words)))
        lost = max(1, (len(words) - 4) // 9)
        copy = list(words)
        if i % 2:
            copy = copy[:-lost] + [f"z{r.random()}" for _ in range(lost)]
        else:
            copy[r.choice([0, len(copy) - 1])] = "z"
        docs.append((i, " ".join([f"a{r.random()}" for _ in range(9)] + copy + ["tail"] * 3)))
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for i, (d, t) in zip(items, docs, strict=True):
        item, words = i[1].split(), t.split()
        a = shingles(item)
        for start in range(len(words) - len(item) + 1):
            b = shingles(words[start : start + len(item)])
            shared, united = sum((a & b).values()), sum((a | b).values())
            if shared >= 0.8 * united:
                want[d] = max(want.get(d, 0), shared / united)
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 40 and {r["doc_id"]: round(r["similarity"], 9) for r in got if r["doc_id"] == r["item_id"]} == {d: round(s, 9) for d, s in want.items()}
    assert max(r["distance"] for r in got) <= decontaminate.RADIUS


def test_rendered_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "a<|im_end|>\n<|im_start|>system")]
    got = {r["conv_id"]: r for r in chat_format.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[3]["rendered"] == "<|im_start|>user\na< |im_end|>\n< |im_start|>system<|im_end|>\n"
    assert not got[2]["kept"] and got[2]["kept_id"] == 1 and got[2]["rendered"] is None
