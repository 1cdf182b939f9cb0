"""Each stage of the corpus pipeline against a brute-force version on planted documents."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n, tag=""):
    return " ".join(f"{tag}{r.choice('abcdefghij')}{r.randint(0, 3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = random.Random(5)
    docs, labels, expect = [], [], {"near": set(), "passage": {}, "leak": set(), "toxic": set()}

    def add(text, source=None):
        docs.append((len(docs), text, "en", source or r.choice(["s0", "s0", "s0", "s1", None]), len(text or "")))
        return len(docs) - 1

    items = [(i, prose(r, r.randint(15, 60), "q")) for i in range(6)]
    for _ in range(150):
        i = add(prose(r, 80))
        labels.append((i, 1, 0))
    for _ in range(40):
        i = add(" ".join(w if r.random() < 0.7 else "scum" for w in prose(r, 60).split()))
        labels.append((i, 1, 1))
        expect["toxic"].add(i)
    for i in range(0, 100, 10):
        words = docs[i][1].split()
        words[40] = "changed"
        expect["near"] |= {add(docs[i][1]), add(" ".join(words))}
    passage = prose(r, 70, "p")
    first = add(prose(r, 50) + " " + passage)
    for _ in range(5):
        a, b = prose(r, 60), prose(r, 60)
        expect["passage"][add(f"{a} {passage} {b}")] = f"{a}  {b}"
    for item in items:
        expect["leak"].add(add(f"{prose(r, 90)} {item[1]} {prose(r, 30)}"))
    empty = [add(None), add("")]
    path = tmp_path_factory.mktemp("world")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark, str(path), docs, expect, first, empty


def test_stages_hold_their_contract(world):
    spark, path, docs, expect, first, _ = world
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = now.columns, {d[0]: d for d in docs}
    assert [name for name, _ in pipeline.STAGES] == ["quality_filter", "near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, path)
        assert out.columns == columns
        rows = {r["doc_id"]: tuple(r) for r in out.collect()}
        assert set(rows) <= set(before)
        gone = set(before) - set(rows)
        if name == "quality_filter":
            assert expect["toxic"] <= gone and len(gone - expect["toxic"]) <= 0.25 * len(docs)
            rows = {i: d for i, d in before.items() if i not in expect["toxic"]}  # later stages get all clean documents
        elif name == "near_dedup":
            assert gone == expect["near"]
        elif name == "substring_dedup":
            assert not gone
            changed = {i: r[1] for i, r in rows.items() if r[1] != before[i][1]}
            assert changed == expect["passage"] and all(r[4] == len(r[1] or "") for r in rows.values())
        else:
            assert gone == expect["leak"]
        before = rows
        now = spark.createDataFrame(list(rows.values()), now.schema)
    mixed = pipeline.STAGES[-1][1](spark, now, path).collect()
    assert len(mixed) == len(before)
    by_source = {}
    for m in mixed:
        size = len(WORD.findall(m["text"] or ""))
        assert m["size"] == size and m["taken"] <= 3 * size
        by_source.setdefault(m["source"], []).append(m)
    for rows in by_source.values():
        assert sum(m["size"] for m in rows) == rows[0]["source_size"]
        assert sum(m["taken"] for m in rows) == int(rows[0]["target"] + 1e-9)


def test_run_writes_every_stage(world):
    spark, path, docs, expect, first, empty = world
    got = {r["doc_id"]: r for r in pipeline.run(spark, path).collect()}
    assert not (expect["toxic"] | expect["leak"]) & set(got)
    assert sum(1 for r in got.values() if r["text"] and "p" in {w[0] for w in r["text"].split()}) <= 1


def test_repeated_rows_and_empty_tables(world, tmp_path):
    spark, path, *_ = world
    schema = spark.read.parquet(f"{path}/documents.parquet").schema
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (1, "other text of the same id", "en", "s", 25), (None, "a b c d e f g", "en", None, 13), (2, "a b c d e f g", "en", "s", 13)]
    kept = sorted((r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), path).collect())
    assert kept == [(1, "a b c d e f g"), (1, "other text of the same id")]
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, i int, v int, size int, block int, kept int")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, clash, path).columns == clash.columns and stage(spark, clash, path).count() <= 5
    assert len(set(c := pipeline.source_mixing(spark, clash, path).columns)) == len(c)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
