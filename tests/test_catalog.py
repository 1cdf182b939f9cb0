"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphwalk import catalog
from glyphwalk.catalog import models
from glyphwalk.operators import language_model

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, bool):
        return str(value)
    value = float(value)
    return "nan" if math.isnan(value) else f"{value:.6g}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_agrees_with_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    want = sorted(tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "text", "cost"]


def test_interpolated_model_is_learned_from_distinct_words(spark, monkeypatch):
    """Not from a row per character, and once: the counts are read from a cut."""
    made = []
    monkeypatch.setattr(language_model, "cut", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    catalog.queries()["lm_interpolated"](spark, DATA)
    assert len(made) == 1 and "posexplode(" in made[0]


def test_only_pairs_of_asked_words_are_counted(spark, monkeypatch):
    """They are fewer; the answer is that of all pairs."""
    ask = catalog.queries()["last_word_accuracy"]
    few = ask(spark, DATA)
    assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(models, "ASKED", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, ask(spark, DATA).collect()))


def test_trigrams_are_counted_as_one_string_and_sent_whole(spark):
    plan = catalog.queries()["word_trigram_best"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(keys) == 2 and not any("w1" in k for k in keys)
