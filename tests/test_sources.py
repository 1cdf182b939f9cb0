import datetime
import json

import zstandard
from pyspark.sql import functions as F

from glyphwalk.functions import tables
from glyphwalk.operators import analytics as an
from glyphwalk.operators.language_model import LanguageModel
from glyphwalk.plans.automaton import Automaton
from glyphwalk.sources import corpora, logs
from glyphwalk.streaming.scoring import pattern_counts, score_stream


def test_json_lines(spark, tmp_path):
    rows = [{"text": "one"}, {"text": ["two", "three"]}, {"text": None}, {"text": "[not a list"}]
    lines = "\n".join(map(json.dumps, rows)) + "\n\n"
    (tmp_path / "a.jsonl").write_text(lines)
    want = ["one", "two\n\nthree", None, "[not a list"]
    assert [r["text"] for r in corpora.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == want
    for name in ("x.zst", "y.zst"):
        (tmp_path / name).write_bytes(zstandard.compress(lines.encode()))
    assert sorted(r["text"] or "" for r in corpora.read_zstd_jsonl(spark, str(tmp_path), rows=3).collect()) == sorted([w or "" for w in want] * 2)
    (tmp_path / "words").write_text("Apple\n\n pear \napple\n")
    assert {r["word"] for r in corpora.read_words(spark, str(tmp_path / "words")).collect()} == {"apple", "pear"}
    urls, checked = spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), spark.createDataFrame([("a", 200), ("b", 404)], "url string, status int")
    assert {r["url"]: r["valid"] for r in corpora.with_validity(urls, checked).collect()} == {"a": True, "b": False, "c": None}


def test_logs(spark, tmp_path):
    found = spark.createDataFrame([("x", 2.0, [1]), ("y", 1.0, [2, 3])], "text string, time double, tokens array<int>")
    logs.write_results(found, f"{tmp_path}/r")
    assert [(r["urls"], r["times"], list(r["tokens"])) for r in logs.read_results(spark, f"{tmp_path}/r").collect()] == [("y", 1.0, [2, 3]), ("x", 2.0, [1])]
    (tmp_path / "log.csv").write_text("junk,0\nprefix,a\nn,1\nprefix,b\nmessage,late\n")
    got = {r["prefix"]: (r["n"], r["message"]) for r in logs.read_attempts(spark, str(tmp_path / "log.csv"), "prefix").collect()}
    assert got == {"a": ("1", None), "b": (None, "late")}
    for _ in range(2):
        logs.append_rows(found.select("text", "time"), f"{tmp_path}/c")
    assert logs.read_rows(spark, f"{tmp_path}/c", "text string, time double").count() == 4
    a = Automaton.of_pattern("(ab|c)*d?")
    logs.write_automaton(spark, a, f"{tmp_path}/fsa")
    assert logs.read_automaton(spark, f"{tmp_path}/fsa") == a


def test_sql_functions(spark):
    tables.register(spark)
    texts = lambda q: [tuple(r) if len(r) > 1 else r[0] for r in spark.sql(q).collect()]
    assert texts("SELECT * FROM regex_expand('[ab]{1,2}', 2, 3)") == ["a", "b", "aa"]
    assert set(texts("SELECT * FROM edit_expand('ab', 1, 'x')")) == {"ab", "abx", "axb", "xab"}
    assert sorted(map(list, texts("""SELECT * FROM tokenizations('ab', '{"a": 1, "b": 2, "ab": 3}')"""))) == [[1, 2], [3]]
    assert texts("SELECT * FROM edit_script('abc', 'axc')") == [(1, "replace")]
    assert texts("SELECT regex_matches('abab', '(ab)+'), regex_cardinality('[ab]{2}'), regex_cardinality('a*'), regex_literal('a.b')") == [(True, 4, None, "a\\.b")]
    assert "repeat 0.." in texts("SELECT regex_explain('a*')")[0]


def test_scored_stream_equals_batch(spark, tmp_path):
    model = LanguageModel.of_rows(spark, [([-1], 1, 0.5), ([-1], 2, 0.5), ([1], 2, 1.0)]).settled()
    seqs = spark.createDataFrame([(i, [1, 2] if i % 2 else [2]) for i in range(20)], "id long, tokens array<int>")
    seqs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(seqs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    score_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    got = {r["id"]: (r["n_tokens"], round(r["log_p"], 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["id"]: (r["n_tokens"], round(r["log_p"], 6)) for r in model.sequence_scores(seqs).collect()} and len(got) == 20


def test_pattern_counts_in_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(at(0), "a cat"), (at(1), "cats, dog"), (at(7), "dog"), (at(8), "none"), (at(30), "cat")]
    df = spark.createDataFrame(rows, "ts timestamp, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = pattern_counts(stream, {"cat": "cat", "dog": "dog"}, "ts", "5 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r["window"]["start"].minute, r["pattern"]): r["n"] for r in spark.table("hits").collect()}
    assert got == {(0, "cat"): 2, (0, "dog"): 1, (5, "dog"): 1, (30, "cat"): 1}


def test_chi_square_tail():
    # Known quantiles: 3.841 at one degree of freedom and 18.307 at ten leave 5 %.
    assert abs(an.gamma_tail(0.5, 3.841458820694124 / 2) - 0.05) < 1e-9
    assert abs(an.gamma_tail(5, 18.307038053275146 / 2) - 0.05) < 1e-9
    assert an.gamma_tail(1, 0) == 1.0


def test_small_analytics(spark):
    pairs = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    assert [(r["idx"], r["edit"]) for r in an.edit_positions(pairs).collect()] == [(2, "replace"), (0, "insert")]
    df = spark.createDataFrame([("The man’s  — end",)], "t string")
    assert df.select(an.normalized(F.col("t"))).first()[0] == "\nThe man's  - end"
    o, e = spark.createDataFrame([("a", 10), ("b", 20)], "k string, n long"), spark.createDataFrame([("a", 15), ("c", 5)], "k string, n long")
    r = an.chi_square(o, e, ["k"]).first()
    assert abs(r["statistic"] - (25 / 15 + 5)) < 1e-9 and r["df"] == 1 and 0 < r["p_value"] < 0.05


def test_helpers_of_last_word_queries(spark):
    pattern = an.stop_word_pattern("I like", ["it", "a.b"])
    a = Automaton.of_pattern(pattern)
    assert a.accepts("I like it.") and a.accepts('I like a.b!"') and not a.accepts("I like axb") and not a.accepts("I like its")
    df = spark.createDataFrame([(["Th", "e", " m", "an"], "The", "16"), (["T"], "The", "greedy")], "p array<string>, t string, n string")
    got = df.select(an.end_of_prefix(F.col("p"), F.col("t")), an.named_length(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(2, "baseline (n=16)"), (-1, "greedy")]
    assert Automaton.of_pattern("ab*").longest_match("abbc") == "abb" and Automaton.of_pattern("b").longest_match("a") is None
    assert Automaton.of_pattern("ab").parents() == [set(), {0}, {1}]
    model = LanguageModel.of_rows(spark, [([-1], 1, 0.5), ([-1], 2, 0.5), ([1], 1, 0.5), ([1], 2, 0.5), ([2], 1, 0.5), ([2], 2, 0.5)]).settled()
    drawn = [list(r["tokens"]) for r in model.sample(spark, 60, 2, repetition_penalty=60.0).collect()]
    assert len(drawn) == 60 and all(a != b for a, b in drawn)
    texts = spark.createDataFrame([("x",), ("y",)], "text string")
    enc = spark.createDataFrame([("x", [1, 2]), ("x", [2]), ("y", [3])], "text string, tokens array<int>")
    assert {r["text"]: r["tokens"] for r in model.encodable(texts, enc, None).collect()} == {"x": [2], "y": None}
