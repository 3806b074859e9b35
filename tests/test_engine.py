"""The compression engine: its queries against DuckDB, and its operators against plain Python."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxpress import queries as engine
from ctxpress.functions import patterns as P
from ctxpress.functions import scoring as S
from ctxpress.functions.text import document_sentences, paragraphs, reassemble, sentences, token_count
from ctxpress.operators import compress as C
from ctxpress.operators.cost import PRICES, with_savings

SF = "/root/testdata/sf0.001"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    for f in os.listdir(SF):
        duckdb.sql(f"create or replace view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    df = engine.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    got = plain(df.select(*columns).collect())
    assert got and got == plain(duckdb.sql(f"select {', '.join(columns)} from ({engine.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("a", 1), ("a" * 10, 2), ("a" * 14, 4), ("日本語日本語日本", 2)])
def test_token_count(spark, text, n):
    assert one(spark, token_count(F.col("text")), text) == n


def test_sentences(spark):
    text = "Mr. Lee came. He left e.g. Monday. \"Why?\" 3 times.\n# Head. Line\n- item. Two"
    assert one(spark, sentences(F.col("text")), text) == ["Mr. Lee came.", "He left e.g. Monday.", '"Why?" 3 times.', "# Head. Line", "- item. Two"]
    fenced = "Run this. ```\na. B\n``` Then stop. Done"
    assert one(spark, sentences(F.col("text")), fenced) == ["Run this. ```\na. B\n``` Then stop.", "Done"]
    assert one(spark, paragraphs(F.col("text")), " a\n \n\nb\n\n\n") == ["a", "b"]
    assert one(spark, document_sentences(F.col("text")), None) == [] and one(spark, document_sentences(F.col("text")), " \n ") == []


def test_reassemble(spark):
    text = "One. Two.\n\n- a\n- b\n\nThree."
    assert one(spark, reassemble(document_sentences(F.col("text"))), text) == text


def plain_entities(s: str) -> int:
    at = set()
    for flags, p in P.ENTITY:
        at |= {m.start() for m in re.finditer(p, s, re.IGNORECASE if "i" in flags else 0)}
    return len(at)


@pytest.mark.parametrize("s", ["plain words only here", "Ask John Smith at NASA, v2.1.3 or GPT-5", "see config.yaml and /api/v1/chat, a_b camelCase", "mail x.y@z.org https://a.b/c 99.9% `code` DATABASE_URL", "", "Über niño 12 Ärzte"])
def test_entities(spark, s):
    n, words = plain_entities(s), len(s.split())
    assert one(spark, S.entity_count(F.col("text")), s) == n
    want = min(1.0, min(3 * n / words, 0.8) + min(0.3 * n, 0.8)) if n and words else 0.0
    assert one(spark, S.entity_score(F.col("text")), s) == pytest.approx(want)


@pytest.mark.parametrize(("s", "instruction", "tier", "keep"), [
    ("the day was long", 0.0, 1, False), ("you must never stop", 0.8, 3, True), ("WARNING: hot", 0.4, 4, True), ("use `x` now", 0.4, 2, True),
    ("answer as markdown", 0.4, 2, False), ("please ensure you always verify", 0.9, 3, True), ("is it?", 0.4, 1, False),
])
def test_signals(spark, s, instruction, tier, keep):
    assert one(spark, S.instruction_score(F.col("text")), s) == pytest.approx(instruction)
    assert one(spark, S.priority(F.col("text")), s) == tier
    assert one(spark, S.must_keep(F.col("text")), s) is keep
    assert one(spark, S.priority(F.col("text"), ("DAY|x9",)), "the day was long") == 4


def test_chunks():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]])
    rows = [{k: v for k, v in enumerate(r / np.linalg.norm(r)) if v} for r in x]
    assert C.chunk_ids(rows, [10] * 4, 180, 0.5) == [0, 0, 1, 1]
    assert C.chunk_ids([{0: 1.0}] * 5, [40] * 5, 100, 0.1) == [0, 0, 1, 1, 2]
    assert C.centrality([{0: 1.0}, {0: 1.0}, {1: 1.0}]) == [1, 1, 0] and C.centrality([{k: 1.0} for k in range(3)]) == [0, 0, 0]


def test_selection():
    tokens, tier, score = np.array([10, 10, 10, 10]), np.array([1, 1, 1, 4]), np.array([0.9, 0.1, 0.5, 0.0])
    kept = C.select(np.zeros(4, int), tokens, tier, score, np.zeros(4), 0.5, 20)
    assert kept == [True, False, False, True]
    kept = C.select(np.zeros(4, int), tokens, tier, score, np.zeros(4), 0.5, 21)
    assert kept == [True, True, True, True]  # the fill may pass the goal by 25
    kept = C.select(np.zeros(4, int), tokens * 10, tier, score, np.zeros(4), 0.5, 200)
    assert kept == [True, False, False, True]
    kept = C.select(np.zeros(4, int), tokens * 10, np.array([3, 3, 3, 4]), score, np.zeros(4), 0.25, 100)
    assert kept == [False, False, False, True]  # tier 3 may be trimmed, tier 4 never


def test_compress(spark):
    filler = " ".join(f"The slow river number{i} went along green fields and old mills." for i in range(30))
    text = filler + " You must always close the gate. WARNING: dogs bite."
    rows = [(1, text, 5), (2, "Short text. It stays.", 5), (3, None, 5), (4, "", 5), (5, "x" * 400, 5), (6, text, 5), (6, text, 5)]
    df = spark.createDataFrame(rows, "id long, text string, num_chunks int")
    got = {r["id"]: r for r in C.compress(df).collect()}
    assert C.compress(df).count() == 7 and got[1]["compressed_text"] == got[6]["compressed_text"]
    assert 0.3 < got[1]["actual_ratio"] < 0.7 and "always close the gate" in got[1]["compressed_text"]
    for k in (2, 5):
        assert got[k]["compressed_text"] == got[k]["text"] and got[k]["actual_ratio"] == 1
    assert got[3]["compressed_text"] is None and got[4]["compressed_text"] == "" and got[3]["original_tokens"] == 0
    less = C.compress(df.where("id = 1"), target_ratio=0.3).first()
    assert less["compressed_tokens"] < got[1]["compressed_tokens"]
    kept = C.compress(df.where("id = 1"), target_ratio=0.2, preserve=("number17 ",)).first()
    assert "number17 " in kept["compressed_text"]
    asked = C.compress(df.where("id = 1"), target_ratio=0.2, query="number23").first()
    assert "number23" in asked["compressed_text"]
    assert C.compress(df.where("false")).count() == 0
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            C.compress(df, target_ratio=bad)
    with pytest.raises(ValueError):
        C.compress(df, weights=(("colour", 1.0),))


def test_compress_does_not_shuffle(spark):
    plan = C.compress(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_compress_chat(spark):
    long = " ".join(f"The slow river number{i} went along green fields and old mills." for i in range(30))
    talk = spark.createDataFrame([(1, 0, "system", long), (1, 1, "user", long), (1, 2, "assistant", "ok"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in C.compress_chat(talk).collect()}
    assert got[0]["compressed_text"] == long and len(got[1]["compressed_text"]) < len(long) and got[2]["compressed_text"] == "ok" and got[3]["compressed_text"] is None


def test_cost(spark):
    df = spark.createDataFrame([(1000, 500), (100, 200), (0, 0)], "original_tokens long, compressed_tokens long")
    rows = with_savings(df, models=("gpt-5",)).orderBy(F.desc("original_tokens")).collect()
    assert [(r["tokens_saved"], r["reduction_percent"], r["daily_savings"]) for r in rows] == [(500, 50.0, 0.625), (0, 0.0, 0.0), (0, 0.0, 0.0)]
    assert with_savings(df).count() == 3 * len(PRICES)
    with pytest.raises(ValueError):
        with_savings(df, models=("none",))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and engine.QUERIES.keys() <= entry.queries().keys()
    assert entry.entry(spark).count() == 200


def test_registered_query_changes_what_is_kept(spark, monkeypatch):
    kept = lambda: {r["doc_id"]: r["compressed_text"] for r in engine.compress_documents_with_query(spark, SF).collect()}
    asked = kept()
    monkeypatch.setattr(engine, "compress", lambda df, **how: C.compress(df, weights=(("query", 0.0),), **how))
    plain = kept()
    differ = sum(asked[k] != plain[k] for k in asked)
    print("texts that differ:", differ, "of", len(asked))
    assert differ > len(asked) / 10
