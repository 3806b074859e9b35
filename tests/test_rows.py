"""Plain-Python rules of the Arrow functions against the column expressions, and what the queries' plans leave out."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ctxpress import queries as engine
from ctxpress.functions import content, rows
from ctxpress.functions import patterns as P
from ctxpress.functions.text import document_sentences, sentence_count, split_sentences
from ctxpress.operators import metrics, validation
from ctxpress.operators.compress import compress, scored_sentences

SF = "/root/testdata/sf0.001"
BITS = (
    "must", "never", "Do not", "don't", "WARNING:", "System:", "rules :", "`x`", "```\na. B\n\nC\n```", "```", "\n", "\n\n", "\n \n", ". ", "! ", "? ", "?\n",
    "\x1c", " \x1c", "\xa0", " ", "\x85", "Mr. ", "E.G. ", "etc.", "A", "the", "Lee", "1.", "2) ", "- ", "# ", "needs to", "limıt to", "lİmit to",
    "ſhould", "maKe sure", "must́", "²must", "Ⓐmust", "‍must", "日本", "über", '"Why', "(See", "\0BLOCK0\0", "\0", "json",
    "within", "٣. ", "you are", "harmful", "\t", "\r\n", "p.m.", "Abc", "AB1", "https://x.y\x1cz", "a_b", "f.py", "f.JſON", "v1.2", "Éab", "Σ",
)


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(5)
    return ["".join(rnd.choice(BITS) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]


def test_sentences_and_signals(spark, odd):
    df = spark.createDataFrame(list(enumerate(odd)), "i int, text string")
    find = rows.signals_finder()
    for r in df.select("i", scored_sentences(F.col("text")).alias("x"), document_sentences(F.col("text")).alias("plain"), split_sentences(F.col("text")).alias("split"), sentence_count(F.col("text")).alias("n")).collect():
        paragraphs, own = rows.document_sentences_of(odd[r["i"]])
        instruction, tier = find(own)
        assert [tuple(x) for x in r["x"]] == [(p, s, rows.token_count_of(s), i, t, len(s.split())) for p, s, i, t in zip(paragraphs, own, instruction, tier, strict=True)]
        assert r["plain"] == r["split"] and r["n"] == len(own)


def test_compress_by_either_path(spark, odd):
    """Sentences made by column expressions (with an expression that protects none) and in Python give the same."""
    df = spark.createDataFrame([(k, " ".join(odd[k : k + 3])) for k in range(300)], "i int, text string")
    by = lambda **how: sorted(map(str, compress(df, min_tokens=5, **how).collect()))
    assert by() == by(preserve=("none such at all",))
    plan = compress(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "lambdafunction" not in plan


def test_entities(odd):
    finders = [re.compile(p, re.I if "i" in flags else 0).finditer for flags, p in P.ENTITY]
    assert rows.entities_finder()(odd) == [len({m.start() for find in finders for m in find(s)}) for s in odd]


def test_words_of_validation_and_metrics(spark, odd):
    a = F.col("t")
    find_instructions, find_entities = validation.found_finder()
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", validation.instructions(a).alias("x"), validation.entities(a).alias("y"), metrics.tokens(a).alias("z"))
    hinted = rows.matches(odd, validation.HINT)
    for r in df.collect():
        t = odd[r["i"]]
        assert (find_instructions(t), find_entities(t), rows.tokens_finder()(t)) == (set(r["x"]), set(r["y"]), list(r["z"]))
        assert hinted[r["i"]] or not r["x"]


def test_shared_grams():
    rnd = random.Random(1)
    for most in (3, 10, 50, 90, 300) * 20:
        a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(4, most + 4))] for _ in range(2))
        grams = lambda w, n: Counter(zip(*(w[k:] for k in range(n))))
        assert metrics._shared_grams(a, b) == [sum((grams(a, n) & grams(b, n)).values()) for n in range(1, 5)]


def test_quality_in_one_function(spark, monkeypatch):
    monkeypatch.setattr(metrics, "lcs_length", None)  # a text without some sentences takes no table of all pairs
    assert metrics._rouge_l(["w"] * 50_000 + ["x"], ["w"] * 25_000) == pytest.approx(0.6667, abs=1e-4)
    df = spark.createDataFrame([("A b. C d.", "A b.")], "text string, compressed_text string")
    plan = metrics.quality(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract" not in plan


def test_hints_miss_nothing(odd):
    """Where a signal occurs, its RE2 pattern and that of its group find something."""
    parts = ['"a":', "---", "a.b:", "## é", "[a](b)", "<p>", "<scrıpt>", "<!doctype\xa0HTML", "def é (", "from a", "unİon", "INNER\xa0JOIN", "AI:", "Chunk٣:", "\n----\n", "2024-01-01 10:00:00", "A_B = 1", "\n[sec.é]\n", "GET /", "404", "Abstract\n", "(Né al 2020)", "TİP :"]
    texts = [*parts, *(" ".join(odd[k : k + 2]) + parts[k % len(parts)] for k in range(400))]
    in_group = {name: set(rows.matches(texts, hint) and [i for i, x in enumerate(rows.matches(texts, hint)) if x]) for group, hint in content._GROUPS for name in group}
    for name, signal in content.SIGNALS.items():
        count, there = content._counter(*signal), rows.matches(texts, content._HINTS[name])
        for i, t in enumerate(texts):
            if count(t, rows.is_odd(t)):
                assert there[i] and i in in_group[name], (name, t)


def test_plans_leave_out_what_nobody_reads(spark):
    plan = lambda name: engine.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan("validate_rewrite").count("ArrowEvalPython") == 1  # no similarity
    for name in ("content_types", "compress_auto", "sentence_counts", "chunks", "retention_metrics"):
        assert "regexp" not in plan(name), name
