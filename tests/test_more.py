"""Content profile, modes, structured shortening, validation, rewriting, selection, metrics, sources."""

from __future__ import annotations

import io
import itertools
import json

import pytest
from pyspark.sql import functions as F

from ctxpress.functions.content import content_profile
from ctxpress.operators import metrics, modes, rewrite, selection, structured, validation
from ctxpress.operators.compress import compress
from ctxpress.operators.cost import list_supported_models
from ctxpress.sources import files

SAMPLES = {
    "json": '{"a": {"b": [1, 2]},\n "c": "d"}',
    "yaml": "---\nname: x\nitems:\n  - one\n  - two\n",
    "markdown": "# Title\n\nText here.\n\n## Part\n\n- one\n- two\n",
    "html": "<!DOCTYPE html>\n<html><body><p>Hi</p></body></html>",
    "xml": '<?xml version="1.0"?>\n<items xmlns="u"><item>1</item></items>',
    "python": "import os\n\ndef main():\n    return os.name\n",
    "sql": "SELECT a FROM t WHERE b = 1 ORDER BY a;",
    "chat_conversation": "User: hello\nAssistant: hi\nUser: bye\n",
    "log_file": "2024-01-01 10:00:00 ERROR [ERROR] down\n2024-01-01 10:00:01 INFO up",
    "general_text": "the cat sat on the mat",
}


def test_content_profile(spark):
    rows = [(k, v) for k, v in SAMPLES.items()] + [("blank", " \n "), ("null", None)]
    got = {r["name"]: r["profile"] for r in content_profile(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert {k: got[k]["content_type"] for k in SAMPLES} == {k: k for k in SAMPLES}
    for k in ("blank", "null"):
        assert (got[k]["content_type"], got[k]["confidence"], got[k]["estimated_tokens"]) == ("general_text", 1.0, 0)
    assert got["json"]["has_structure"] and not got["general_text"]["has_structure"] and got["python"]["language_hint"] == "python"
    assert (got["json"]["structure_depth"], got["markdown"]["structure_depth"], got["general_text"]["structure_depth"]) == (3, 2, 0)
    assert all(len(p["secondary_types"]) <= 3 for p in got.values())


def test_modes(spark):
    assert modes.list_modes() == sorted(modes.list_modes()) and len(modes.list_modes()) == 8 == modes.modes(spark).count()
    with pytest.raises(ValueError):
        modes.get_mode("none such")
    kind = spark.createDataFrame([("json",), ("sql",), ("odd",)], "k string")
    assert [r[0] for r in kind.select(modes.resolve_mode("auto", F.col("k"))).collect()] == ["balanced", "code", "balanced"]
    assert kind.select(modes.resolve_mode(None)).first()[0] == kind.select(modes.resolve_mode("auto")).first()[0] == "balanced"


def test_compress_by_mode(spark):
    prose = " ".join(f"The slow river number{i} went along green fields." for i in range(40)) + " You must close the gate."
    table = json.dumps({"users": [{"id": k, "name": f"user {k}"} for k in range(30)]}, indent=4)
    df = spark.createDataFrame([(1, prose, "x"), (2, table, "y"), (3, None, "z")], "id int, text string, profile string")
    got = {r["id"]: r for r in compress(df, detect_content=True).collect()}
    assert got[2]["content_type"] == "json" and got[2]["structure_preserved"] and len(json.loads(got[2]["compressed_text"])["users"]) <= 30
    assert got[1]["mode"] == "system" and got[1]["target_ratio"] == 0.8 and got[1]["instructions_found"] >= got[1]["instructions_kept"] >= 1 and got[1]["profile"] == "x"
    assert sum(c["sentences_kept"] for c in got[1]["chunk_results"]) == got[1]["sentences_kept"] and len(got[1]["chunk_results"]) == got[1]["num_chunks"]
    quality, plain = compress(df.where("id = 1"), mode="quality").first(), compress(df.where("id = 1")).first()
    assert quality["target_ratio"] == 0.7 and quality["compressed_tokens"] > plain["compressed_tokens"] and plain["mode"] is None and plain["entities_found"] is None
    assert compress(df.where("id = 1")).select(F.explode("chunk_results")).count() == plain["num_chunks"]
    with pytest.raises(ValueError):
        compress(df, mode="none such")


def test_structured(spark):
    users = json.dumps({"users": [{"id": k} for k in range(10)], "few": [1, 2, 3]}, indent=2)
    for ratio in (0.2, 0.5, 1.0):
        got = json.loads(structured.shorten_json(users, ratio))
        assert got.keys() == {"users", "few"} and got["few"] == [1, 2, 3]
    assert len(json.loads(structured.shorten_json(users, 0.2))["users"]) == 2
    assert structured.shorten_json("{", 0.5) is None and structured.shorten_xml("<a>", 0.5) is None
    lean = structured.strip_comments("# top\na: 1 # one\n\nb:\n  - x\n")
    assert lean == "a: 1\nb:\n  - x"
    text = "# H\n\nline one\nline two\nline three\nline four\n```\ncode # x\n```\n## I\nlast\n"
    short = structured.shorten_markdown(text, 0.5)
    assert "# H" in short and "```\ncode # x\n```" in short and "line one\nline two" in short and "line three" not in short
    assert structured.shorten_xml("<r>  <i>1</i> <i>2</i> <i>3</i> <i>4</i> </r>", 0.5) == "<r><i>1</i><i>2</i></r>"
    rows = spark.createDataFrame([("json", "[1, 2]"), ("prose", "x"), (None, "y"), ("json", None)], "k string, t string")
    assert [r[0] for r in rows.select(structured.optimize_structured(F.col("k"), F.col("t"), F.lit(1.0))).collect()] == ["[1,2]", None, None, None]


def test_validation(spark):
    long = "You must check Report_A and never skip the ORDER step. The budget table lists seven numbers for Berlin."
    rows = [(1, long, long), (2, long, ""), (3, long, "Cats sleep all day in warm sunny places and dream."), (4, "", ""), (5, None, None), (6, long, long + long)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r["id"]: r["v"] for r in df.select("id", validation.validate(F.col("a"), F.col("b"), ("berlin",)).alias("v")).collect()}
    assert got[1]["passed"] and got[1]["similarity"] == pytest.approx(1) and got[1]["failures"] == []
    assert not got[2]["passed"] and "Rewrite is empty" in got[2]["failures"]
    assert not got[3]["passed"] and got[3]["instruction_retention"] == 0 and got[3]["keyword_retention"] == 0
    assert not got[4]["passed"] and not got[5]["passed"]
    assert any(f.startswith("Rewrite inflated tokens") for f in got[6]["failures"])


def test_rewrite(spark):
    text = "You must read the Manual about Berlin before the visit, because the guards there ask about it very often indeed."
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    run = lambda f: rewrite.rewrite(df, rewrite.CallableProvider(f)).where("id = 1").first()
    good = run(lambda t, r: t.replace(" very often indeed", ""))
    assert good["accepted"] and good["rewritten_text"].endswith("ask about it.")
    for bad in (lambda t, r: "pasta", lambda t, r: 7, lambda t, r: 1 / 0):
        got = run(bad)
        assert got["fallback_used"] and got["rewritten_text"] == text
    assert "ZeroDivisionError" in run(lambda t, r: 1 / 0)["error_message"]
    with pytest.raises(TypeError):
        rewrite.CallableProvider("no function")
    templates = rewrite.Templates()
    templates.register(rewrite.Template("own", "s", "{target_percent} {target_ratio}{constraints} {text}"))
    assert "own" in templates.list_templates() and templates.resolve(content_type="sql").name == "code_context" and templates.resolve().name == "general"
    prompt = df.where("id = 1").select(rewrite.user_prompt(templates.resolve("own"), F.lit("T"), 0.3, ("be brief",))).first()[0]
    assert prompt == "70 0.3\n- be brief T"
    with pytest.raises(ValueError):
        templates.resolve("none such")
    both = rewrite.hybrid(df, rewrite.CallableProvider(lambda t, r: t)).where("id = 1").first()
    assert both["accepted"] and both["rewritten_text"] == both["compressed_text"]


def test_knapsack(spark):
    assert selection.choose([6, 5, 5], [7.0, 5.0, 5.0], [False] * 3, 10 / 16) == {1, 2}
    weights, scores = [3, 4, 5, 2, 6, 1], [2.0, 3.0, 4.5, 1.0, 5.0, 0.4]
    for budget in range(22):
        best = max(sum(scores[i] for i in c) for n in range(7) for c in itertools.combinations(range(6), n) if sum(weights[i] for i in c) <= budget)
        found = selection.knapsack(weights, scores, budget)
        assert sum(scores[i] for i in found) == pytest.approx(best) and sum(weights[i] for i in found) <= budget
    assert selection.choose([5, 5], [1.0, 2.0], [True, True], 0.1) == {1} and selection.choose([], [], [], 0.5) == set()
    assert sum([10] * len(selection.knapsack([10] * 100, [1.0] * 100, 600))) == 600  # beyond the limit: greedy
    rows = spark.createDataFrame([([(6, 7.0, False), (5, 5.0, True)],), (None,)], "x array<struct<tokens:int,score:double,must_keep:boolean>>")
    assert [r[0] for r in rows.select(selection.knapsack_select(F.col("x"))).collect()] == [[1], None]


def test_metrics(spark):
    def lcs(a, b):
        return 0 if not a or not b else 1 + lcs(a[1:], b[1:]) if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    for a, b in itertools.product(["", "a", "ab", "abcab", "bca", "aabbcc"], repeat=2):
        assert metrics.lcs_length(list(a), list(b)) == lcs(a, b)
    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("a b", ""), (None, None), ("a b c d e f", "a b c d")], "text string, compressed_text string")
    got = [r["quality"] for r in metrics.quality(df).collect()]
    assert got[0]["bleu4"] == pytest.approx(1, abs=1e-3) and got[0]["rouge_l"] == 1 and got[1]["bleu4"] == 0 and got[2]["rouge_l"] == 0
    assert got[3]["bleu4"] == pytest.approx(0.6065, abs=1e-3) and got[3]["rouge_l"] == 0.8
    base = spark.createDataFrame([("x", 1.0, True), ("y", 1.0, False), ("z", 1.0, True)], "metric string, baseline double, higher_is_better boolean")
    actual = spark.createDataFrame([("x", 1.1), ("y", 1.02), ("z", 0.5)], "metric string, actual double")
    assert {r["metric"]: r["status"] for r in metrics.against_baselines(actual, base).collect()} == {"x": "PASS", "y": "WARN", "z": "FAIL"}
    sums = spark.createDataFrame([("a", 10, 5), ("b", 30, 5)], "g string, original_tokens int, compressed_tokens int")
    assert {r["g"]: r["saved_percent"] for r in metrics.totals(sums, "g").collect()} == {"a": 50.0, "b": 83.3, None: 75.0}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo"
    assert files.read_stdin(spark, io.StringIO("in")).first()["text"] == "in"
    (tmp_path / "set.json").write_text(json.dumps([{"id": "1", "text": "t"}, {"id": "2", "document": "d"}, {"id": "3", "messages": [{"role": "user", "content": "m"}, {"role": "user", "content": "n"}]}, {"id": "4"}]))
    assert {r["id"]: (r["text"], r["category"]) for r in files.read_dataset(spark, str(tmp_path / "set.json")).collect()} == {"1": ("t", "set"), "2": ("d", "set"), "3": ("m n", "set"), "4": ("", "set")}
    done = compress(spark.createDataFrame([("short text",)], "text string"))
    assert json.loads(done.select(files.result_json()).first()[0])["compressed_text"] == "short text"
    assert "2 -> 2 tokens" in done.select(files.summary()).first()[0]
    files.write_texts(done, str(tmp_path / "out"))
    files.write_json(done.select("compressed_text"), str(tmp_path / "j"))
    files.write_csv(done.select("compressed_text"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "short text"
    assert "| compressed_text |" in files.markdown_report(done.select("compressed_text"), "R")
    assert list_supported_models() == sorted(list_supported_models())


def test_command_line(spark, tmp_path, capsys):
    from ctxpress.__main__ import main

    (tmp_path / "a.txt").write_text("A short text.")
    assert main([str(tmp_path / "a.txt"), "--stats", "--cost", "gpt-5"], spark) == 0
    said = capsys.readouterr()
    assert said.out == "A short text.\n" and "tokens" in said.err and "gpt-5" in said.err
    assert main([str(tmp_path / "a.txt"), "--analyze"], spark) == 0
    assert '"content_type":"general_text"' in capsys.readouterr().out
