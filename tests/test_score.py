import json

import pytest
from pyspark.sql import functions as F

from quillworks.operators import bench, score, twins
from quillworks.operators.judge import Recorded
from quillworks.plans import evaluate as E
from quillworks.plans import panel, report
from quillworks.sources import files
from quillworks.sources.ruleset import Rule, Ruleset, Seed

P = {"C1": (0.10, 0.80), "C2": (0.05, 0.05), "S1": (0.95, 0.60), "S2": (0.20, 0.72)}
TRUTH = {"S1": "r1", "S2": "r2"}


@pytest.fixture(scope="module")
def grid(spark):
    rules = spark.createDataFrame([("r1", 0, False, True, False, None), ("r2", 1, False, True, False, None)], "rule string, ord int, is_countable boolean, is_judgment boolean, guaranteed boolean, inert_on_clean string")
    docs = spark.createDataFrame([("C", d, "seeded" if d in TRUTH else "clean", TRUTH.get(d), float(ms), 10, 0, 0.001, 1, int(d == "S1"), 0, True) for d, ms in zip(P, (100, 200, 300, 400))],
        "arm string, id string, kind string, truth string, latency_ms double, input_tokens long, output_tokens long, cost_usd double, requests long, retries long, unanswered long, usage_reported boolean")
    cells = spark.createDataFrame([("C", d, f"r{i + 1}", p, True) for d, both in P.items() for i, p in enumerate(both)], "arm string, doc string, rule string, probability double, answered boolean")
    return docs, score.grid(docs, cells, rules), rules


def test_overall(grid):
    _, g, rules = grid
    r = {x.threshold: x for x in score.overall(g, rules).collect()}
    assert [(r[t].recall, r[t].fp_cell_rate) for t in (0.5, 0.7, 0.9)] == [(1.0, 0.25), (1.0, 0.25), (0.5, 0.0)]
    assert (r[0.5].fp_doc_rate, r[0.5].off_rule_flags, r[0.5].off_rule_rate, r[0.5].fp_negative_rate, r[0.7].off_rule_flags) == (0.5, 1, 0.5, 0.3333, 0)


def test_rules_calibration_summary(grid):
    docs, g, _ = grid
    r2 = score.per_rule(g).where("rule = 'r2' and threshold = 0.5").first()
    assert (r2.hits, r2.fps, r2.fp_rate_clean) == (1, 1, 0.5)
    b = {x.bucket: (x.n, x.defective) for x in score.calibration(g).collect()}
    assert len(b) == 10 and b[9] == (1, 1) and b[7] == (1, 1) and b[0] == (2, 0) and b[8][0] == 1 and sum(n for n, _ in b.values()) == 8
    s = score.summary(docs).first()
    assert (s.median_ms, s.requests, s.retries, s.usd_e8, s.usd_per_100_e8) == (250.0, 4, 1, 400000, 10000000)
    blind = score.summary(docs.withColumn("usage_reported", F.col("id") != "C1")).first()
    assert blind.usd_e8 is None
    assert [x.doc for x in score.gallery(score.misses(g), True).collect()] == [] and score.false_positives(g).first().doc == "C1"


def test_twins(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "pair int, seq int, text string")
    b = spark.createDataFrame([(1, 0, "x INJ"), (1, 1, "y"), (2, 0, "z"), (2, 1, "w")], a.schema)
    paired, odd = twins.pair_chunks(a, b)
    ans = lambda rows: spark.createDataFrame(rows, "pair int, seq int, rule string, probability double")
    r = twins.readings(paired, spark.createDataFrame([(1, "INJ")], "pair int, sentence string"), ans([(1, 0, "r", 0.2), (1, 1, "r", 0.3)]), ans([(1, 0, "r", 0.9), (1, 1, "r", 0.4)]))
    got = {x.paragraph: (x.delta, x.injected, x.over_bar) for x in r.collect()}
    assert got == {0: (0.7, True, True), 1: (0.1, False, False)} and twins.findings(r).count() == 0
    assert twins.outcome(r, odd).first().exit_code == 2


def test_replies(spark):
    texts = ['{"r": {"flag": true, "p": 0.9}, "x": 1}', '```json\n{"r": {"p": 0, "flag": false}}\n```', '{"r": {"flag": "true", "p": 0.9}}', '{"r": {"flag": true, "p": "0.9"}}', '{"r": {"flag": true, "p": 2}}', "[]", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bench.parse_reply(F.col("t"), ["r"]).alias("p")).orderBy("i")
    for row, text in zip(df.collect(), texts):
        try:
            readings, missing, extra = bench.parse_reply_py(text, ["r"])
        except bench.ReplyError:
            assert not row.p.ok and row.p.missing == ["r"]
            continue
        assert row.p.ok and {x.rule: {"flag": x.flag, "p": x.p} for x in row.p.readings} == readings and row.p.missing == missing and row.p.extra == sorted(extra), text


def test_chat_and_catalogue(spark):
    r = spark.range(1).select(bench.chat_text(F.lit('"a"')).alias("a"), bench.chat_text(F.lit('[{"text": "x"}, {"text": "y"}]')).alias("b"), bench.billed_output(F.lit(10), F.lit(20)).alias("c"), bench.billed_output(F.lit(20), F.lit(10)).alias("d"),
        bench.catalogue(F.lit('{"data": [{"id": "m", "pricing": {"prompt": "0.1", "completion": "x"}, "supported_parameters": ["response_format"]}, {"id": "n", "pricing": {"prompt": "0.1", "completion": "0.2"}}]}')).alias("e")).first()
    assert (r.a, r.b, r.c, r.d) == ("a", "xy", 30, 20) and [(x.id, x.input_usd, x.output_usd, x.json_mode) for x in r.e] == [("m", None, None, True), ("n", 0.1, 0.2, False)]


RULES = Ruleset((Rule("dash", "regex", "m", builtin="dash_present", seed=Seed("insert_em_dash")), Rule("j", "judgment", "m", what="w", criteria=("a", "b"), seed=Seed(splice=("Planted here.",)))))


def test_evaluation_and_report(spark, tmp_path):
    text = "The river ran low, and the mill stood still {}. Nobody in the village could say why. Rain fell far away."
    bases = spark.createDataFrame([(f"C{i:02d}", f"f{i}", 1, text.format(i)) for i in range(8)], "id string, file string, line int, text string")
    ev = E.evaluate(bases, RULES, Recorded([("Planted", {"j": 0.9})], {"j": 0.1}), per_rule=2)
    t = ev.tables()
    r = {(x.arm, x.threshold): (x.hits, x.positives, x.fp_docs) for x in t["overall"].collect()}
    assert r[("A", 0.7)] == (0, 4, 0) and r[("B", 0.7)] == (2, 4, 0) and r[("C", 0.7)] == (4, 4, 0)
    assert {(x.arm, x["class"]): x.by_construction for x in t["classes"].where("threshold = 0.7").collect()}[("B", "countable")]
    report.write(str(tmp_path / "out"), t, "Evaluation", {"cells": ev.cells})
    assert "4 of 4" in (tmp_path / "out" / "tables.md").read_text() and json.loads((tmp_path / "out" / "scores.json").read_text())["classes_list"] == ["dash", "j"]
    assert (tmp_path / "out" / ".gitignore").exists() and spark.read.parquet(str(tmp_path / "out" / "raw" / "cells")).count() == ev.cells.count()


def test_panel(spark, tmp_path):
    docs = spark.createDataFrame([("a", "clean", None, "fine", 0), ("b", "seeded", "j", "bad", 1)], "id string, kind string, truth string, text string, doc_index int")

    def adapter(slug, prompt, text):
        if slug == "broken":
            raise RuntimeError("down")
        return {"text": json.dumps({"j": {"flag": text == "bad", "p": 0.8 if text == "bad" else 0.2}}), "input_tokens": 10, "output_tokens": 5}

    models = spark.createDataFrame([("m0", 0), ("m1", 1)], "model_id string, ord int")
    plan = bench.call_plan(models, docs.withColumnRenamed("id", "doc"), 2).withColumn("provider", F.lit("p")).withColumn("slug", F.when(F.col("model_id") == "m1", "broken").otherwise("m"))
    calls, readings = panel.read_calls(panel.run_calls(plan, {"p": adapter}, "prompt").checkpoint(), ["j"], spark.createDataFrame([("m0", 1e-6, 1e-6)], "model_id string, input_usd double, output_usd double"))
    t = bench.totals(calls).first()
    assert (t.calls, t.failures, t.unpriced) == (8, 4, ["m1"]) and abs(t.priced_usd - 6e-5) < 1e-12
    rules = E.facts(spark, Ruleset((RULES.rules[1],)))
    none = spark.createDataFrame([], "doc string, rule string, probability double, answered boolean")
    got = {(r.arm, r.threshold): r.hits for r in panel.score_panel(docs, readings, none, rules).collect()}
    assert got[("m0/1/flag", 0.9)] == 1 and got[("m0/2/p", 0.9)] == 0 and got[("m0/2/p", 0.7)] == 1
    assert "4 failures" in report.panel_markdown(t.asDict(), [], [])


def test_eval_folder_and_manifest(spark, tmp_path):
    (tmp_path / "inputs").mkdir()
    (tmp_path / "scores.json").write_text('{"classes": ["r"]}')
    (tmp_path / "inputs" / "clean.json").write_text('{"paragraphs": [{"id": "C1", "text": "a"}]}')
    (tmp_path / "inputs" / "seeded.json").write_text('{"paragraphs": [{"id": "S1", "rule": "r", "text": "b"}]}')
    assert sorted((r.id, r.kind, r.truth) for r in files.read_eval_folder(spark, str(tmp_path), ["r"]).collect()) == [("C1", "clean", None), ("S1", "seeded", "r")]
    with pytest.raises(files.FileError):
        files.read_eval_folder(spark, str(tmp_path), ["q"])
    (tmp_path / "t.json").write_text('{"pairs": [{"original": "a", "adversarial": "b", "sentence": "s"}]}')
    assert files.read_twins(str(tmp_path / "t.json")) == [("a", "b", "s")]


def test_formats():
    assert report.counted(3, 4) == "3 of 4" and report.counted(5, 10) == "5 of 10 = 0.50" and report.counted(0, 0) == "n/a"
    assert report.money(None) == "n/a" and report.money(0.0012) == "$0.001200" and report.money(1.5) == "$1.5000"


def test_adapters():
    from quillworks.operators import adapters as A

    sent = []

    def post(status, reply):
        def f(url, body, headers, timeout):
            sent.append((url, json.loads(body), headers))
            return status, {}, reply
        return f

    chat = json.dumps({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}, "finish_reason": "length"}], "usage": {"prompt_tokens": 6, "completion_tokens": 4, "completion_tokens_details": {"reasoning_tokens": 9}}})
    r = A.openrouter("k" * 20, json_mode=True, post=post(200, chat))("m", "p", "t")
    assert (r["text"], r["truncated"], r["input_tokens"], r["reasoning_tokens"]) == ("ab", True, 6, 9) and sent[-1][1]["temperature"] == 0 and sent[-1][1]["response_format"]
    A.openai("k" * 20, effort="low", post=post(200, chat))("m", "p", "t")
    assert "max_completion_tokens" in sent[-1][1] and "temperature" not in sent[-1][1] and sent[-1][1]["reasoning_effort"] == "low"
    m = A.Messages("k" * 20, post=post(200, json.dumps({"content": [{"type": "thinking"}, {"type": "text", "text": "x"}], "stop_reason": "max_tokens", "usage": {"input_tokens": 3}})))("m", "p", "t")
    assert (m["text"], m["truncated"], m["input_tokens"], m["output_tokens"]) == ("x", True, 3, 0)
    with pytest.raises(A.AdapterError) as e:
        A.openai("secret-key-1234567", post=post(400, "no secret-key-1234567"))("m", "p", "t")
    assert "secret-key" not in str(e.value)
    tries = []
    with pytest.raises(A.AdapterError):
        A.request_json(lambda *a: tries.append(1) or (500, {}, "x"), "u", "{}", {}, (), sleep=lambda s: None)
    assert len(tries) == 4
    row = A.AsPanelRow(Recorded([], {"j": 0.9, "k": 0.5}), '{"j": 1, "k": 1}')("m", "p", "t")
    assert json.loads(row["text"]) == {"j": {"flag": True, "p": 0.9}}
