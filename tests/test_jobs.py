"""Generation jobs, gates and the registered queries."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from rcaspark.operators import generate
from rcaspark.operators.profile import GateError, check_rules, observed, order_check
from rcaspark.plans import refine

SMALL = "/root/testdata/sf0.001"


def prompts(spark, n):
    return spark.range(n).select("id", F.lit("s").alias("system"), F.concat(F.lit("p"), "id").alias("prompt"))


def test_failures_are_recorded_and_not_repeated(spark):
    def flaky():
        def ask(prompt, system, temperature):
            if prompt == "p3":
                raise RuntimeError("down")
            return "x", "length" if prompt == "p4" else "stop"
        return ask

    calls = generate.record(generate.run_calls(prompts(spark, 6), ["id"], flaky))
    got = {r["id"]: (r["status"], r["error"]) for r in calls.collect()}
    assert got[3] == ("FAILED", "down") and got[4] == ("FAILED", "finish_reason length") and got[0] == ("COMPLETE", None)
    with pytest.raises(GateError):
        generate.complete_only(calls)
    again = generate.run_calls(prompts(spark, 6), ["id"], generate.echo_client, done=calls.where("status = 'COMPLETE'"))
    assert sorted(r["id"] for r in again.collect()) == [3, 4]


def test_admission_never_cuts(spark):
    rows = spark.createDataFrame([("short",), ("x" * 500,)], "prompt string")
    got = generate.admission(rows, F.length("prompt"), 100, 20).orderBy("tokens").collect()
    assert [(r["status"], len(r["prompt"])) for r in got] == [("ADMITTED", 5), ("BLOCKED_CAPACITY", 500)]


def test_judge_must_give_a_number(spark):
    pairs = spark.createDataFrame([("c", "a", "b")], "case string, cause string, effect string")
    with pytest.raises(GateError):
        generate.debate(pairs, "x", generate.echo_client, generate.echo_client)


def test_debate_ends_early_and_decides_at_half(spark):
    pairs = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a")], "case string, cause string, effect string")

    def judge():
        return lambda prompt, system, temperature: ("0.9" if "If a " in prompt else "0.5", "stop")

    decided, turns = generate.debate(pairs, "x", generate.echo_client, judge)
    assert sorted((r["cause"], r["verdict"], r["rounds"]) for r in decided.collect()) == [("a", 1, 1), ("b", None, 3)]
    assert turns.count() == 2 + 6


def test_rules_in_the_same_pass(spark):
    rows = spark.range(10)
    rules = {"small": F.col("id") < 8, "known": F.col("id").isNotNull()}
    assert {r["rule"]: r["violations"] for r in check_rules(rows, rules).collect()} == {"small": 2, "known": 0}
    seen, watch = observed(rows, rules)
    seen.collect()
    assert watch.get == {"small": 2, "known": 0}


def test_order_check_sees_steps_between_blocks(spark):
    rows = spark.createDataFrame([("k", i, 100 - i if i >= 50 else i) for i in range(100)], "k string, pos int, ts int")
    got = order_check(rows, ["k"], "ts", "pos", F.expr("pos div 50")).first()
    assert not got["increasing"] and got["steps_back"] == 49


def test_every_oracle_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 5


def test_a_broken_run_goes_on_from_its_store(spark, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()

    def breaking(bad):
        def make():
            def ask(prompt, system, temperature):
                (seen / prompt).touch()
                if prompt == bad:
                    raise KeyboardInterrupt("the machine is gone")
                return f"answer to {prompt}", "stop"
            return ask
        return make

    q = prompts(spark, 40)
    batch = F.pmod(F.xxhash64("id", F.sha2(F.concat_ws("\n", "system", "prompt"), 256)), F.lit(8))
    late = q.orderBy(batch.desc()).first()["id"]
    with pytest.raises(Exception, match="the machine is gone"):
        generate.stored_calls(q, ["id"], breaking(f"p{late}"), store, batch=5)
    kept = {r["id"] for r in spark.read.parquet(store).collect()}
    for file in seen.iterdir():
        file.unlink()
    got = generate.stored_calls(q, ["id"], breaking(None), store, batch=5)
    asked = {int(f.name[1:]) for f in seen.iterdir()}
    assert 0 < len(kept) < 40 and late not in kept and asked == set(range(40)) - kept
    assert {r["id"]: r["text"] for r in got.collect()} == {i: f"answer to p{i}" for i in range(40)}
    # Another question is asked, an answered one is not; an empty table asks nothing.
    other = q.where("id < 3").withColumn("prompt", F.when(F.col("id") == 1, "new").otherwise(F.col("prompt")))
    assert {r["id"]: r["text"] for r in generate.stored_calls(other, ["id"], breaking("p2"), store).collect()} == {
        0: "answer to p0", 1: "answer to new", 2: "answer to p2"}
    assert generate.stored_calls(q.where("false"), ["id"], breaking(None), str(tmp_path / "none")).count() == 0


def test_failed_calls_are_asked_again_or_kept(spark, tmp_path):
    def client(reason):
        return lambda: lambda prompt, system, temperature: ("x", reason if prompt == "p1" else "stop")

    store = str(tmp_path / "store")
    first = generate.stored_calls(prompts(spark, 3), ["id"], client("length"), store)
    kept = generate.stored_calls(prompts(spark, 3), ["id"], client("stop"), store, again=False)
    again = generate.stored_calls(prompts(spark, 3), ["id"], client("stop"), store)
    status = lambda df: [r["status"] for r in df.orderBy("id").collect()]
    assert status(first) == status(kept) == ["COMPLETE", "FAILED", "COMPLETE"] and status(again) == ["COMPLETE"] * 3


def test_a_debate_can_be_judged_again(spark):
    pairs = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a"), ("d", "a", "b")], "case string, cause string, effect string")
    decided, turns = generate.debate(pairs, "x", generate.echo_client, generate.number_client)
    rows = lambda df: sorted((r["case"], r["cause"], r["verdict"], r["rounds"]) for r in df.collect())
    assert rows(generate.replay_debate(turns, generate.number_client)) == rows(decided)
    strict = generate.replay_debate(turns, lambda: lambda prompt, system, temperature: ("0.7", "stop"))
    assert all(v == 1 for _, _, v, _ in rows(strict)) and len(rows(strict)) == 3
    assert generate.replay_debate(turns.where("false"), generate.number_client).count() == 0


def test_refining_several_cases_with_texts_and_a_store(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(3)
    def rows(case):
        a = r.uniform(-1, 1, 1500)
        b = a + 0.5 * r.uniform(-1, 1, 1500)
        return [(case, [float(x), float(y), float(x + y + z)]) for x, y, z in zip(a, b, r.uniform(-1, 1, 1500))]

    panel = spark.createDataFrame(rows("one") + rows("two"), "case string, values array<double>")
    nodes = spark.createDataFrame([(c, e, i) for c in ("one", "two") for i, e in enumerate(("a", "b", "kpi"))], "case string, entity string, pos int")
    texts = spark.createDataFrame([("one", "a", "a is a queue")], "case string, entity string, text string")
    seen = tmp_path / "seen"
    seen.mkdir()

    def explain():
        def ask(prompt, system, temperature):
            (seen / uuid.uuid4().hex).touch()
            return ("queue" if "a is a queue" in prompt else "plain"), "stop"
        return ask

    out = [refine.refine_cases(panel, nodes, "x", explain, generate.coin_client, texts=texts, store=str(tmp_path / "store")) for _ in range(2)]
    assert out[0]["explained"].where("text = 'queue'").select("case").distinct().collect()[0][0] == "one"
    assert {(r["case"], r["stage"], r["n"]) for r in out[0]["ranking"].groupBy("case", "stage").agg(F.count("*").alias("n")).collect()} == {
        (c, s, 3) for c in ("one", "two") for s in ("discovered", "constrained")}
    assert sorted(map(tuple, out[0]["ranking"].collect())) == sorted(map(tuple, out[1]["ranking"].collect()))
    assert len(list(seen.iterdir())) == 12


def test_the_rest_works_without_the_optional_part(monkeypatch):
    """Without the subpackage for training data the entry imports, and offers all other queries."""
    import importlib
    import sys

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name == "rcaspark.llm" or name.startswith("rcaspark.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name="rcaspark.llm")
            return None

    held = {name: sys.modules.pop(name) for name in list(sys.modules) if name in ("__spark_entry__", "corpus_pipeline") or name.startswith("rcaspark.llm")}
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    try:
        bare = importlib.import_module("__spark_entry__")
        assert "entity_ranking" in bare.queries() and not any(n == "pipeline" or n.startswith("op") for n in bare.queries())
        assert set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(held)


REST = sorted(n for n in entry_points.queries() if n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", REST)
def test_every_query_runs_and_matches_its_sql(spark, name):
    from tools.check import compare, duck

    ok, note = compare(spark, duck(SMALL), entry_points.queries()[name], entry_points.oracle_sql().get(name), SMALL)
    assert ok, note
