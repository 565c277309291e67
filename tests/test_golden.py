"""Known answers for evaluation, edges, walks, answers, pages, vectors and evidence."""

import random

import pytest
from pyspark.sql import functions as F

from rcaspark.functions import html, text
from rcaspark.operators import edges, evaluate, evidence, generate, logs, retrieve, walk
from rcaspark.operators.profile import GateError


def ranks(spark, *values):
    return spark.createDataFrame([("m", v) for v in values], "method string, rank int")


@pytest.mark.parametrize("values, map5, map10, mrr", [
    ((2, 7), 0.30, 0.55, 9 / 28), ((3, 6), 0.20, 0.55, 0.25), ((1,), 0.8, 0.9, 1.0), ((5,), 0.0, 0.5, 0.2)])
def test_rank_metrics(spark, values, map5, map10, mrr):
    got = evaluate.rank_metrics(ranks(spark, *values), ["method"], (5, 10)).first()
    assert (got["map_5"], got["map_10"], got["mrr"]) == pytest.approx((map5, map10, mrr))


def test_inclusive_metrics(spark):
    got = evaluate.rank_metrics(ranks(spark, 2, 7), ["method"], (5, 10), inclusive=True).first()
    assert (got["map_5"], got["map_10"]) == pytest.approx((0.40, 0.65))


@pytest.mark.parametrize("bad", [(), (0,), (-1,), (None,)])
def test_bad_ranks_are_refused(spark, bad):
    with pytest.raises(GateError):
        evaluate.check_ranks(ranks(spark, *bad))


def test_fractional_ranks_are_refused(spark):
    with pytest.raises(GateError):
        evaluate.check_ranks(spark.createDataFrame([("m", 2.0)], "method string, rank double"))


def test_all_or_nothing(spark):
    cases = lambda *r: spark.createDataFrame([("g", f"c{i}", s, x) for i, (s, x) in enumerate(r)], "g string, case string, stage string, rank int")
    assert evaluate.all_or_nothing(cases(("a", 1), ("a", None)), ["g"]).first()["mrr"] is None
    assert evaluate.all_or_nothing(cases(("a", 1), ("a", 2)), ["g"]).first()["mrr"] == pytest.approx(0.75)
    with pytest.raises(GateError):
        evaluate.all_or_nothing(cases(("a", 1), ("b", 2)), ["g"])


def test_service_match(spark):
    t = spark.createDataFrame([("c", "db-v1"), ("d", "web")], "case string, label string")
    e = spark.createDataFrame([("c", "db-v1-64c-p4"), ("c", "db-v10-1"), ("c", "db-v1"), ("d", "web-1"), ("d", "webx")], "case string, entity string")
    got = sorted((r["case"], r["entity"], r["scorable"]) for r in evaluate.match_service(t, e).collect())
    assert got == [("c", "db-v1", False), ("c", "db-v1-64c-p4", False), ("d", "web-1", True)]


# -- edges and walk ----------------------------------------------------------------

def chain(spark):
    nodes = spark.createDataFrame([("c", n, i) for i, n in enumerate(["A", "B", "Latency"])], "case string, entity string, pos int")
    return nodes, nodes.where("entity = 'Latency'")


def test_endpoint_marks_and_text(spark):
    cells = spark.createDataFrame([("c", "A", "B", -1), ("c", "B", "A", 1), ("c", "A", "Latency", 0)], "case string, a string, b string, mark int")
    e = edges.marks_from_endpoints(cells)
    assert [tuple(r) for r in e.collect()] == [("c", "A", "B", "->")]
    assert edges.edges_text(e, chain(spark)[0]).first()["text"] == "A -> B"


def test_released_text_prints_bidirected_twice(spark):
    nodes, _ = chain(spark)
    e = spark.createDataFrame([("c", "A", "B", "<->"), ("c", "B", "A", "<->")], "case string, cause string, effect string, mark string")
    assert edges.edges_text(e, nodes).first()["text"] == "B <-> A"
    assert edges.edges_text(e, nodes, "released").first()["text"] == "B <-> A, A <-> B"


def test_walk_goes_upstream_and_ways_agree(spark):
    nodes, kpi = chain(spark)
    e = spark.createDataFrame([("c", "A", "B", "->"), ("c", "B", "Latency", "->")], "case string, cause string, effect string, mark string")
    moves = walk.transitions(walk.walk_graph(e, kpi))
    exact = {r["node"]: r["visits"] for r in walk.expected_visits(moves, nodes, kpi).collect()}
    assert exact["A"] > 0 and exact["B"] > 0
    joined = {r["node"]: r["visits"] for r in walk.expected_visits(moves, nodes, kpi, n_steps=12, small=0).collect()}
    short = {r["node"]: r["visits"] for r in walk.expected_visits(moves, nodes, kpi, n_steps=12).collect()}
    assert joined == pytest.approx(short)


def test_convergence_shortcut(spark):
    nodes, kpi = chain(spark)
    e = spark.createDataFrame([("c", "A", "Latency", "->"), ("c", "B", "Latency", "->"), ("c", "A", "B", "--"), ("c", "B", "A", "--")], "case string, cause string, effect string, mark string")
    moves = walk.transitions(walk.walk_graph(e, kpi))
    early = {r["node"]: r["visits"] for r in walk.visits_by_joins(moves, nodes, kpi, per_cut=10, tolerance=1e-3).collect()}
    exact = {r["node"]: r["visits"] for r in walk.expected_visits(moves, nodes, kpi).collect()}
    assert early == pytest.approx(exact, rel=2e-2)


def test_ties_keep_column_order(spark):
    nodes, _ = chain(spark)
    v = spark.createDataFrame([("c", "A", 2.0), ("c", "B", 2.0), ("c", "Latency", 3.0)], "case string, node string, visits double")
    assert [r["node"] for r in walk.rank_nodes(v, nodes).orderBy("rank").collect()] == ["Latency", "A", "B"]


def test_missing_stage_graph_is_an_error(spark):
    g = spark.createDataFrame([("c", "A", "B", "->", "initial")], "case string, cause string, effect string, mark string, graph_role string")
    with pytest.raises(GateError):
        walk.route_stages(g, spark.createDataFrame([("c", "s", "refined")], "case string, stage string, graph_role string"))


def test_prompt_direction(spark):
    nodes, _ = chain(spark)
    e = spark.createDataFrame([("c", "A", "B", "->")], "case string, cause string, effect string, mark string")
    pairs = generate.ordered_pairs(nodes)
    right = {(r["cause"], r["effect"]): r["prompt"] for r in generate.explanation_prompts(pairs, e, nodes, "x", "pc").collect()}
    assert len(right) == 6
    assert "A is the cause of B." in right["A", "B"] and "changes in A directly affect B" in right["A", "B"]
    assert "changes in A do not" not in right["B", "Latency"]
    old = {(r["cause"], r["effect"]): r["prompt"] for r in generate.explanation_prompts(pairs, e, nodes, "x", "pc", "released").collect()}
    assert "B is the cause of A." in old["A", "B"]
    assert "changes in A do not directly affect B" in old["B", "Latency"]
    gaps = spark.createDataFrame([("c", x, p) for x, p in (("a", 0), ("b", 5), ("k", 9))], "case string, entity string, pos int")
    assert {(r["cause"], r["effect"], r["cause_pos"]) for r in generate.ordered_pairs(gaps).collect()} == {
        (a, b, {"a": 0, "b": 5, "k": 9}[a]) for a in "abk" for b in "abk" if a != b}
    some = spark.createDataFrame([("c", "k", "a"), ("c", "a", "a")], "case string, cause string, effect string")
    assert [(r["cause"], r["effect_pos"]) for r in generate.ordered_pairs(gaps, some).collect()] == [("k", 0)]


def test_labels_and_truths_without_a_match_stay(spark):
    truth = spark.createDataFrame([("1", "web"), ("2", "db")], "case string, label string")
    names = spark.createDataFrame([("1", "web-7"), ("2", "cache")], "case string, entity string")
    assert {(r["case"], r["entity"], r["scorable"]) for r in evaluate.match_service(truth, names).collect()} == {("1", "web-7", True), ("2", None, False)}
    ranking = spark.createDataFrame([("1", "a", 2.0, 1), ("1", "k", 2.0, 2)], "case string, node string, visits double, rank int")
    rows = evaluate.truth_report(ranking, spark.createDataFrame([("1", "a"), ("2", "b")], "case string, node string"), "k").collect()
    assert {(r["case"], r["rank_all"], r["tied"]) for r in rows} == {("1", 1, 1), ("2", None, 0)}


# -- answers -------------------------------------------------------------------------

def written(records, between="\n\n---"):
    """An answer in the grammar: a guess that ends in a tag, a blank line, a probability; records apart by a rule."""
    return between.join(f"G{i}: {guess} <{tag}>\n\nP{i}: {p}" for i, (guess, tag, p) in enumerate(records, 1))


def strict(spark, texts, n=2):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.strict_guesses(F.col("t"), n).alias("s"))
    return [r["s"] for r in rows.orderBy("i").collect()]


def test_strict_guesses_reads_what_the_grammar_writes(spark):
    rng, cases = random.Random(4), []
    for _ in range(40):
        records = [("".join(rng.choice("ab <c>.1é") for _ in range(rng.randint(1, 9))).strip() or "x", rng.choice(["yes", "no"]),
                    rng.choice(["0", "1", ".5", f"0.{rng.randint(0, 999)}", "1.0"])) for _ in range(2)]
        cases.append((records, written(records, rng.choice(["\n\n---", "\n\n"]))))
    for (records, _), got in zip(cases, strict(spark, [t for _, t in cases])):
        assert got["status"] == "unchanged"
        assert [(r["guess"], r["answer"], r["probability"]) for r in got["records"]] == [(f"{g} <{a}>", a, float(p)) for g, a, p in records]


def test_strict_guesses_mends_white_space_only(spark):
    good = written([("one", "yes", "0.25"), ("two", "no", "0.75")])
    for got in strict(spark, [good.replace("\n\nP", "\nP"), good.replace("---", "---\n"), good.replace(": ", ":  ")]):
        assert got["status"] == "normalised" and got["normal"] == good


def test_strict_guesses_rejects_what_breaks_one_rule(spark):
    def answer(p="0.25", guess="one <yes>", label="P1: ", second="G2: two <no>\n\nP2: 0.75"):
        return f"G1: {guess}\n\n{label}{p}\n\n---{second}"

    broken = [
        "", "no labels", answer(label="P1:\n"), answer(p="0.٥"), answer(label="P١: "), answer(p="0.5f"), answer(p="2"), answer(p="1e-1"), answer(p="+0.1"), answer(p="."),
        answer(guess="one"), answer(guess="one <maybe>"), answer(guess="on\n\ne <yes>"), answer(guess="a --- b <yes>"), answer(second=""), answer(label="P3: "),
        answer(label="  P1: "), answer(label="P1 : "), "Here:\n" + answer(), answer() + "\n\nG3: x <no>\n\nP3: 0"]
    assert [got["status"] for got in strict(spark, broken)] == ["rejected"] * len(broken)
    assert strict(spark, [answer()])[0]["status"] == "unchanged"


def test_among_the_most_probable_guesses_the_greater_text_wins(spark):
    """Generated answers whose guesses tie at the highest probability, in any order and with either tag."""
    rng, texts, want = random.Random(11), [], []
    for _ in range(30):
        guesses = rng.sample(["elm", "oak", "ash", "fir", "yew"], 3)
        records = [(g, rng.choice(["yes", "no"]), p) for g, p in zip(guesses, ["0.3", "0.3", rng.choice(["0.1", "0.3"])])]
        rng.shuffle(records)
        texts.append((written(records, "\n\n---"),))
        want.append(max((float(p), f"{g} <{tag}>") for g, tag, p in records)[1])
    rows = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "i int, t string")
    got = rows.select("i", text.best_guess(F.col("t"))["guess"].alias("g")).orderBy("i").collect()
    assert [r["g"].strip() for r in got] == want


def test_no_guess_is_unknown(spark):
    assert spark.createDataFrame([("nothing",)], "t string").select(text.best_guess(F.col("t")).alias("g")).first()["g"] is None


def test_released_repeats_show_the_last_listing(spark):
    s = spark.createDataFrame([(1, 0, "s", 1)], "a int, pos int, sentence string, index int")
    r = spark.createDataFrame([(1, 0, 1, "u1", "x"), (1, 1, 1, "u2", "y")], "a int, pos int, index int, url string, source string")
    assert sorted(x["url"] for x in text.match_references(s, r, ["a"]).collect()) == ["u1", "u2"]
    assert [x["url"] for x in text.match_references(s, r, ["a"], "released").collect()] == ["u2", "u2"]


def test_separator_chunks_keep_everything(spark):
    t = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(i * 7 % 90)) for i in range(30)) + "\n" + "z" * 2500
    got = spark.createDataFrame([(t,)], "t string").select(text.separator_chunks(F.col("t"), 200).alias("c")).first()["c"]
    assert max(map(len, got)) <= 200
    assert "".join("".join(got).split()) == "".join(t.split())


# -- pages, vectors --------------------------------------------------------------------

ELEVEN = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize("page, rule, want", [
    (f"<h1>{ELEVEN}</h1><p>one two three four five six seven eight nine ten</p><p>{ELEVEN} &amp; more</p>", 0, f"{ELEVEN}\n{ELEVEN} & more"),
    (f"<div>{ELEVEN}</div><p>{ELEVEN} p</p>", 0, f"{ELEVEN} p"),
    (f"<div>{ELEVEN}</div><p>{ELEVEN} p</p>", 1, f"{ELEVEN}\n{ELEVEN} p"),
    ("<p>하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉 열 열하나</p>", 0, "하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉 열 열하나"),
    (f"<p>{ELEVEN} a<p>{ELEVEN} b", 0, f"{ELEVEN} a\n{ELEVEN} b"),
    (f"<pre>{ELEVEN}</pre><script>{ELEVEN}</script>", 0, ELEVEN)])
def test_main_content(spark, page, rule, want):
    assert spark.createDataFrame([(page,)], "h string").select(html.main_contents(F.col("h"))["wide" if rule else "narrow"].alias("t")).first()["t"] == want


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0]), ("c", [-1.0, 0.0, 0.0])], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(5)], "query_id int, embedding array<double>")
    got = retrieve.nearest(q.where("query_id = 0"), v, 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["distance"]) for r in got] == [("a", 0.0), ("b", pytest.approx(0.02))]
    many = retrieve.nearest(q, v, 2, block=2).groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("v")).collect()
    assert sorted((r["query_id"], r["v"]) for r in many) == [(i, ["a", "b"]) for i in range(5)]


def test_vector_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 3)
    monkeypatch.setattr(retrieve, "BLOCKS_PER_CELL", 2)
    rows = [(i, [float(i * 7 % 11), float(i * 5 % 13)]) for i in range(40)]
    v = spark.createDataFrame([*rows, (99, None)], "vec_id long, embedding array<double>")
    got = retrieve.nearest(v.withColumnRenamed("vec_id", "query_id"), v, 4, block=3).orderBy("query_id", "rank").collect()
    want = [(q, *near) for q, x in rows for near in sorted(((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2, i) for i, y in rows)[:4]]
    assert [(r["query_id"], r["distance"], r["vec_id"]) for r in got] == want


# -- evidence and bytes ------------------------------------------------------------------

def plan(spark, *files):
    e = spark.createDataFrame([("c", "a", 0, False), ("c", "b", 1, False), ("c", "Latency", 2, True)], "case string, entity string, pos int, is_kpi boolean")
    return evidence.evidence_plan(e, spark.createDataFrame([("c", *f) for f in files], "case string, entity string, kind string"))


def test_evidence_routes(spark):
    p = plan(spark, ("a", "templates"), ("a", "structured"))
    texts = lambda *r: spark.createDataFrame([("c", *x) for x in r], "case string, entity string, text string")
    got = evidence.merge_summaries(p, texts(("a", "fine"))).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["fine", evidence.ABSENT_NOTICE, evidence.KPI_NOTICE]
    assert [r["available"] for r in got] == [True, False, None]
    for wrong in ([("b", "x")], [("a", "x"), ("zz", "y")], [("a", " ")], [("a", "x"), ("Latency", "y")]):
        with pytest.raises(GateError):
            evidence.merge_summaries(p, texts(*wrong))
    with pytest.raises(GateError):
        plan(spark, ("a", "templates"))


def test_bad_bytes_are_counted(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"ok\nbad \xc3 one\nbad \xff\xfe two\n")
    rows = spark.read.text(str(tmp_path)).select(F.lit("f").alias("file"), "value")
    got = logs.byte_report(rows, ["file"], ["value"]).first()
    assert (got["bad_bytes"], got["bad_rows"]) == (3, 2)


# -- whole tables ------------------------------------------------------------------

def test_queries_over_all_words_values_and_lines(spark):
    import __spark_entry__

    d, found = "/root/testdata/sf0.001", __spark_entry__.queries()
    words = spark.read.parquet(f"{d}/conversations.parquet").agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    events = spark.read.parquet(f"{d}/events.parquet")
    assert found["fn01_normal_words"](spark, d).count() == words
    verdicts = found["fn11_debate_verdict_any_value"](spark, d)
    assert verdicts.count() == events.count()
    assert verdicts.join(events.where("value > 100"), "event_id").where("early is not null or final is not null").count() == 0
    lines = found["jn07_all_template_lines"](spark, d)
    assert lines.count() == events.count() and lines.where("content not like '%7%'").count() > 0
