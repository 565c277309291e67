"""Scans and writers on small files."""

import csv
import gzip
import json

import pytest
from pyspark.sql import functions as F

from rcaspark.operators.profile import GateError, require
from rcaspark.sources import logs, metrics, sinks


def test_pod_files_keep_entity_and_order(spark, tmp_path):
    (tmp_path / "web-1_messages_templates.csv").write_text('EventId,EventTemplate,Occurrence\nE2,"start, <*>",21\nE1,stop,3\n')
    (tmp_path / "web-1_messages_structured.csv").write_text('LineId,Time,Content,EventId,EventTemplate,ParameterList\n1,t1,"start, now",E2,"start, <*>",[]\n2,t2,stop,E1,stop,[]\n')
    t = logs.read_templates(spark, f"{tmp_path}/*_messages_templates.csv").orderBy("pos").collect()
    assert [(r["entity"], r["event_id"], r["template"], r["occurrence"]) for r in t] == [("web-1", "E2", "start, <*>", 21), ("web-1", "E1", "stop", 3)]
    s = logs.read_structured(spark, f"{tmp_path}/*_messages_structured.csv").orderBy("pos").collect()
    assert [(r["event_id"], r["content"], r["pos"]) for r in s] == [("E2", "start, now", 1), ("E1", "stop", 2)]
    files = logs.log_files(logs.file_catalog(spark, str(tmp_path)), tmp_path.name).collect()
    assert sorted((r["entity"], r["kind"]) for r in files) == [("web-1", "structured"), ("web-1", "templates")]


def test_structured_contents_keep_line_breaks(spark, tmp_path):
    rows = ['1,t1,"first\nsecond, ""quoted""",E1,x,[]', "2,t2,plain,E2,y,[]"]
    for pod in ("web-1", "db-2"):
        (tmp_path / f"{pod}_messages_structured.csv").write_text("\n".join(["LineId,Time,Content,EventId,EventTemplate,ParameterList", *rows, ""]))
    got = logs.read_structured(spark, f"{tmp_path}/*_messages_structured.csv").collect()
    assert sorted((r["entity"], r["pos"], r["content"], r["event_id"]) for r in got) == [
        (pod, *row) for pod in ("db-2", "web-1") for row in ((1, 'first\nsecond, "quoted"', "E1"), (2, "plain", "E2"))]


@pytest.mark.parametrize("split", ["64", "700", "100000"])
def test_a_structured_file_is_read_by_several_tasks(spark, tmp_path, split):
    def content(i):
        return [f"plain {i}", f'a, "quoted" {i}', f"line\nafter\nline {i}", "x\n" * (i % 40) + "end", '"', f"{i}\r\nwindows"][i % 6]

    for pod in ("web-1", "db-2"):
        with open(tmp_path / f"{pod}_messages_structured.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n" if pod == "web-1" else "\r\n")
            writer.writerow(["LineId", "Time", "Content", "EventId", "EventTemplate", "ParameterList"])
            writer.writerows([i, f"t{i}", content(i), f"E{i % 3}", "t, x", "[]"] for i in range(300))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, split)
    try:
        found = logs.read_structured(spark, f"{tmp_path}/*_messages_structured.csv")
        got = sorted((r["entity"], r["pos"], r["time"], r["content"], r["event_id"]) for r in found.collect())
        tasks = logs.quoted_records(spark, f"{tmp_path}/web-1*").select("block").distinct().count()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert got == [(pod, i, f"t{i}", content(i), f"E{i % 3}") for pod in ("db-2", "web-1") for i in range(300)]
    assert tasks > 3 or split == "100000"


def test_matrix_files_without_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}, {i * i} 5\n" + "\n" * (i % 3 == 0) for i in range(500)))
    (tmp_path / "b.txt").write_text("0 x 5\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        m = metrics.read_matrix(spark, str(tmp_path))
        got = {(r["file"][-5:], r["row"]): r["cells"] for r in m.collect()}
        z = {(r["file"][-5:], r["row"]): r["cells"] for r in metrics.scored_matrix(m).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.txt", i): [i, i * i, 5] for i in range(500)} | {("b.txt", 0): [0, None, 5]}
    x = [*range(500), 0]
    mean = sum(x) / 501
    spread = (sum((v - mean) ** 2 for v in x) / 501) ** 0.5
    assert z["a.txt", 7][0] == pytest.approx((7 - mean) / spread) and z["a.txt", 7][2] is None and z["b.txt", 0][1] is None


def test_entity_of_files_and_folders(spark):
    paths = ["/a/b/web=1_messages_templates.csv", "file:/a/file=db-2_messages_structured.csv/part-0.csv", "C:\\x\\p_messages_templates.csv", "/a/other.csv"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: (r["e"], r["k"]) for r in rows.select("path", logs.entity_of(F.col("path")).alias("e"), logs.kind_of(F.col("path")).alias("k")).collect()}
    assert [got[p] for p in paths] == [("web=1", "templates"), ("db-2", "structured"), ("p", "templates"), ("", "")]


def test_hits_with_absent_fields(spark, tmp_path):
    page = {"hits": {"hits": [{"_source": {"@timestamp": "t", "kubernetes": {"pod_name": "p"}}}, {"_source": {"message": "m"}}]}}
    (tmp_path / "h.json").write_text(json.dumps(page, indent=1))
    got = logs.read_hits(spark, str(tmp_path), one_per_line=False).collect()
    assert sorted(tuple(r) for r in got if r["pod"]) == [("t", "p", None)] and len(got) == 2


def test_gzip_lines(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"one\ntwo \xc3\n"))
    got = logs.line_volume(logs.read_lines(spark, f"{tmp_path}/*.gz"), logs.base_name(F.col("path")).alias("f")).first()
    assert (got["f"], got["records"], got["bytes"]) == ("a.gz", 2, 10)


def test_panel_rules(spark):
    schema = "case string, metric string, pods array<string>, time array<double>, seq array<array<double>>"
    good = spark.createDataFrame([("c", "m", ["a", "b"], [1.0, 2.0], [[1.0, 2.0, 9.0], [3.0, 4.0, 8.0]])], schema)
    got = metrics.panel_to_long(require(good, metrics.panel_rules())).where("is_kpi").orderBy("ts").collect()
    assert [(r["entity"], r["value"]) for r in got] == [("Latency", 9.0), ("Latency", 8.0)]
    for bad in ((["a", "a"], [1.0], [[1.0, 2.0, 3.0]]), (["a"], [2.0, 1.0], [[1.0, 2.0]] * 2), (["a"], [1.0], [[1.0]]), (["a"], [1.0], [[1.0, float("nan")]]), (["a"], [1.0, 2.0], [[1.0, 2.0]])):
        with pytest.raises(GateError):
            require(spark.createDataFrame([("c", "m", *bad)], schema), metrics.panel_rules())


def test_write_once(spark, tmp_path):
    a = spark.range(5)
    path = f"{tmp_path}/t"
    assert sinks.write_same(a, path) and not sinks.write_same(a.repartition(3), path)
    with pytest.raises(GateError):
        sinks.write_same(spark.range(6), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_new(a, path)


def test_other_identity_is_refused(spark, tmp_path):
    sinks.write_identified(spark.range(3), f"{tmp_path}/v", "one")
    assert sinks.read_identified(spark, f"{tmp_path}/v", "one").count() == 3
    with pytest.raises(GateError):
        sinks.read_identified(spark, f"{tmp_path}/v", "two")


def test_wide_csv_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([(2, 0.1 + 0.2, 5.0), (1, 1e-17, 6.0)], "ts int, a double, Latency double")
    sinks.write_wide_csv(wide, f"{tmp_path}/w", ["a", "Latency"])
    got = metrics.read_wide(spark, f"{tmp_path}/w/values", ["a", "Latency"]).where("entity = 'a'").collect()
    assert sorted(r["value"] for r in got) == [1e-17, 0.1 + 0.2]
    in_order = metrics.read_wide(spark, f"{tmp_path}/w/values", ["a", "Latency"]).where("is_kpi").orderBy("file", "row").collect()
    assert [r["value"] for r in in_order] == [6.0, 5.0]  # time order
    assert {(r["entity"], r["is_kpi"]) for r in metrics.read_wide(spark, f"{tmp_path}/w/values", ["a", "Latency"]).collect()} == {("a", False), ("Latency", True)}


def test_wide_rows_keep_time_order_over_splits(spark, tmp_path):
    spark.range(20_000).selectExpr("id ts", "cast(id as double) a", "-cast(id as double) Latency").createOrReplaceTempView("steps")
    sinks.write_wide_csv(spark.table("steps"), f"{tmp_path}/w", ["a", "Latency"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = metrics.read_wide(spark, f"{tmp_path}/w/values", ["a", "Latency"]).where("entity = 'a'").orderBy("file", "row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in got] == [float(i) for i in range(20_000)]


def test_answers_written_again_are_not_doubled(spark, tmp_path):
    def rows(variant, answers):
        return spark.createDataFrame([("c", "pc", variant, a) for a in answers], "case string, algorithm string, variant string, answer string")

    sinks.write_answers(rows("one", ["x", "y"]).unionByName(rows("two", ["z"])), f"{tmp_path}/a")
    sinks.write_answers(rows("one", ["x", "w"]), f"{tmp_path}/a")
    assert sorted(r["answer"] for r in sinks.read_answers(spark, f"{tmp_path}/a", "c", "pc", "one").collect()) == ["w", "x"]
    assert sinks.read_answers(spark, f"{tmp_path}/a", "c", "pc", "two").count() == 1
