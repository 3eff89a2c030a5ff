"""Order of insertion: logs that several appends made, rows that one mutation adds, and numbers without a window."""

import json

import pytest
from pyspark.sql import functions as F
from test_registry import empty

from stemma.operators import graph, metrics, mutate, rules, sensing, temporal
from stemma.registry import open_store
from stemma.session import checkpointed, numbered
from stemma.sources import store
from stemma.streaming.events import Bus

AT = "2026-05-01 00:00:00"


def test_appends_keep_their_order(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    (tmp_path / "observations.jsonl").write_text('{"metric_id": "m", "entity_id": "e", "value": 0.5}\n')
    for i, source in enumerate(["x", "long " * 5000, "y"]):
        s.append("observations", spark.createDataFrame([(1, "m", "e", float(i + 1), source)], "seq long, metric_id string, entity_id string, value double, source string"))
    assert [r["value"] for r in s.observations().orderBy("seq").collect()] == [0.5, 1.0, 2.0, 3.0]
    assert [r["value"] for r in metrics.latest(s.observations()).collect()] == [3.0]
    many = spark.range(20000).select(F.col("id").alias("seq"), F.lit("m2").alias("metric_id"), F.lit("e").alias("entity_id"), F.col("id").cast("double").alias("value"))
    s.append("observations", many.orderBy(F.rand(1)))
    got = [r["value"] for r in s.observations().where("metric_id = 'm2'").orderBy("seq").collect()]
    assert got == [float(i) for i in range(20000)]


def test_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "events.jsonl").write_text("".join(json.dumps({"event_type": "t", "new_value": str(i)}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = store.Store(spark, str(tmp_path)).events()
        assert rows.rdd.getNumPartitions() > 3
        assert [r["new_value"] for r in rows.orderBy("seq").collect()] == [str(i) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.createDataFrame([(i * 37 % 101, None if i == 5 else f"n{i % 4}") for i in range(101)], "a int, b string")
    got = numbered(rows, ["b", "a"]).collect()
    assert sorted(r["seq"] for r in got) == list(range(1, 102))
    assert [(r["b"] or "", r["a"]) for r in sorted(got, key=lambda r: r["seq"])] == sorted((r["b"] or "", r["a"]) for r in got)
    assert numbered(rows.limit(0), ["a"]).collect() == []


def edges(spark, rows):
    return spark.createDataFrame([(i + 1, p, c, "2020", None) for i, (p, c) in enumerate(rows)], "seq long, parent_id string, child_id string, valid_from string, valid_to string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


@pytest.mark.parametrize("turned", [False, True])
def test_merge_appends_by_source(spark, turned):
    groups = [(2, "a", "m"), (1, "b", "m")] if turned else [(1, "a", "m"), (2, "b", "m")]
    e = spark.createDataFrame([(1, "a", "repo", "active"), (2, "b", "module", "active")], "seq long, uid string, entity_type string, lifecycle_status string")
    h = edges(spark, [("p", "a"), ("q", "b"), ("a", "k1"), ("b", "k2"), ("a", "k3")])
    out = mutate.merge(e, h, spark.createDataFrame(groups, "seq long, source_uid string, successor string"), AT)
    new = [(r["parent_id"], r["child_id"]) for r in out["edges"].where("seq > 5").orderBy("seq").collect()]
    a, b = [("m", "k1"), ("m", "k3"), ("p", "m")], [("m", "k2"), ("q", "m")]
    assert new == (b + a if turned else a + b)
    assert out["edges"].select("seq").distinct().count() == 10
    assert [r["parent_id"] for r in temporal.parent_of(out["edges"], AT).where("child_id = 'm'").collect()] == ["p" if turned else "q"]
    assert [tuple(r) for r in out["result"].collect()] == [("m", 2, 2, 5, 5)]
    assert out["entities"].where("uid = 'm'").collect()[0]["entity_type"] == ("module" if turned else "repo")


def test_events_follow_each_other(spark):
    r = empty(spark).create(spark.createDataFrame([("b", "repo", "B", 1), ("a", "repo", "A", 2)], "uid string, entity_type string, display_name string, seq long"))
    r = r.set_status(spark.createDataFrame([("a",)], "uid string"), "archived")
    assert [(x["seq"], x["subject_entity"]) for x in r.events.orderBy("seq").collect()] == [(1, "b"), (2, "a"), (3, "a")]
    assert [x["uid"] for x in r.entities.orderBy("seq").collect()] == ["b", "a"]


def test_store_of_a_registry(spark, tmp_path):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    r = empty(spark).create(df([("a", "repo", "Alpha"), ("b", "organ", "Beta")], "uid string, entity_type string, display_name string"))
    r = r.rename(df([("a", "Gamma")], "entity_id string, display_name string"))
    r.save(str(tmp_path))
    back = open_store(spark, str(tmp_path), AT)
    assert {x["uid"]: x["display_name"] for x in back.recovered().collect()} == {"a": "Gamma", "b": "Beta"}
    assert {x["uid"]: (x["entity_type"], x["primary_name"]) for x in back.state_at(AT).collect()} == {"a": ("repo", "Gamma"), "b": ("organ", "Beta")}
    back.create(df([("c", "repo", "See")], "uid string, entity_type string, display_name string")).save(str(tmp_path))
    assert open_store(spark, str(tmp_path), AT).names.count() == 4
    nothing = open_store(spark, str(tmp_path / "none"), AT)
    assert nothing.entities.count() == nothing.events.count() == nothing.variables.count() == 0


def test_depths_and_cycles(spark):
    up = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "y"), ("s", "s")]
    got = {r["node"]: r["depth"] for r in graph.depths(spark.createDataFrame(up, "node string, parent string")).collect()}
    assert got == {f"n{i}": 40 - i for i in range(40)} | {"x": 2, "y": 1, "z": 1}


def test_deep_descent_in_order(spark):
    rows = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(15)] + [("n3", "side", 99), ("n14", "n0", 100)], "src string, dst string, seq long")
    got = graph.descend(checkpointed(rows), spark.createDataFrame([("n0",)], "root string"), stored=True)
    assert {r["node"]: r["depth"] for r in got.collect()} == {f"n{i}": i for i in range(1, 16)} | {"side": 4}
    assert {r["node"]: r["path"][-2] for r in got.where("node = 'side'").collect()} == {"side": "n3"}


def test_references_in_a_circle_raise(spark):
    v = spark.createDataFrame([(1, "a", "global", None, "b", "reference"), (2, "b", "global", None, "a", "reference"), (3, "c", "global", None, "none", "reference")], "seq long, key string, scope string, entity_id string, value string, mutability string")
    ask = spark.createDataFrame([(1, "c", "global", {})], "request_id int, key string, scope string, chain map<string,string>")
    assert [tuple(r) for r in rules.resolve_variables(ask, v.where("key = 'c'"), "d").collect()] == [(1, "c", "global", None, "reference")]
    with pytest.raises(ValueError, match="circle"):
        rules.resolve_variables(ask, v)


def test_constraints_of_a_row(spark):
    kind = "allowed_values array<string>, min_value double, max_value double, pattern string, required boolean"
    rows = [(None, (None, None, None, None, True), "required"), (None, (["a"], 1.0, None, None, False), None), ("b", (["a"], None, None, None, None), "allowed_values"), ("5", (None, 6.0, None, None, None), "min_value"), ("7", (None, 6.0, 6.5, None, None), "max_value"), ("word", (None, 6.0, None, "wo", None), None), ("sword", (None, None, None, "wo", None), "pattern"), ("x", None, None)]
    df = spark.createDataFrame(rows, f"value string, constraint struct<{kind}>, want string")
    assert df.where(~rules.broken(F.col("value"), F.col("constraint")).eqNullSafe(F.col("want"))).count() == 0


def test_registry_sensor_and_failing_sensors(spark, tmp_path):
    path = tmp_path / "registry.json"
    repo = lambda name, status: {"name": name, "org": "x", "status": status}
    write = lambda *repos: path.write_text(json.dumps({"organs": {"o": {"name": "O", "repositories": list(repos)}}}))
    assert sensing.scan_registry(spark, str(path)) [1] is None
    write(repo("r1", "A"), repo("r2", "A"))
    first, kept = sensing.scan_registry(spark, str(path))
    same, kept = sensing.scan_registry(spark, str(path), kept)
    assert first.count() == same.count() == 0
    path.write_text("{broken")
    odd, kept = sensing.scan_registry(spark, str(path), kept)
    assert [(r["signal_type"], r["value"]) for r in odd.collect()] == [("registry_updated", "parse_failure")]
    write(repo("r1", "B"), repo("r3", "A"))
    got, kept = sensing.scan_registry(spark, str(path), kept)
    assert {(r["entity_id"], r["signal_type"], r["previous_value"], r["value"]) for r in got.collect()} == {("r1", "registry_updated", "A", "B"), ("r2", "file_deleted", None, None), ("r3", "file_created", None, None)}

    def fails():
        raise OSError("no disk")

    late = lambda: got.withColumn("value", F.raise_error(F.lit("late")).cast("string"))
    sensors = [sensing.Sensor("registry", lambda: got), sensing.Sensor("broken", fails), sensing.Sensor("late", late), sensing.Sensor("away", fails, lambda: False)]
    changes, failed = sensing.scan_sensors(spark, sensors)
    assert changes.count() == 3 and failed == ["broken", "late"]


def test_bus():
    bus, f, g = Bus(), lambda df: None, lambda df: None
    for kind, h in (("a", f), ("a", f), ("a", g), ("*", g)):
        bus.subscribe(kind, h)
    bus.unsubscribe("a", f)
    bus.unsubscribe("b", f)
    assert bus.handlers == {"a": [f, g], "*": [g]}
    bus.clear()
    assert bus.handlers == {}


def test_new_identifiers(spark):
    rows = spark.createDataFrame([("k1", "t", "rename", ["e"]), ("k2", "t", None, None)], "key string, title string, action string, affected_entities array<string>")
    made = rules.create_revisions(rows.withColumn("triggered_by", F.lit(None).cast("string")), F.lit(1_767_225_600_000)).collect()
    assert len({r["revision_id"] for r in made}) == 2 and all(r["revision_id"].startswith("rev_") and len(r["revision_id"]) == 30 and r["status"] == "detected" and r["triggered_by"] == "manual" for r in made)
    log = rows.select("key", F.lit("2026").alias("timestamp"), F.lit("merge").alias("change_type"), F.lit("why").alias("change_reason"), "affected_entities", F.lit(None).cast("string").alias("details"))
    versions = store.create_versions(log, F.lit(1_767_225_600_000)).collect()
    assert {r["version_id"][:3] for r in versions} == {"sv_"} and sorted(len(r["affected_entities"]) for r in versions) == [0, 1]
