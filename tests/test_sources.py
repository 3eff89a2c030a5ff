"""Stores, bootstrap, the routing law and streams."""

import json

import pytest
from pyspark.sql import functions as F

from stemma.operators import rules, state
from stemma.sources import law, store
from stemma.streaming import events

REGISTRY = {"version": "1", "organs": {
    "o-one": {"name": "One", "repositories": [{"name": "r1", "org": "x", "status": "A", "tier": "t"}, {"name": "r2", "org": "x", "promotion_status": "p"}]},
    "o-two": {"name": "Two", "repositories": [{"name": "r3", "org": "y", "public": True}, {"name": "r4", "org": "y"}]},
}}


def test_logs_skip_what_is_malformed(spark, tmp_path):
    (tmp_path / "names.jsonl").write_text('{"entity_id": "e", "display_name": "My Repo", "valid_from": "2026"}\n\nnot json\n{"display_name": "x"}\n{"entity_id": "f", "display_name": "B", "slug": "s", "is_primary": false}\n')
    (tmp_path / "edges.jsonl").write_text('{"edge_type": "hierarchy", "parent_id": "a", "child_id": "b"}\n{"edge_type": "relation", "source_id": "a", "target_id": "b", "relation_type": "t"}\n{"edge_type": "odd"}\n{"edge_type": "hierarchy", "parent_id": "a"}\n')
    (tmp_path / "lineage.jsonl").write_text('{"entity_id": "a", "related_id": "b", "lineage_type": "derived_from"}\n{"entity_id": "a", "related_id": "b", "lineage_type": "odd"}\n')
    (tmp_path / "entities.json").write_text(json.dumps({"e": {"uid": "e", "entity_type": "repo", "metadata": {"k": 1}}}))
    s = store.Store(spark, str(tmp_path))
    assert [(r["entity_id"], r["slug"], r["is_primary"]) for r in s.names().orderBy("seq").collect()] == [("e", "my-repo", True), ("f", "s", False)]
    assert (s.hierarchy_edges().count(), s.relation_edges().count(), s.lineage().count()) == (1, 1, 1)
    assert [(r["uid"], r["lifecycle_status"], r["metadata"]) for r in s.entities().collect()] == [("e", "active", '{"k":1}')]


def test_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.append("observations", spark.createDataFrame([(1, "m", "e", 2.5)], "seq long, metric_id string, entity_id string, value double"))
    s.append("observations", spark.createDataFrame([(2, "m", "e", 3.5)], "seq long, metric_id string, entity_id string, value double"))
    assert sorted(r["value"] for r in s.observations().collect()) == [2.5, 3.5]
    s.save_keyed("metrics", spark.createDataFrame([("m2", "B"), ("m1", "A")], "metric_id string, name string"), "metric_id")
    assert sorted((r["metric_id"], r["name"]) for r in s.metrics().collect()) == [("m1", "A"), ("m2", "B")]


def test_bootstrap_is_idempotent(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(REGISTRY))
    repos = store.repositories(spark, str(tmp_path / "r.json"))
    nothing, no_edges = spark.createDataFrame([], "uid string, entity_type string, tag string"), spark.createDataFrame([], "parent_id string, child_id string, valid_to string")
    made, links = store.bootstrap(repos, nothing, no_edges, 1_767_225_600_000)
    assert sorted((r["entity_type"], r["tag"]) for r in made.collect()) == [("organ", "o-one"), ("organ", "o-two"), ("repo", "x/r1"), ("repo", "x/r2"), ("repo", "y/r3"), ("repo", "y/r4")]
    assert links.count() == 4
    again, more = store.bootstrap(repos, made, links.withColumn("valid_to", F.lit(None).cast("string")), 1_767_225_600_001)
    assert (again.count(), more.count()) == (0, 0)


def test_registry_sensor(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(REGISTRY))
    changed = json.loads(json.dumps(REGISTRY))
    changed["organs"]["o-one"]["repositories"][1]["promotion_status"] = "q"
    changed["organs"]["o-two"]["repositories"][0]["name"] = "r9"
    (tmp_path / "b.json").write_text(json.dumps(changed))
    a, b = (store.tracked(store.repositories(spark, str(tmp_path / f"{n}.json"))) for n in "ab")
    got = state.registry_changes(a, b, ["status", "tier", "promotion_status", "implementation_status", "ci_workflow"]).collect()
    assert {tuple(r) for r in got} == {("r9", "file_created", None, None, None), ("r3", "file_deleted", None, None, None), ("r2", "promotion_changed", "promotion_status", "p", "q")}


def test_law(spark):
    text = 'schema_version: "1.0"\n\ndimensions:\n  scope:\n    - organ\n    - system\nrules:\n  - id: 1\n    match:\n      security: secret\n    target: vault # kept\n  - id: 2\n    match:\n      scope: organ\n      planet: mars\n    target: never\n  - id: 3\n    match: {}\n    target: "~/in/"\n'
    parsed = law.parse(text)
    assert parsed["dimensions"] == {"scope": ["organ", "system"]} and parsed["rules"][1]["match"] == {"scope": "organ", "planet": "mars"}
    df = spark.createDataFrame([("a", None, None, None, "organ", "secret"), ("b", None, None, None, "organ", None)], "id string, function string, material string, pattern string, scope string, security string")
    assert {r["id"]: (r["rule_id"], r["target"]) for r in rules.route(df, parsed["rules"]).collect()} == {"a": (1, "vault"), "b": (3, "~/in/")}
    assert rules.route(df, []).select("rule_id", "target").distinct().collect()[0]["target"] == "intake/"


def test_streams(spark, tmp_path):
    logs = tmp_path / "log"
    logs.mkdir()
    (logs / "1.jsonl").write_text('{"event_type": "a", "timestamp": "2026-01-01T00:00:00Z"}\nbroken\n{"event_type": "b", "timestamp": "2026-01-01T00:30:00Z"}\n{"event_type": "a", "timestamp": "2026-01-01T01:30:00Z"}\n')
    seen = []
    stream = events.event_stream(spark, str(logs))
    events.dispatch(stream, {"a": [lambda df: seen.append(("a", df.count()))], "*": [lambda df: seen.append(("*", df.count()))]}, str(tmp_path / "c1")).awaitTermination()
    assert seen == [("a", 2), ("*", 3)]
    q = events.windowed(events.event_stream(spark, str(logs))).writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("wins").collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_value_changes_across_batches(spark, tmp_path):
    src = tmp_path / "v"
    src.mkdir()
    out, checkpoint = [], str(tmp_path / "c3")
    for n, rows in enumerate((["e 1 x", "f 1 y"], ["e 2 x", "e 3 z", "f 2 w"])):
        (src / f"{n}.txt").write_text("\n".join(rows))
        parts = F.split("value", " ")
        stream = spark.readStream.text(str(src)).select(parts[0].alias("entity_id"), parts[1].cast("long").alias("seq"), parts[2].alias("value"))
        events.value_changes(stream).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("e", "x", "z"), ("f", "y", "w")]


@pytest.mark.parametrize("n", [0, 1, 400])
def test_whole_values_are_written_in_parts(spark, tmp_path, n):
    """A keyed and a listed table are one JSON value each, in order, made and read in many tasks; one line of all is read as well."""
    s = store.Store(spark, str(tmp_path))
    ids = [f'k"{i:04d}{{,' for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    s.save_keyed("entities", spark.createDataFrame([(k, "repo") for k in reversed(ids)], "uid string, entity_type string").repartition(4), "uid")
    s.save_listed("variables", spark.createDataFrame([(i, f"k{i}", "[x") for i in range(n)], "seq long, key string, value string").repartition(4))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).rglob("part-*.txt")))
    assert list(json.loads(read("entities.json"))) == ids and [x["key"] for x in json.loads(read("variables.json"))] == [f"k{i}" for i in range(n)]
    assert sorted(r["uid"] for r in s.entities().collect()) == ids
    assert [r["key"] for r in s.variables().orderBy("seq").collect()] == [f"k{i}" for i in range(n)]
    if n == 400:
        assert max(sum(1 for _ in p.open()) for p in (tmp_path / "entities.json").rglob("part-*.txt")) < n
        for name, x in (("entities", {"a": {"uid": "a"}, "b": {"uid": "b"}}), ("variables", [{"key": "a"}, {"key": "b"}])):
            (tmp_path / "old" / f"{name}.json").mkdir(parents=True)
            (tmp_path / "old" / f"{name}.json" / "part-00000.txt").write_text(json.dumps(x) + "\n")
        old = store.Store(spark, str(tmp_path / "old"))
        assert sorted(r["uid"] for r in old.entities().collect()) == ["a", "b"] and [r["key"] for r in old.variables().orderBy("seq").collect()] == ["a", "b"]


def test_lines_are_parsed_once(spark, tmp_path):
    """Filters don't repeat the parsing; a kind of edge spelt with escapes is found as well."""
    (tmp_path / "edges.jsonl").write_text('{"edge_type": "hier\\u0061rchy", "parent_id": "a", "child_id": "b"}\n{"edge_type": "relation", "source_id": "hierarchy", "target_id": "b", "relation_type": "t"}\n{"edge_type": "hierarchy", "parent_id": "c", "child_id": "d"}\n')
    edges = store.Store(spark, str(tmp_path)).hierarchy_edges()
    assert sorted(r["parent_id"] for r in edges.collect()) == ["a", "c"]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_logs_are_small_and_in_order(spark, tmp_path, monkeypatch):
    """A log's parts are gzip, of few lines each, and more of them than their numbers' digits foresee keep their order; the shuffles
    that led to them are gone. Tables may be written over what their rows are read from."""
    from stemma.session import CLEANUP

    monkeypatch.setattr(store, "LINES", 2)
    s, before = store.Store(spark, str(tmp_path)), spark.conf.get(CLEANUP, None)
    rows = spark.range(2500, numPartitions=1).select(F.col("id").alias("seq"), F.lit("m").alias("metric_id"), F.lit("e").alias("entity_id"), F.col("id").cast("double").alias("value"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    s.append("observations", rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    parts = [p for p in tmp_path.rglob("part-*") if not p.name.startswith(".")]
    assert len(parts) == 1250 and all(p.name.endswith(".gz") for p in parts)
    assert [r["value"] for r in s.observations().orderBy("seq").collect()] == list(map(float, range(2500)))
    assert spark.conf.get(CLEANUP, None) in (before, "false")
    s.save_listed("variables", spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "seq long, key string, value string"))
    for _ in range(2):
        s.save_listed("variables", s.variables().select("seq", "key", "value"))
    assert [r["key"] for r in s.variables().orderBy("seq").collect()] == ["a", "b"]
