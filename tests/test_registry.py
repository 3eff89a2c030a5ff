"""The facade: mutations in a row, with their events, and what recovery makes of them."""


from stemma.operators import sensing
from stemma.registry import Registry
from stemma.sources import workspace

AT = "2026-05-01 00:00:00"


def empty(spark):
    t = lambda s: spark.createDataFrame([], s)
    window = "valid_from timestamp_ntz, valid_to timestamp_ntz"
    return Registry(
        t("seq long, uid string, entity_type string, lifecycle_status string"), t(f"seq long, entity_id string, display_name string, is_primary boolean, {window}"),
        t(f"seq long, parent_id string, child_id string, {window}"), t(f"seq long, source_id string, target_id string, relation_type string, {window}"),
        t("seq long, entity_id string, related_id string, lineage_type string"), t("seq long, metric_id string, entity_id string, value double, ts timestamp_ntz"),
        t("seq long, event_type string, subject_entity string, entity_type string, new_value string, ts timestamp_ntz"), t("seq long, key string, scope string, entity_id string, value string, mutability string"), AT,
    )


def test_life_of_a_registry(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    r = empty(spark).create(df([("a", "repo", "Alpha"), ("b", "repo", "Beta")], "uid string, entity_type string, display_name string"))
    r = r.rename(df([("a", "Gamma")], "entity_id string, display_name string")).set_status(df([("b",)], "uid string"), "archived")
    got = {x["identifier"]: x["uid"] for x in r.resolve(df([("gamma",), ("alpha",), ("beta",)], "identifier string")).collect()}
    assert got == {"gamma": "a", "alpha": "a", "beta": "b"}
    assert {x["uid"]: (x["lifecycle_status"], x["display_name"]) for x in r.recovered().collect()} == {"a": ("active", "Gamma"), "b": ("archived", "Beta")}
    r = r.merge(df([(1, "a", "m"), (2, "b", "m")], "seq long, source_uid string, successor string"))
    assert {x["uid"]: x["lifecycle_status"] for x in r.entities.collect()} == {"a": "deprecated", "b": "deprecated", "m": "active"}
    assert r.lineage.count() == 2 and {x["uid"] for x in r.recovered().collect()} == {"a", "b"}
    assert sorted(x["event_type"] for x in r.events.collect()) == ["entities.merged", "entity.archived", "entity.created", "entity.created", "entity.renamed"]


def test_workspace_sensors(spark, tmp_path):
    for p in ("one/.git", "org/two/.git", ".hidden/.git", "plain"):
        (tmp_path / p).mkdir(parents=True)
    before, ci = workspace.repositories(spark, str(tmp_path)), workspace.ci_state(spark, str(tmp_path))
    assert sorted(r[0] for r in before.collect()) == ["one", "two"]
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "seed.yaml").write_text("x: 1")
    (tmp_path / "one" / ".github" / "workflows").mkdir(parents=True)
    (tmp_path / "one" / ".github" / "workflows" / "ci.yml").write_text("on: push")
    files = sensing.filesystem_signals(before, workspace.repositories(spark, str(tmp_path)))
    flips = sensing.ci_signals(ci, workspace.ci_state(spark, str(tmp_path)))
    changes = sensing.scan_all(files, flips, sensing.git_signals(workspace.recent_commits(spark, str(tmp_path))))
    assert sorted((r["entity_id"], r["change_type"], r["property_name"]) for r in changes.select("entity_id", "change_type", "property_name").collect()) == [("new", "state", "file_created"), ("one", "state", "registry_updated")]
    assert sensing.filesystem_signals(None, before).count() == 0
