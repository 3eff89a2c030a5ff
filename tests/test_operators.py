
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from stemma.functions import text as fn
from stemma.operators import graph, metrics, mutate, resolve, rules, state, temporal

NOW = "2026-06-01 00:00:00"


def edges(spark, rows, names=("parent_id", "child_id")):
    made = [(i, a, b, *(w or ("2026-01-01 00:00:00", None))) for i, (a, b, w) in enumerate(rows, 1)]
    df = spark.createDataFrame(made, f"seq long, {names[0]} string, {names[1]} string, valid_from string, valid_to string")
    return df.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")).withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))


def relations(spark, rows):
    return edges(spark, rows, ("source_id", "target_id")).withColumn("relation_type", F.lit("depends_on"))


def names(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "seq long, entity_id string, display_name string, valid_from string, valid_to string, is_primary boolean")
    return df.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")).withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


TREE = [("root", "a", None), ("root", "b", None), ("a", "c", None), ("a", "d", None), ("b", "e", None)]


@pytest.mark.parametrize("given,want", [("My Repo", "my-repo"), ("a - b", "a--b"), ("--x__y--", "x-y"), ("A---B", "a--b"), ("héllo wörld", "h-llo-w-rld"), ("", "")])
def test_slugify(spark, given, want):
    assert spark.createDataFrame([(given,)], "n string").select(fn.slugify(F.col("n"))).first()[0] == want


def test_fingerprint_and_ids(spark):
    row = spark.range(1).select(fn.fingerprint(F.lit(2), F.lit(1), F.lit(0), F.lit(3), F.lit('p"1')), fn.fingerprint(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("string")), fn.entity_uid(F.lit("module"), F.lit(1767225600000), F.lit("k"))).first()
    of = lambda **k: hashlib.sha256(json.dumps(k, sort_keys=True).encode()).hexdigest()[:16]
    assert row[0] == of(parent='p"1', children=2, outgoing=3, incoming=0, depth=1)
    assert row[1] == of(parent=None, children=0, outgoing=0, incoming=0, depth=0)
    assert row[2].startswith("ent_mod_") and len(row[2]) == 8 + 26 and set(row[2][8:]) <= set(fn.CROCKFORD)


def test_windows_are_half_open(spark):
    e = edges(spark, [("r", "c1", ("2026-01-01 00:00:00", "2026-03-01 00:00:00")), ("r", "c2", ("2026-03-01 00:00:00", None))])
    assert [r["child_id"] for r in temporal.as_of(e, "2026-02-28 23:59:59").collect()] == ["c1"]
    assert [r["child_id"] for r in temporal.as_of(e, "2026-03-01 00:00:00").collect()] == ["c2"]
    assert temporal.as_of(e, "2025-12-31 00:00:00").count() == 0


def test_traversals(spark):
    e = edges(spark, TREE)
    root = spark.createDataFrame([("root",)], "root string")
    found = graph.macro_descent(e, root, NOW).orderBy("depth", "order").collect()
    assert [(r["node"], r["depth"]) for r in found] == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2)]
    assert rows(graph.macro_descent(e, root, NOW, 1).select("node")) == [("a",), ("b",)]
    assert rows(graph.micro_ascent(e, NOW).where("node = 'c'").select("ancestor", "distance")) == [("a", 1), ("root", 2)]
    assert rows(graph.roots_of(e, NOW)) == [("root",)] and rows(graph.leaves_of(e, NOW)) == [("c",), ("d",), ("e",)]


def test_cycles_end(spark):
    e = edges(spark, [("x", "y", None), ("y", "z", None), ("z", "x", None)])
    root = spark.createDataFrame([("x",)], "root string")
    assert rows(graph.macro_descent(e, root, NOW).select("node", "depth")) == [("y", 1), ("z", 2)]
    assert rows(graph.micro_ascent(e, NOW).where("node = 'x'").select("ancestor", "distance")) == [("y", 2), ("z", 1)]
    obs = spark.createDataFrame([], "seq long, metric_id string, entity_id string, value double")
    with pytest.raises(ValueError):
        metrics.rollup_tree(e, obs, "m", "x", NOW)


def test_paths_are_first_found(spark):
    r = relations(spark, [("a", "b", None), ("a", "c", None), ("b", "d", None), ("c", "d", None)])
    got = graph.dependency_trace(r, spark.createDataFrame([("a",)], "root string"), NOW)
    assert {x["node"]: x["path"] for x in got.collect()}["d"] == ["a", "b", "d"]
    assert rows(graph.dependency_trace(r, spark.createDataFrame([("d",)], "root string"), NOW, reverse=True).select("node", "depth")) == [("a", 2), ("b", 1), ("c", 1)]


def test_clusters(spark):
    r = relations(spark, [("a", "b", None), ("b", "c", None), ("a", "c", None), ("x", "y", None), ("y", "z", None), ("s", "s", None)])
    assert rows(graph.clusters(r, NOW).select("component", "size", F.round("cohesion", 3))) == [("a", 3, 1.0), ("x", 3, 0.667)]


def test_rollups(spark):
    e = edges(spark, [("root", "oa", None), ("root", "ob", None), ("oa", "r1", None), ("oa", "r2", None), ("ob", "r3", None)])
    obs = spark.createDataFrame([(1, "m", "r1", 9.0), (2, "m", "r1", 5.0), (3, "m", "r2", 3.0), (4, "n", "r3", 7.0)], "seq long, metric_id string, entity_id string, value double")
    assert rows(metrics.rollup(e, obs, "m", NOW, ["sum", "avg", "count", "latest"])) == [("oa", 2, 8.0, 4.0, 2.0, 3.0)]
    got = {r["entity_id"]: r for r in metrics.rollup_tree(e, obs, "m", "root", NOW).collect()}
    assert (got["oa"]["sum"], got["ob"]["sum"], got["root"]["sum"]) == (8.0, 0.0, 8.0)
    assert got["root"]["child_count"] == 2 and got["root"]["latest"] == 0.0 and got["oa"]["count"] == 2.0


def test_random_trees_against_recursion(spark):
    rng = random.Random(3)
    made = [(f"n{rng.randrange(i)}", f"n{i}", None) for i in range(1, 40)]
    e = edges(spark, made)
    obs = [(i, "m", f"n{rng.randrange(40)}", float(rng.randrange(50))) for i in range(60)]
    value = {x[2]: x[3] for x in obs}
    kids = {}
    for a, b, _ in made:
        kids.setdefault(a, []).append(b)

    def up(n, f):
        return f([up(k, f) for k in kids[n]]) if n in kids else value.get(n, 0.0)

    got = {r["entity_id"]: r for r in metrics.rollup_tree(e, spark.createDataFrame(obs, "seq long, metric_id string, entity_id string, value double"), "m", "n0", NOW).collect()}
    fold = {"sum": sum, "max": max, "min": min, "avg": lambda x: sum(x) / len(x), "count": len, "latest": lambda x: x[-1]}
    assert set(got) == set(kids)
    for n, r in got.items():
        for p, f in fold.items():
            assert r[p] == pytest.approx(float(up(n, f)))


def test_observation_ranges(spark):
    obs = spark.createDataFrame([(i, "m", "e", float(i), f"2026-01-0{i} 00:00:00") for i in range(1, 6)], "seq long, metric_id string, entity_id string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r[0] for r in rows(metrics.query(obs, since="2026-01-02 00:00:00", until="2026-01-04 00:00:00").select("seq"))] == [2, 3, 4]
    assert [r[0] for r in rows(metrics.query(obs, limit=2).select("seq"))] == [4, 5] and metrics.query(obs, limit=0).count() == 5


def test_resolver(spark):
    n = names(spark, [("e1", "old-name", "2026-01-01 00:00:00", "2026-02-01 00:00:00", False), ("e1", "new-name", "2026-02-01 00:00:00", None, True), ("e2", "Some Tool", "2026-01-01 00:00:00", None, True)])
    e = spark.createDataFrame([(1, "e1", "repo", "active"), (2, "e2", "organ", "active")], "seq long, uid string, entity_type string, lifecycle_status string")
    ask = spark.createDataFrame([("old-name",), ("some tool",), ("SOME TOOL",), ("e1",), ("some-tool",), ("zz",)], "identifier string")
    got = {r["identifier"]: tuple(r)[1:] for r in resolve.resolve(ask, e, n, NOW).collect()}
    assert got == {"old-name": ("e1", "slug", "new-name"), "some tool": ("e2", "primary_name", "Some Tool"), "SOME TOOL": ("e2", "primary_name", "Some Tool"), "e1": ("e1", "uid", "new-name"), "some-tool": ("e2", "slug", "Some Tool")}
    assert {r["identifier"] for r in resolve.resolve(ask, e, n, NOW, "repo").collect()} == {"old-name", "e1"}


@pytest.mark.parametrize("op,value,want", [("eq", None, [2]), ("ne", "a", [1, 2]), ("in", ["a", None], [0, 2]), ("not_in", ["a"], [1, 2]), ("gt", "a", [1]), ("contains", "b", [1]), ("odd", "a", [])])
def test_conditions(spark, op, value, want):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "i int, f string")
    assert [r[0] for r in df.where(rules.condition("f", op, value)).select("i").orderBy("i").collect()] == want


def test_revisions(spark):
    steps = ["evaluating", "accumulating", "evaluating", "approved", "proposed", "approved", "applied", "cancelled"]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(steps)], "revision_id string, seq long, status string")
    assert rows(rules.fold_revisions(df)) == [("r", "applied", 5, 3)]


def test_recovery(spark):
    log = [("entity.deprecated", "a", None, None), ("entity.created", "a", "organ", "A"), ("entity.created", "b", "odd", "B"), ("entity.archived", "b", None, None), ("entity.renamed", "a", None, "A2"), ("entity.merged", "a", None, None), ("entity.created", "a", "repo", None), ("sensor.state", "a", None, None)]
    df = spark.createDataFrame([(i, *x, f"2026-01-0{i + 1} 00:00:00") for i, x in enumerate(log)], "seq long, event_type string, subject_entity string, entity_type string, new_value string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert rows(state.recover(df)) == [("a", "repo", "active", "A2", 2), ("b", "repo", "archived", "B", 1)]
    assert rows(state.recover(df, "2026-01-06 00:00:00")) == [("a", "organ", "merged", "A2", 2), ("b", "repo", "archived", "B", 1)]
    want = spark.createDataFrame([("a", "repo", "archived"), ("c", "repo", "active")], "uid string, entity_type string, lifecycle_status string")
    assert [(r[0], r[1]) for r in sorted(map(tuple, state.verify_recovery(state.recover(df), want).collect()))] == [("a", "lifecycle_status"), ("b", "extra"), ("c", "missing")]


def test_maps(spark):
    a = spark.createDataFrame([("e", {"x": "1", "y": "2"})], "entity_id string, m map<string,string>")
    b = spark.createDataFrame([("e", {"x": "1", "z": "3"})], "entity_id string, m map<string,string>")
    assert {tuple(r) for r in state.compare_maps(a, b, "m").collect()} == {("e", "y", "2", None), ("e", "z", None, "3")}


def test_variables(spark):
    log = [(1, "X", "global", None, "g", "runtime"), (2, "X", "organ", "A", "o1", "constant"), (3, "X", "organ", "A", "o2", "runtime"), (4, "X", "organ", "B", "p", "runtime"), (5, "X", "global", None, "g2", "runtime")]
    v = rules.set_variables(spark.createDataFrame(log, "seq long, key string, scope string, entity_id string, value string, mutability string"))
    assert {(r["scope"], r["entity_id"]): (r["seq"], r["value"]) for r in v.collect()} == {("global", None): (1, "g2"), ("organ", "A"): (2, "o1"), ("organ", "B"): (4, "p")}
    ask = spark.createDataFrame([(1, "X", "repo", {"organ": "B"}), (2, "X", "organ", {"organ": "Z"}), (3, "Y", "organ", {}), (4, "X", "global", {"organ": "A"})], "request_id int, key string, scope string, chain map<string,string>")
    assert [(r[0], r[3], r[4]) for r in rows(rules.resolve_variables(ask, v, "none"))] == [(1, "p", "inherited"), (2, "g2", "inherited"), (3, "none", "default"), (4, "g2", "direct")]


def test_mutations(spark):
    e = spark.createDataFrame([(1, "s1", "repo", "active"), (2, "s2", "organ", "active"), (3, "k", "repo", "active")], "seq long, uid string, entity_type string, lifecycle_status string")
    h = edges(spark, [("p1", "s1", None), ("p2", "s2", None), ("s1", "k", None), ("s2", "k2", None)])
    g = spark.createDataFrame([(1, "s1", "new"), (2, "s2", "new")], "seq long, source_uid string, successor string")
    at = "2026-05-01 00:00:00"
    store, ctx = (mutate.merge(e, h, g, at, f) for f in ("store", "ctx"))
    live = lambda df: rows(temporal.as_of(df, NOW).select("parent_id", "child_id"))
    assert live(store["edges"]) == [("new", "k"), ("new", "k2"), ("p1", "new"), ("p2", "new")]
    assert live(ctx["edges"]) == [("new", "k"), ("new", "k2"), ("p1", "new"), ("p2", "s2")]
    assert {r["uid"]: (r["entity_type"], r["lifecycle_status"]) for r in store["entities"].collect()}["new"] == ("repo", "active")
    assert {r["lifecycle_status"] for r in ctx["entities"].where("uid like 's%'").collect()} == {"merged"}
    assert (store["lineage"].count(), ctx["lineage"].count()) == (2, 4)
    cut = mutate.split(e, h, spark.createDataFrame([("s1", "d1"), ("s1", "d2")], "source_uid string, descendant string"), at)
    assert live(cut["edges"]) == [("p1", "d1"), ("p1", "d2"), ("p2", "s2"), ("s1", "k"), ("s2", "k2")]
    n = mutate.rename(names(spark, [("s1", "Old", "2026-01-01 00:00:00", None, True)]), spark.createDataFrame([("s1", "New")], "entity_id string, display_name string"), at)
    assert rows(temporal.current_name(n, NOW)) == [("s1", "New", True)] and rows(temporal.current_name(n, "2026-02-01 00:00:00")) == [("s1", "Old", False)]
    moved = mutate.relocate(h, spark.createDataFrame([("s1", "p9")], "child_id string, parent_id string"), at)
    assert rows(temporal.parent_of(moved, NOW).where("child_id = 's1'")) == [("s1", "p9")]


def test_tension(spark):
    r = relations(spark, [(f"s{i}", "hub", None) for i in range(6)] + [("s0", "small", None)])
    assert [(x["target_id"], x["incoming"], x["severity"]) for x in state.overcoupling(r, NOW).collect()] == [("hub", 6, 0.6)]


def test_distribution_by_counts(spark):
    """As Spark's percentile gives them, without an aggregate that holds a metric's values."""
    from pyspark.sql import functions as F

    from stemma.operators import metrics

    rows = [("hot", float(i * i % 97)) for i in range(500)] + [("one", 3.5), ("two", -1.0), ("two", None), ("two", 2.0), ("none", None), (None, 4.0), (None, float("nan")), ("zero", -0.0), ("zero", 0.0)]
    obs = spark.createDataFrame(rows, "metric_id string, value double").repartition(5)
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = metrics.distribution(obs, points)
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = obs.groupBy("metric_id").agg(*[F.percentile("value", p).alias(f"p{int(100 * p)}") for p in points])
    plain = lambda df: sorted((r.metric_id or "", *[None if x is None else repr(round(x, 9) + 0.0) for x in r[1:]]) for r in df.collect())
    assert plain(found) == plain(want)


def test_signatures_at_several_times(spark):
    """Both times from one reading; a node that is no entity still counts on the way to the root."""
    day = lambda m: f"2026-0{m}-01 00:00:00"
    e = spark.createDataFrame([("a",), ("c",), ("d",), ("lone",)], "uid string")
    h = edges(spark, [("a", "x", None), ("x", "c", None), ("c", "d", (day(1), day(3))), ("a", "d", (day(3), None)), ("c", "leaf", None)])
    r = relations(spark, [("a", "c", (day(2), None)), ("a", "d", (day(1), day(2))), ("d", "d", None)])
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = state.signatures_at(e, h, r.mapInArrow(seen, r.schema), [day(1), day(4)])
    plain = lambda df: {x.uid: (x.parent_id, x.child_count, x.outgoing, x.incoming, x.depth) for x in df.collect()}
    assert plain(got[0]) == {"a": (None, 1, 1, 0, 0), "c": ("x", 2, 0, 0, 2), "d": ("c", 0, 1, 2, 3), "lone": (None, 0, 0, 0, 0)}
    assert plain(got[1]) == {"a": (None, 2, 1, 0, 0), "c": ("x", 1, 0, 1, 2), "d": ("a", 0, 1, 1, 1), "lone": (None, 0, 0, 0, 0)}
    assert read.value == 3
    one = state.signatures(e, h, r, day(4)).select("uid", "fingerprint")
    assert set(one.collect()) == set(got[1].select("uid", "fingerprint").collect())
