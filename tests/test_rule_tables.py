"""Rules kept as tables, and folds of long runs of steps, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import rules


def folded(steps):
    out = {}
    for rev, _, status in sorted(steps, key=lambda x: (x[0], x[1])):
        at, yes, no = out.get(rev, ("detected", 0, 0))
        ok = status in rules.STEPS[at]
        out[rev] = (status if ok else at, yes + ok, no + (not ok))
    return out


@pytest.mark.parametrize("span, fan", [(1 << 14, 1 << 8), (7, 2), (1, 3)])
def test_fold_revisions(spark, span, fan):
    """Also one revision with nine tenths of all steps, of which a range is small."""
    rng = random.Random(span)
    names = [*rules.STEPS, "unheard", None]
    steps = [(f"r{rng.choice([0] * 9 + [1, 2, 3])}", seq * 3, rng.choice(names)) for seq in range(3000)]
    df = spark.createDataFrame(steps, "revision_id string, seq long, status string").repartition(4)
    got = {r.revision_id: (r.status, r.accepted, r.refused) for r in rules.fold_revisions(df, span, fan).collect()}
    assert got == folded(steps)


def test_route_by_table_is_route(spark):
    rng = random.Random(3)
    pick = lambda d, least: {d: f"{d}{rng.randrange(3)}"} if rng.random() > least else {}
    made = [{"id": i + 1, "target": f"t{i}/", "match": {k: v for d in rules.DIMENSIONS for k, v in pick(d, 0.4).items()}} for i in range(30)]
    made[25]["match"] = {}
    arts = [tuple([f"a{i}"] + [rng.choice([None, *(f"{d}{j}" for j in range(4))]) for d in rules.DIMENSIONS]) for i in range(400)]
    a = spark.createDataFrame(arts, "artifact_id string, " + ", ".join(f"{d} string" for d in rules.DIMENSIONS))
    table = spark.createDataFrame([(i, r["id"], r["target"], *[r["match"].get(d) for d in rules.DIMENSIONS]) for i, r in enumerate(made)], "place long, rule_id int, target string, " + ", ".join(f"{d} string" for d in rules.DIMENSIONS))
    for some in (table, table.where("place < 25"), table.limit(0)):
        rows = some.orderBy("place").collect()
        want = rules.route(a, [made[r.place] for r in rows], "f/")
        assert sorted(map(tuple, rules.route_by_table(a, some, "f/").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_contains_by_type(spark):
    df = spark.createDataFrame([("u", "organ", ["abc", "d"], "abc")], "uid string, entity_type string, tags array<string>, title string")
    policy = lambda field, v: {"policy_id": f"{field}-{v}", "action": "x", "conditions": [(field, "contains", v)]}
    made = [policy("tags", "a"), policy("tags", "d"), policy("tags", "abc"), policy("title", "a"), policy("title", "d")]
    got = {r.policy_id for r in rules.evaluate_policies(df, made).collect()}
    assert got == {"tags-d", "tags-abc", "title-a"}
    assert df.select(rules.condition(F.col("tags"), "contains", "d", listed=True)).first()[0]


def test_policy_table_is_compiled_policies(spark):
    from stemma.operators import policytable

    rng = random.Random(8)
    ents = [(f"e{i}", rng.choice(["repo", "module"]), rng.choice([None, *map(float, range(20))]), rng.choice([None, "a", "b", "ab", "c"])) for i in range(120)]
    e = spark.createDataFrame(ents, "uid string, entity_type string, size double, title string")
    facts = e.select("uid", F.lit("size").alias("field"), F.col("size").alias("number"), F.lit(None).cast("string").alias("text")).union(e.select("uid", F.lit("title"), F.lit(None).cast("double"), "title"))

    def made():
        field = rng.choice(["size", "size", "title"])
        if field == "size":
            return field, rng.choice(["gt", "lt", "gte", "lte", "eq", "ne"]), float(rng.randrange(-2, 23))
        op = rng.choice(["eq", "ne", "in", "not_in", "contains", "unheard"])
        return field, op, rng.sample(["a", "b", "zz", None], 2) if op in ("in", "not_in") else rng.choice(["a", "b", "c"])

    policies = [{"policy_id": f"p{i}", "action": "x", "priority": i % 4, "scope": rng.choice([None, None, "repo"]), "enabled": rng.random() > 0.1, "conditions": [made() for _ in range(rng.randrange(4))]} for i in range(80)]
    policies.append({"policy_id": "null", "action": "x", "priority": 1, "scope": None, "enabled": True, "conditions": [("size", "eq", None)]})
    p = spark.createDataFrame([(p["policy_id"], p["action"], p["priority"], p["scope"], p["enabled"]) for p in policies], "policy_id string, action string, priority int, scope string, enabled boolean")
    split = lambda v: (v, None, None) if isinstance(v, float) else (None, None, v) if isinstance(v, list) else (None, v, None)
    c = spark.createDataFrame([(p["policy_id"], k, f, op, *split(v)) for p in policies for k, (f, op, v) in enumerate(p["conditions"])], "policy_id string, k int, field string, operator string, number double, text string, items array<string>")
    want = {(r.uid, r.policy_id, r.priority) for r in rules.evaluate_policies(e, policies).collect()}
    got = [(r.uid, r.policy_id, r.priority) for r in policytable.match(e, facts, p, c).collect()]
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_policy_pairs_meet_once(spark, monkeypatch, size):
    """Pairs are neither shuffled nor put together again after they have met, and cells of any size find the same."""
    from stemma.operators import policytable

    monkeypatch.setattr(policytable, "CELL_POLICIES", size)
    monkeypatch.setattr(policytable, "CELL_ENTITIES", size)
    e = spark.range(40).select(F.concat(F.lit("e"), "id").alias("uid"), F.lit("repo").alias("entity_type"), F.col("id"))
    facts = e.select("uid", F.lit("size").alias("field"), F.col("id").cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
    p = spark.range(20).select(F.concat(F.lit("p"), "id").alias("policy_id"), F.lit("x").alias("action"), F.lit(1).alias("priority"), F.lit(None).cast("string").alias("scope"), F.lit(True).alias("enabled"))
    bound = lambda k, op, n: spark.range(18).select(F.concat(F.lit("p"), "id").alias("policy_id"), F.lit(k).alias("k"), F.lit("size").alias("field"), F.lit(op).alias("operator"), n.cast("double").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("items"))
    got = policytable.match(e.drop("id"), facts, p, bound(0, "gt", F.col("id")).union(bound(1, "lte", F.col("id") + 5)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    want = {(f"e{i}", f"p{j}") for i in range(40) for j in range(20) if j >= 18 or j < i <= j + 5}
    rows = [(r.uid, r.policy_id) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("size", [1, 3, 1 << 8])
def test_policies_are_judged_in_lists(spark, monkeypatch, size):
    """Entities alike in what is asked beyond the leading range, and policies that ask the same, are judged once and in lists of
    bounded size, also where fields are missing."""
    from stemma.operators import policytable

    monkeypatch.setattr(policytable, "LIST", size)
    ents = [(f"e{i}", ["repo", "module"][i % 2], float(i), [None, "a", "b"][i % 3]) for i in range(60)]
    e = spark.createDataFrame(ents, "uid string, entity_type string, size double, title string")
    facts = e.select("uid", F.lit("size").alias("field"), F.col("size").alias("number"), F.lit(None).cast("string").alias("text")).union(e.select("uid", F.lit("title"), F.lit(None).cast("double"), "title"))
    p = spark.createDataFrame([(f"p{i}", "x", i % 4, ["repo", "", None][i % 3], True) for i in range(30)], "policy_id string, action string, priority int, scope string, enabled boolean")
    bounds = [(f"p{i}", 0, "size", "gte", float(i), None) for i in range(30)] + [(f"p{i}", 1, "title", ["ne", "eq"][i % 2], None, "a") for i in range(0, 30, 2)]
    c = spark.createDataFrame(bounds, "policy_id string, k int, field string, operator string, number double, text string").withColumn("items", F.lit(None).cast("array<string>"))
    got = policytable.match(e.select("uid", "entity_type"), facts, p, c)
    want = {(u, f"p{i}", i % 4) for u, kind, n, t in ents for i in range(30) if n >= i and (i % 2 or t != "a") and (i % 3 or kind == "repo")}
    rows = [(r.uid, r.policy_id, r.priority) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and plan.index("Generate explode") < plan.index("forall(")
