"""Policies as a table, matched with entities by an index on one condition each.

A numeric condition is a range of the places of its field's distinct values, an equality or membership a set of single
values. Of each policy the condition that the fewest entities fulfil leads: its range is cut into at most two nodes a
level of a tree over the places, so that values meet exactly the ranges that hold them in an equi-join, and no policy is
held against an entity outside its leading condition. What this finds is then held against all of the policy's conditions.

facts are an entity's fields in long form: uid, field, number (double), text. Null, missing and unknown fields are equal
to null and ordered with nothing; an unknown operator never holds; a disabled policy never does, and one without
conditions always. Policies with no numeric, equality or membership condition have every entity as a candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, running
from .asof import _ends_on

#: The operators of conditions.
RANGES, POINTS = ("gt", "gte", "lt", "lte"), ("eq", "in")
CELL, CELL_POLICIES, CELL_ENTITIES = ("key", "row", "column"), 1 << 10, 1 << 14
#: A list of policies by one of entities gives at most LIST * LIST pairs, which a task may hold at once.
LIST, TASK_PAIRS, MAX_TASKS = 1 << 8, 1 << 23, 1 << 13


def fulfilled(c: Column, numbers: Column, texts: Column) -> Column:
    """Does an entity (maps of its fields) fulfil the condition c (field, operator, number, text, items)?"""
    n, t = F.try_element_at(numbers, c["field"]), F.try_element_at(texts, c["field"])
    equal = F.when(c["number"].isNotNull(), n.eqNullSafe(c["number"])).when(c["text"].isNotNull(), t.eqNullSafe(c["text"])).otherwise(n.isNull() & t.isNull())
    member = F.coalesce(F.array_contains(c["items"], t), F.lit(False)) | (t.isNull() & n.isNull() & F.exists(F.coalesce(c["items"], F.array().cast("array<string>")), lambda i: i.isNull()))
    cases = {"eq": equal, "ne": ~equal, "in": member, "not_in": ~member, "gt": n > c["number"], "gte": n >= c["number"], "lt": n < c["number"], "lte": n <= c["number"], "contains": F.contains(t, c["text"])}
    made = reduce(lambda a, kv: a.when(c["operator"] == kv[0], kv[1]), cases.items(), F.when(F.lit(False), F.lit(False)))
    return F.coalesce(made, F.lit(False))


def keyed(facts: DataFrame, conditions: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, policy_id), (key, uid) and the leads (policy_id, k, field, kind): an entity fulfils the leading condition of a policy if
    they share a key, and then they share one only."""
    values = checkpointed(facts.where("number is not null and not isnan(number)").groupBy("field", "number").agg(F.count("*").cast("long").alias("n")))
    bounds = conditions.where(F.col("operator").isin(*RANGES) & F.col("number").isNotNull()).select("field", "number").distinct()
    # Places of values among all values and bounds, in order of field and number; entities are counted as they go.
    both = values.withColumn("one", F.lit(1).cast("long")).unionByName(bounds.join(values, ["field", "number"], "left_anti").select("field", "number", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("one")))
    placed = checkpointed(running(both, ["field", "number"], ["n", "one"]).select("field", "number", "n", "one", "before_n", "before_one"))
    ends = placed.groupBy("field").agg(F.min("before_one").alias("first"), F.max(F.col("before_one") + F.col("one")).alias("last"), F.min("before_n").alias("first_n"), F.max(F.col("before_n") + F.col("n")).alias("last_n"))
    ranged = conditions.where(F.col("operator").isin(*RANGES)).join(placed, ["field", "number"]).join(ends, "field")
    # A bound itself is in the range of gte and lte, and is a place only if some entity has it.
    low, over = F.col("operator").isin("gt", "gte"), F.col("operator").isin("gt", "lte")
    cut, cut_n = F.col("before_one") + F.when(over, F.col("one")).otherwise(0), F.col("before_n") + F.when(over, F.col("n")).otherwise(0)
    pick = lambda a, b, c, d: [F.when(low, a).otherwise(b), F.when(low, c).otherwise(d)]
    lo, hi = pick(cut, F.col("first"), F.col("last"), cut)
    lo_n, hi_n = pick(cut_n, F.col("first_n"), F.col("last_n"), cut_n)
    # Several bounds of one field are one range.
    joined = ranged.groupBy("policy_id", "field").agg(F.min("k").alias("k"), F.max(lo).alias("lo"), F.min(hi).alias("hi"), (F.min(hi_n) - F.max(lo_n)).alias("hits"))
    joined = joined.withColumn("hits", F.when(F.col("lo") >= F.col("hi"), F.lit(0).cast("long")).otherwise(F.col("hits")))

    key = lambda n, t: F.coalesce(F.concat(F.lit("n"), n.cast("string")), F.concat(F.lit("t"), t))
    held = checkpointed(facts.where("number is not null or text is not null").select("uid", "field", "number", key(F.col("number"), F.col("text")).alias("key")))
    sizes = held.groupBy("field", "key").agg(F.count("*").alias("n"))
    points = conditions.where(F.col("operator").isin(*POINTS)).select("policy_id", "k", "field", F.explode(F.when(F.col("operator") == "in", F.transform("items", lambda i: F.concat(F.lit("t"), i))).otherwise(F.array(key(F.col("number"), F.col("text"))))).alias("key"))
    # Equality with null can't lead: entities without the field have no fact.
    nulls = points.where("key is null").select("policy_id", "k", "field").distinct()
    points = points.where("key is not null").distinct().join(nulls, ["policy_id", "k", "field"], "left_anti")
    sized = points.join(sizes, ["field", "key"], "left").groupBy("policy_id", "k", "field").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    leads = joined.select("policy_id", "k", "field", "hits", F.lit("range").alias("kind")).unionByName(sized.withColumn("kind", F.lit("point")))
    leads = checkpointed(leads.groupBy("policy_id").agg(F.min_by(F.struct("k", "field", "kind"), F.struct("hits", "k", "kind", "field")).alias("x")).select("policy_id", "x.*"))

    spans = joined.join(leads.where("kind = 'range'").select("policy_id", "field"), ["policy_id", "field"]).where("lo < hi")
    top = (placed.agg(F.max(F.col("before_one") + F.col("one"))).first()[0] or 0).bit_length()
    taken = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda j: F.filter(F.array(*[F.when(ok, F.struct(j.alias("level"), node.alias("node"))) for ok, node in _ends_on(j)]), lambda x: x.isNotNull())))
    nodes = checkpointed(spans.select("policy_id", F.explode(taken).alias("n")).select("policy_id", "n.level", "n.node"))
    levels = [r["level"] for r in nodes.select("level").distinct().collect()]  # 63 at most
    ruled = spans.select("field").distinct()
    above = F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))
    places = placed.where("one = 1").select("field", "number", F.col("before_one").alias("place"))
    by_place = held.where("number is not null").join(ruled, "field", "left_semi").join(places, ["field", "number"]).withColumn("level", above).withColumn("node", F.expr("shiftright(place, level)"))

    at_node, at_point, any_ = F.concat_ws(":", F.lit("r"), "level", "node").alias("key"), F.to_json(F.struct("field", "key")).alias("key"), F.lit("").alias("key")
    asked = nodes.select(at_node, "policy_id").union(points.join(leads.where("kind = 'point'").select("policy_id", "k", "field"), ["policy_id", "k", "field"]).select(at_point, "policy_id"))
    asked = checkpointed(asked.union(policies.select("policy_id").distinct().join(leads.select("policy_id"), "policy_id", "left_anti").select(any_, "policy_id")))
    having = by_place.select(at_node, "uid").union(held.select(at_point, "uid")).union(facts.select(any_, "uid").distinct())
    return asked, having.join(asked.select("key").distinct(), "key", "left_semi"), leads


def cells(asked: DataFrame, having: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both with the columns of ``CELL``: a key's pairs are dealt into cells of about ``CELL_POLICIES`` by ``CELL_ENTITIES``; and the number of pairs."""
    n = asked.groupBy("key").agg(F.count("*").alias("p")).join(having.groupBy("key").agg(F.count("*").alias("e")), "key")
    n = checkpointed(n.select("key", F.ceil(F.col("p") / CELL_POLICIES).alias("ps"), F.ceil(F.col("e") / CELL_ENTITIES).alias("es"), (F.col("p") * F.col("e")).alias("pairs")))
    pairs = n.agg(F.sum("pairs")).first()[0] or 0
    own = lambda c, parts: F.pmod(F.xxhash64(c), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    left = asked.join(n, "key").select("key", own("policy_id", "ps").alias("row"), each("es").alias("column"), "policy_id")
    right = having.join(n, "key").select("key", each("ps").alias("row"), own("uid", "es").alias("column"), "uid")
    return left, right, pairs


def alike(rows: DataFrame, same: list[str], value: Column, name: str) -> DataFrame:
    """The values of each cell that share ``same``, in lists of at most ``LIST``."""
    whole = rows.groupBy(*CELL, *same).agg(F.collect_list(value).alias("__all"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("__all") / LIST).cast("int") - 1)
    return whole.select(*CELL, *same, F.explode(F.transform(starts, lambda i: F.slice("__all", i * LIST + 1, LIST))).alias(name))


def match(entities: DataFrame, facts: DataFrame, policies: DataFrame, conditions: DataFrame) -> DataFrame:
    """uid, policy_id, action, priority of the policies that hold of each entity.

    entities: uid, entity_type. policies: policy_id, action, priority, scope (an entity_type, or null), enabled.
    conditions: policy_id, k (to tell a policy's conditions apart), field, operator, number, text, items.

    The rows are as many as there are matches, at worst all pairs. Nothing is shuffled by pairs: both sides take all they need to
    the cells of their keys. There policies that ask the same beyond their leading range, and entities that are the same in all
    that is asked so, are lists: two lists are judged once, and their pairs are given out where they meet.
    """
    on = policies.where(F.coalesce("enabled", F.lit(True)))
    facts = facts.join(entities.select("uid"), "uid", "left_semi")
    every = facts.unionByName(entities.select("uid", F.lit("entity_type").alias("field"), F.lit(None).cast("double").alias("number"), F.col("entity_type").alias("text")))
    every = checkpointed(every)
    asked = checkpointed(conditions.join(on.select("policy_id"), "policy_id", "left_semi"))
    by_policy, by_entity, leads = keyed(every, asked, on)
    by_policy, by_entity, pairs = cells(by_policy, checkpointed(by_entity))
    # What a leading range says holds of all that share its key.
    left = asked.join(leads.where("kind = 'range'").select("policy_id", F.col("field").alias("led")), "policy_id", "left")
    left = checkpointed(left.where(~F.coalesce((F.col("field") == F.col("led")) & F.col("operator").isin(*RANGES) & F.col("number").isNotNull(), F.lit(False))))
    whole = on.join(left.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("field", "operator", "number", "text", "items"))).alias("conditions")), "policy_id", "left")
    own = every.join(left.select("field").distinct(), "field", "left_semi").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("field", "number", "text"))).alias("own"))
    own = entities.select("uid", "entity_type").join(own, "uid", "left")
    by_policy = alike(by_policy.join(whole.select("policy_id", "action", "priority", "scope", "conditions"), "policy_id"), ["scope", "conditions"], F.struct("policy_id", "action", "priority"), "policies")
    by_entity = alike(by_entity.join(own, "uid"), ["entity_type", "own"], F.col("uid"), "uids")
    held = lambda c: F.map_from_entries(F.transform(F.filter("own", lambda x: x[c].isNotNull()), lambda x: F.struct(x["field"], x[c])))
    none = lambda kind: F.create_map().cast(f"map<string,{kind}>")
    by_entity = by_entity.select(*CELL, "entity_type", F.coalesce(held("number"), none("double")).alias("numbers"), F.coalesce(held("text"), none("string")).alias("texts"), "uids")
    # Tasks by the pairs to come, of which the lists' size says little. Merged, as a broadcast of the smaller side would leave the
    # pairs to the few tasks that read the other one.
    tasks = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs // TASK_PAIRS, MAX_TASKS))
    dealt = lambda df: checkpointed(df).repartition(tasks, *CELL)
    rows = dealt(by_entity).join(dealt(by_policy).hint("merge"), list(CELL))
    rows = rows.where("scope is null or scope = '' or scope = entity_type")
    rows = rows.where(F.col("conditions").isNull() | F.forall("conditions", lambda c: fulfilled(c, F.col("numbers"), F.col("texts"))))
    rows = rows.select("uids", F.explode("policies").alias("p")).select(F.explode("uids").alias("uid"), "p")
    return rows.select("uid", "p.policy_id", "p.action", "p.priority")
