"""Observations: ranges, latest values, roll-ups along the hierarchy, and trailing aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, running
from .graph import descend
from .temporal import as_of, at_literal, last_by

POLICIES = ("sum", "avg", "max", "min", "count", "latest", "none")


def tail(df: DataFrame, limit: int | None) -> DataFrame:
    """The last ``limit`` rows by seq; all without a limit or with 0."""
    return df.orderBy(F.desc("seq")).limit(limit) if limit else df


def query(obs: DataFrame, metric_id: str | None = None, entity_id: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Both bounds are inclusive."""
    for name, value in (("metric_id", metric_id), ("entity_id", entity_id)):
        obs = obs.where(F.col(name) == value) if value is not None else obs
    obs = obs.where(F.col("ts") >= at_literal(since)) if since else obs
    return tail(obs.where(F.col("ts") <= at_literal(until)) if until else obs, limit)


def replay(events: DataFrame, since: str | None = None, event_type: str | None = None, subject: str | None = None, limit: int | None = 500) -> DataFrame:
    """``since`` is exclusive."""
    events = events.where(F.col("ts") > at_literal(since)) if since else events
    events = events.where(F.col("event_type") == event_type) if event_type else events
    return tail(events.where(F.col("subject_entity") == subject) if subject else events, limit)


def latest(obs: DataFrame) -> DataFrame:
    """metric_id, entity_id, value: the last appended one."""
    return last_by(obs, ["metric_id", "entity_id"], ["seq"], ["value"])


def time_series(obs: DataFrame, metric_id: str, entity_id: str, since: str | None = None) -> DataFrame:
    return query(obs, metric_id, entity_id, since).select("seq", "ts", "value")


def aggregate_by(policy: str, value: str = "value", seq: str = "seq") -> Column:
    """An aggregate of children's values; no value gives 0."""
    v = F.col(value)
    found = {"sum": F.sum(v), "avg": F.avg(v), "max": F.max(v), "min": F.min(v), "count": F.count(v).cast("double"), "latest": F.max_by(v, F.col(seq)), "none": F.lit(0.0)}[policy]
    return F.coalesce(found, F.lit(0.0))


def rollup(edges: DataFrame, obs: DataFrame, metric_id: str, at: str, policies=POLICIES[:6]) -> DataFrame:
    """entity_id, child_count and one column a policy, over the latest values of the direct active children that have one."""
    own = latest(obs.where(F.col("metric_id") == metric_id)).select(F.col("entity_id").alias("child_id"), "value")
    rows = as_of(edges, at).join(own, "child_id")
    return rows.groupBy(F.col("parent_id").alias("entity_id")).agg(F.count("*").alias("child_count"), *[aggregate_by(p).alias(p) for p in policies])


def rollup_tree(edges: DataFrame, obs: DataFrame, metric_id: str, root: str, at: str, policies=POLICIES[:6]) -> DataFrame:
    """entity_id, child_count (all child edges) and one column a policy, for every node with children reached from ``root``.

    Bottom up: a round gives the nodes all of whose children have a value; a leaf without observation is 0. A cycle never
    gets a value and raises.
    """
    spark = edges.sparkSession
    down = checkpointed(as_of(edges, at).select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"), "seq"))
    reached = descend(down, spark.createDataFrame([(root,)], "root string"), stored=True).select(F.col("node").alias("src"))
    inner = checkpointed(down.join(reached.union(spark.createDataFrame([(root,)], "src string")), "src", "left_semi"))
    leaves = inner.select(F.col("dst").alias("node")).subtract(inner.select("src"))
    own = latest(obs.where(F.col("metric_id") == metric_id)).select(F.col("entity_id").alias("node"), "value")
    base = leaves.join(own, "node", "left").select("node", *[F.coalesce("value", F.lit(0.0)).alias(p) for p in policies])
    known, open_, out = checkpointed(base), inner, None
    while open_.limit(1).count():
        joined = open_.join(known, open_["dst"] == known["node"], "left")
        done = joined.groupBy("src").agg(F.count("*").alias("child_count"), F.count("node").alias("have"), *[aggregate_by(p, p).alias(p) for p in policies])
        done = checkpointed(done.where("child_count = have").drop("have"))
        if not done.limit(1).count():
            raise ValueError("the hierarchy has a cycle")
        out = done if out is None else out.union(done)
        known = known.union(done.select(F.col("src").alias("node"), *policies))
        open_ = checkpointed(open_.join(done.select("src"), "src", "left_anti"))
    if out is None:
        out = inner.groupBy("src").agg(F.count("*").alias("child_count"), *[F.lit(0.0).alias(p) for p in policies])
    return out.withColumnRenamed("src", "entity_id")


def rolling(obs: DataFrame, seconds: int) -> DataFrame:
    """Extension: mean of the values of the trailing ``seconds``, by time."""
    by_time = Window.partitionBy("metric_id", "entity_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return obs.withColumn("rolling", F.avg("value").over(by_time))


def delta(obs: DataFrame) -> DataFrame:
    """Extension: the value less the one appended before it."""
    return obs.withColumn("delta", F.col("value") - F.lag("value").over(Window.partitionBy("metric_id", "entity_id").orderBy("seq")))


def ratio(obs: DataFrame, over: str, under: str) -> DataFrame:
    """Extension: for each entity, the latest value of one metric over another's; null where the second is 0."""
    rows = latest(obs.where(F.col("metric_id").isin(over, under)))
    return rows.groupBy("entity_id").agg((F.max(F.when(F.col("metric_id") == over, F.col("value"))) / F.nullif(F.max(F.when(F.col("metric_id") == under, F.col("value"))), F.lit(0.0))).alias("ratio"))


def distribution(obs: DataFrame, points=(0.25, 0.5, 0.75)) -> DataFrame:
    """Extension: exact percentiles of each metric, between neighbours by the distance to them; nulls don't count.

    Values are counted, and places in their order are running sums of the counts, so no task holds a metric's values: a task
    has a range of them, however many rows one metric has.
    """
    value = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value").cast("double"))
    counted = obs.where("value is not null").groupBy("metric_id", value.alias("value")).agg(F.count("*").alias("n"))
    placed = checkpointed(running(counted, ["metric_id", "value"], ["n"]))
    sizes = placed.groupBy(F.col("metric_id").alias("__metric")).agg(F.min("before_n").alias("start"), F.sum("n").alias("size"))
    rows = placed.join(sizes, F.col("metric_id").eqNullSafe(F.col("__metric"))).withColumn("first", F.col("before_n") - F.col("start"))
    picked = []
    for p in points:
        at = (F.col("size") - 1) * F.lit(float(p))
        for name, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            picked.append(F.max(F.when((F.col("first") <= place) & (place < F.col("first") + F.col("n")), F.col("value"))).alias(f"{name}{int(100 * p)}"))
    found = rows.groupBy("metric_id").agg(F.max("size").alias("size"), *picked)
    out = obs.select(F.col("metric_id").alias("__metric")).distinct().join(found, F.col("metric_id").eqNullSafe(F.col("__metric")), "left")

    def between(p):
        low, high, at = F.col(f"low{int(100 * p)}"), F.col(f"high{int(100 * p)}"), (F.col("size") - 1) * F.lit(float(p))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"p{int(100 * p)}")

    return out.select(F.col("__metric").alias("metric_id"), *[between(p) for p in points])
