"""Recovery as a stream equals the batch recovery, however the log is split, with restarts and from a snapshot."""

import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import state
from stemma.streaming import recovery

SCHEMA = "seq long, event_type string, subject_entity string, entity_type string, new_value string"
KINDS = ["entity.created", "entity.renamed", "name.added", "entity.deprecated", "entity.archived", "entity.merged", "other"]


def log(seed, n=160):
    rng = random.Random(seed)
    return [(i, rng.choice(KINDS), rng.choice(["a", "b", "c", "hot", "hot", "hot", "", None]), rng.choice(["repo", "module", "odd", None]), rng.choice(["n%d" % i, "", None])) for i in range(n)]


def as_set(df):
    return {tuple(r) for r in df.select("uid", "entity_type", "lifecycle_status", "display_name", "name_count").collect()}


@pytest.mark.parametrize("shuffled, from_snapshot", [(False, False), (True, True)])
def test_any_split(spark, tmp_path, shuffled, from_snapshot):
    rows = log(1)
    first, rest = (rows[:60], rows[60:]) if from_snapshot else ([], rows)
    snapshot = state.recovery_parts(spark.createDataFrame(first, SCHEMA)) if from_snapshot else None
    if shuffled:
        random.Random(2).shuffle(rest)
    source, out, check = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for part in (rest[:30], rest[30:31], rest[31:]):  # a restart after each
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        recovery.recover_stream(stream(), out, check, snapshot).awaitTermination()
    want = state.recover(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.lit(None).cast("timestamp_ntz")), cap=0)
    assert as_set(recovery.recovered_so_far(spark, out, snapshot)) == as_set(want)


def test_state_is_an_aggregate(spark, tmp_path):
    """Events are merged by Spark's own aggregates, with a partial step, not an entity at a time in Python; a snapshot counts once."""
    rows, source = log(3), str(tmp_path / "log")
    spark.createDataFrame(rows[60:], SCHEMA).coalesce(1).write.parquet(source)
    snapshot = state.recovery_parts(spark.createDataFrame(rows[:60], SCHEMA))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    query = recovery.recover_stream(stream(), out, check, snapshot)
    query.awaitTermination()
    assert {x["operatorName"] for p in query.recentProgress for x in p["stateOperators"]} == {"stateStoreSave"}
    spark.createDataFrame([(900, "entity.renamed", "a", None, "late")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    recovery.recover_stream(stream(), out, check).awaitTermination()  # goes on without being given the snapshot
    every = [*rows, (900, "entity.renamed", "a", None, "late")]
    want = state.recover(spark.createDataFrame(every, SCHEMA).withColumn("ts", F.lit(None).cast("timestamp_ntz")), cap=0)
    assert as_set(recovery.recovered_so_far(spark, out)) == as_set(want)
