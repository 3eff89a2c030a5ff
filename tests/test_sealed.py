"""Sealed logs: versions, conflicts, writers that die, compaction, and what a filter leaves unread."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stemma.operators import metrics
from stemma.sources import sealed


def obs(spark, lo, hi):
    day = datetime(2000, 1, 1)
    return spark.createDataFrame([(i, f"m{i % 3}", f"e{i % 20}", float(i), day + timedelta(hours=i)) for i in range(lo, hi)], sealed.OBSERVATIONS)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_a_writer_that_dies(spark, tmp_path, monkeypatch):
    log = sealed.observation_log(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.version() == 0
    assert log.append(obs(spark, 0, 100)) == 1 and log.append(obs(spark, 100, 150)) == 2
    assert rows(log.read()) == rows(obs(spark, 0, 150)) and rows(log.read(1)) == rows(obs(spark, 0, 100))
    monkeypatch.setattr(sealed.SealedLog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        log.append(obs(spark, 150, 160))
    monkeypatch.undo()
    assert rows(log.read()) == rows(obs(spark, 0, 150))
    assert log.append(obs(spark, 0, 0)) == 2


def test_conflicts(spark, tmp_path):
    one, two = (sealed.observation_log(spark, str(tmp_path / "log")) for _ in range(2))
    one.append(obs(spark, 0, 10))
    real, raced = one._commit, []

    def beaten(base, segments):  # the other writer commits between reading and committing
        if not raced:
            raced.append(two.append(obs(spark, 10, 20)))
        return real(base, segments)

    one._commit = beaten
    assert one.append(obs(spark, 20, 30)) == 3 and rows(two.read()) == rows(obs(spark, 0, 30))
    raced.clear()
    assert one.compact() == 5 and len(two.segments()) == 2  # one of three, and what was appended meanwhile
    assert two.read().count() == 40
    raced.clear()
    one._commit = lambda base, segments: two.compact() < 0 if not raced and not raced.append(1) else real(base, segments)
    with pytest.raises(sealed.Conflict):
        one.compact()
    assert len(two.segments()) == 1 and two.read().count() == 40


def test_filters_reach_segments_and_files(spark, tmp_path):
    log = sealed.observation_log(spark, str(tmp_path / "log"))
    for lo in range(0, 400, 100):
        log.append(obs(spark, lo, lo + 100))
    since, until = "2000-01-06 00:00:00", "2000-01-07 00:00:00"
    some = log.read(since=since, until=until)
    assert len({f.split("/segments/")[1].split("/")[0] for f in some.inputFiles()}) == 1
    whole = obs(spark, 0, 400)
    assert rows(metrics.query(some, "m1", None, since, until)) == rows(metrics.query(whole, "m1", None, since, until))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = some.where("metric_id = 'm1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(metric_id,m1)" in plan


def test_postings(spark, tmp_path):
    log = sealed.version_postings(spark, str(tmp_path / "postings"))
    made = spark.createDataFrame([(i, f"v{i}", [f"e{i % 7}", f"e{i % 5}", None]) for i in range(60)], "seq long, version_id string, affected_entities array<string>")
    sealed.post(log, made.where("seq < 40"))
    sealed.post(log, made.where("seq >= 40"))
    want = sorted(r.version_id for r in made.where(F.array_contains("affected_entities", "e3")).collect())
    found = log.lookup("e3")
    assert sorted(r.version_id for r in found.collect()) == want
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    log.compact()
    assert sorted(r.version_id for r in log.lookup("e3").collect()) == want and log.lookup("e99").count() == 0
    asked = spark.createDataFrame([("e3",), ("e3",), ("e6",)], "entity_id string")
    assert {r.entity_id for r in sealed.versions_of(log, asked).collect()} == {"e3", "e6"}
