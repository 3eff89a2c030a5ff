"""Long logs as sealed segments with versioned commits.

A segment is a folder of Parquet sorted by the log's keys, so that statistics of row groups and files skip what a filter
on the keys rules out. A version is a small file that lists segments with the ranges of seq and time they hold. Writers
write segments first and then a version of the next number, which can be created only once: of two writers one finds it
taken, reads what the other left and tries again. Readers open the newest version, so a writer that dies leaves the old
one readable, and segments that no version lists are never read. ``compact`` writes several segments as one.

A log may be dealt into buckets by the hash of a column; a look-up of a value then reads the folders of its bucket only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import at_literal
from .store import _hadoop


class Conflict(RuntimeError):
    """A commit whose segments another writer has replaced meanwhile."""


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int
    least: int | None
    most: int | None
    since: str | None
    until: str | None


class SealedLog:
    """A log with a column seq, sorted by ``keys`` in its segments; ``ts``, where it has one, bounds segments in time.

    buckets: how many buckets the column ``bucket_by`` is dealt into; fixed when a log is first written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], bucket_by: str | None = None, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.bucket_by, self.buckets = spark, path.rstrip("/"), schema, keys, bucket_by, buckets

    # Versions

    def _names(self) -> list[int]:
        fs, where = _hadoop(self.spark, f"{self.path}/versions")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(where) if x.getPath().getName().endswith(".json")) if fs.exists(where) else []

    def version(self) -> int:
        return max(self._names(), default=0)

    def segments(self, version: int | None = None) -> list[Segment]:
        number = self.version() if version is None else version
        if not number:
            return []
        text = self.spark.read.text(f"{self.path}/versions/{number:010d}.json", wholetext=True).first()[0]
        return [Segment(**x) for x in json.loads(text)]

    def _commit(self, base: int, segments: list[Segment]) -> bool:
        """Whether version base + 1 could be made: written aside, then moved to its name, which fails if that is taken."""
        fs, aside = _hadoop(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        _, where = _hadoop(self.spark, f"{self.path}/versions/{base + 1:010d}.json")
        hadoop, sc = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext
        out = fs.create(aside)
        out.write(json.dumps([asdict(s) for s in segments]).encode())
        out.close()
        never = sc._gateway.new_array(hadoop.Options.Rename, 1)  # never over a file that is there
        never[0] = getattr(hadoop.Options.Rename, "NONE")
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(where), never)
        except Exception as e:
            fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    # Writing

    def _write(self, rows: DataFrame) -> Segment | None:
        name = uuid.uuid4().hex
        order = [*(["bucket"] if self.bucket_by else []), *self.keys, "seq"]
        if self.bucket_by:
            rows = rows.withColumn("bucket", F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int"))
        sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        sorted_.write.option("compression", "zstd").partitionBy(*["bucket"] if self.bucket_by else []).parquet(f"{self.path}/segments/{name}")
        times = [F.min("ts").cast("string"), F.max("ts").cast("string")] if "ts" in rows.columns else [F.lit(None), F.lit(None)]
        n, least, most, since, until = self._read([name]).agg(F.count("*"), F.min("seq"), F.max("seq"), *times).first()
        return Segment(name, n, least, most, since, until) if n else None

    def append(self, rows: DataFrame) -> int:
        """Adds a segment; returns the version that first holds it. A conflict is settled by trying again on what the other left."""
        made = self._write(rows)
        while True:
            base = self.version()
            if made is None:
                return base
            if self._commit(base, [*self.segments(base), made]):
                return base + 1

    def compact(self, least: int = 2) -> int:
        """Makes one segment of all, if there are at least so many. Segments appended meanwhile are kept; if others are gone, as
        another compaction was faster, it raises ``Conflict`` and nothing is changed."""
        base = self.version()
        old = self.segments(base)
        if len(old) < least:
            return base
        made = self._write(self._read([s.name for s in old]).drop("bucket"))
        while True:
            base = self.version()
            now = self.segments(base)
            if not set(old) <= set(now):
                raise Conflict("segments were replaced meanwhile")
            if self._commit(base, [made, *[s for s in now if s not in old]]):
                return base + 1

    # Reading

    def _read(self, names: list[str]) -> DataFrame:
        bucket = ", bucket int" if self.bucket_by else ""
        if not names:
            return self.spark.createDataFrame([], self.schema + bucket)
        # One read a segment keeps folders of buckets below each of them.
        parts = [self.spark.read.schema(self.schema + bucket).parquet(f"{self.path}/segments/{n}") for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def read(self, version: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """All rows of a version, or those from ``since`` to ``until`` (inclusive); segments outside are not opened."""
        kept = [s for s in self.segments(version) if (since is None or s.until is None or s.until >= since) and (until is None or s.since is None or s.since <= until)]
        rows = self._read([s.name for s in kept])
        rows = rows.where(F.col("ts") >= at_literal(since)) if since else rows
        rows = rows.where(F.col("ts") <= at_literal(until)) if until else rows
        return rows.drop("bucket")

    def lookup(self, value: str, version: int | None = None) -> DataFrame:
        """The rows of one value of the bucketed column."""
        rows = self._read([s.name for s in self.segments(version)])
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(self.buckets))).first()[0]
        return rows.where((F.col("bucket") == int(bucket)) & (F.col(self.bucket_by) == value)).drop("bucket")


OBSERVATIONS = "seq long, metric_id string, entity_id string, value double, ts timestamp_ntz"
POSTINGS = "seq long, entity_id string, version_id string"


def observation_log(spark: SparkSession, path: str) -> SealedLog:
    return SealedLog(spark, path, OBSERVATIONS, ["metric_id", "entity_id"])


def version_postings(spark: SparkSession, path: str) -> SealedLog:
    """entity_id, version_id by entity: which versions touch an entity, without a scan of the log."""
    return SealedLog(spark, path, POSTINGS, ["entity_id"], "entity_id")


def post(log: SealedLog, versions: DataFrame) -> int:
    """Adds the postings of new versions (seq, version_id, affected_entities)."""
    return log.append(versions.select("seq", F.explode(F.array_distinct("affected_entities")).alias("entity_id"), "version_id").where("entity_id is not null"))


def versions_of(log: SealedLog, entities: DataFrame) -> DataFrame:
    """entity_id, seq, version_id for many entities (entity_id) at once."""
    wanted = entities.select("entity_id").distinct()
    return log.read().join(wanted, "entity_id", "left_semi").select("entity_id", "seq", "version_id")
