"""Reading and writing a registry: line logs, keyed JSON objects, and bootstrap from a source registry.

All paths may be of any store that Spark reads. Lines keep their order in ``seq``
(append, file, then place in the file), which later operators take as insertion order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entity_uid, slugify, ulid
from ..session import tidied
from . import schemas as S

#: Logs are written as gzip, which is read from its start: a file holds at most so many lines.
LINES = 1 << 18


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def log_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a log, oldest first: ``path`` itself or its folder, by time of change and name, then the appends by number
    (folders ``append-<n>``, in ``path`` or, if that is a file, in ``path.d``), each in order of its parts."""
    found = []
    for at in (path, f"{path}.d"):
        fs, where = _hadoop(spark, at)
        if fs.exists(where):
            each = fs.listFiles(where, True)
            while each.hasNext():
                status = each.next()
                name = status.getPath().toUri().toString()
                parts = name.rsplit("/", 2)
                if parts[-1].startswith(("_", ".")):
                    continue
                number = int(parts[-2].removeprefix("append-")) if re.fullmatch(r"append-\d+", parts[-2]) else None
                # Places in names are of any length: part-100000 follows part-99999.
                place = re.sub(r"\d+", lambda d: d[0].zfill(20), parts[-1])
                found.append(((0, status.getModificationTime(), name) if number is None else (1, number, place), name))
    return [name for _, name in sorted(found)]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, value of all lines that aren't blank, seq ascending in order of appending; none if there is no such log.

    A number holds the file's place, and below that where the line's split starts plus its row there. Rows are fewer than bytes
    and a split that isn't a file's last fills a task, so numbers ascend within a file.
    """
    files = [re.sub(":/+", ":/", f) for f in log_files(spark, path)]
    if not files:
        return spark.createDataFrame([], "seq long, value string")
    at = [p for p in (path, f"{path}.d") if _exists(spark, p)]
    rows = spark.read.option("recursiveFileLookup", "true").text(at)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select("value", F.regexp_replace("_metadata.file_path", ":/+", ":/").alias("__file"), (F.col("_metadata.file_block_start") + row).alias("__at"))
    known = spark.createDataFrame(list(zip(files, range(len(files)))), "__file string, __rank long")
    rows = rows.join(F.broadcast(known), "__file")
    return rows.where(F.trim("value") != "").select((F.shiftleft("__rank", 42) + F.col("__at")).alias("seq"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), word: str = "") -> DataFrame:
    """Rows of a line log; lines that aren't JSON objects, or lack a required key, are left out. ``word`` is part of a value that
    all rows wanted have: lines without it, and without an escape that could spell it, aren't parsed."""
    x = F.from_json("value", schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = lines(spark, path)
    if word:
        rows = rows.where(F.contains("value", F.lit(word)) | F.contains("value", F.lit("\\")))
    # Exploded, so that filters aren't pushed below the parsing, which each of them would repeat.
    rows = rows.select("seq", F.explode(F.array(x)).alias("x")).where("x is not null and x.__bad is null").select("seq", "x.*").drop("__bad")
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def _folder(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.getFileStatus(where).isDirectory()


def _entries(spark: SparkSession, path: str, brackets: str) -> DataFrame:
    """seq, value of a JSON object or list that ``Store`` has written in parts, an entry a line: each a small object or list of its
    own. A line that holds more of it, as one that is the whole, is left as it is."""
    opened, closed = brackets
    text = F.when(F.startswith("value", F.lit(opened)), F.col("value")).otherwise(F.concat(F.lit(opened), F.regexp_replace("value", "^,", ""), F.lit(closed)))
    return lines(spark, path).where(~F.col("value").isin(opened, closed)).select("seq", text.alias("value"))


def keyed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of one JSON object of objects, in the order of its keys' text. A file is one value, read in one task; a folder is read by lines."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"__key string, {schema}")
    text = _entries(spark, path, "{}") if _folder(spark, path) else spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", f"map<string, struct<{schema}>>").alias("m")).select(F.explode("m").alias("__key", "x")).select("__key", "x.*")


def listed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of one JSON list of objects, with seq: places in a file, ascending numbers in a folder, which is read by lines."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"seq long, {schema}")
    text = _entries(spark, path, "[]") if _folder(spark, path) else spark.read.text(path, wholetext=True).withColumn("seq", F.lit(0))
    rows = text.select("seq", F.from_json("value", f"array<struct<{schema}>>").alias("a")).select("seq", F.posexplode("a").alias("place", "x"))
    return rows.select((F.col("seq") + F.col("place")).cast("bigint").alias("seq"), "x.*")


class Store:
    """The tables of a store directory as lazily read DataFrames, and its sinks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, table: str) -> str:
        return f"{self.path}/{S.FILES[table]}"

    def entities(self) -> DataFrame:
        rows = keyed_json(self.spark, self.at("entities"), S.ENTITY).drop("__key")
        return rows.withColumns({"lifecycle_status": F.coalesce("lifecycle_status", F.lit("active")), "created_by": F.coalesce("created_by", F.lit("system"))})

    def names(self) -> DataFrame:
        rows = json_lines(self.spark, self.at("names"), S.NAME, ("entity_id", "display_name"))
        return rows.withColumns({"slug": F.coalesce("slug", slugify(F.col("display_name"))), "is_primary": F.coalesce("is_primary", F.lit(True)), "source": F.coalesce("source", F.lit("system"))})

    def _edges(self, kind: str, *columns: str) -> DataFrame:
        return json_lines(self.spark, self.at("edges"), S.EDGE, word=kind).where(F.col("edge_type") == kind).where(" and ".join(f"{c} is not null" for c in columns[:2])).select("seq", *columns, "valid_from", "valid_to", "metadata")

    def hierarchy_edges(self) -> DataFrame:
        return self._edges("hierarchy", "parent_id", "child_id")

    def relation_edges(self) -> DataFrame:
        return self._edges("relation", "source_id", "target_id", "relation_type")

    def lineage(self) -> DataFrame:
        return json_lines(self.spark, self.at("lineage"), S.LINEAGE, ("entity_id", "related_id")).where(F.col("lineage_type").isin(*S.LINEAGE_TYPES))

    def observations(self) -> DataFrame:
        return json_lines(self.spark, self.at("observations"), S.OBSERVATION, ("metric_id", "entity_id", "value"))

    def events(self) -> DataFrame:
        return json_lines(self.spark, self.at("events"), S.EVENT, ("event_type",))

    def versions(self) -> DataFrame:
        return json_lines(self.spark, self.at("versions"), S.VERSION, ("version_id",))

    def variables(self) -> DataFrame:
        """As set one after the other: see rules.set_variables."""
        return listed_json(self.spark, self.at("variables"), S.VARIABLE)

    def metrics(self) -> DataFrame:
        return keyed_json(self.spark, self.at("metrics"), S.METRIC).drop("__key")

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds lines to a log, in order of seq where there is one: a new folder ``append-<n>``, its parts, as gzip, in that order. Of
        two writers that take the same number one fails."""
        self._write(table, rows, self.at(table))

    def _write(self, table: str, rows: DataFrame, path: str, order: tuple[str, ...] = ("seq",)) -> None:
        fs, where = _hadoop(self.spark, path)
        if fs.exists(where) and fs.getFileStatus(where).isFile():
            path = f"{path}.d"
            fs, where = _hadoop(self.spark, path)
        taken = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        number = max([int(n.removeprefix("append-")) for n in taken if re.fullmatch(r"append-\d+", n)], default=0) + 1
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("seq") if "seq" in rows.columns else rows
        out = ordered.select(F.to_json(F.struct(*ordered.columns)).alias("value")).write.mode("error")
        with tidied(self.spark):
            out.option("compression", "gzip").option("maxRecordsPerFile", LINES).text(f"{path}/append-{number:08d}")

    def _write_whole(self, table: str, rows: DataFrame, order: str, line: Column, brackets: str) -> None:
        """Replaces a table by one JSON value in parts, in order, an entry a line: the parts one after the other are the value. They
        are written aside first, as rows may be read from the table."""
        opened, closed = brackets
        entries = rows.select(F.lit(False).alias("end"), F.col(order).alias("at"), line.alias("line"))
        end = self.spark.range(1).select(F.lit(True).alias("end"), F.lit(None).cast(entries.schema["at"].dataType).alias("at"), F.lit(closed).alias("line"))
        ordered = entries.union(end).repartitionByRange("end", "at").sortWithinPartitions("end", "at")
        # The first range is never empty, so the first of all rows has the number 0.
        before = F.when(F.col("first"), F.when(F.col("end"), opened).otherwise(opened + "\n")).otherwise(F.when(F.col("end"), "").otherwise(","))
        path = self.at(table)
        parts = ordered.withColumn("first", F.monotonically_increasing_id() == 0).select(F.concat(before, "line").alias("value"))
        with tidied(self.spark):
            parts.write.mode("overwrite").text(f"{path}.new/append-00000001")
        fs, where = _hadoop(self.spark, path)
        fs.delete(where, True)
        fs.rename(_hadoop(self.spark, f"{path}.new")[1], where)

    def rewrite(self, table: str, rows: DataFrame, order: tuple[str, ...] = ("seq",)) -> None:
        """Replaces a log by ``rows``, which may be read from it, in order of seq or other columns: written aside first, then moved
        to its place. seq isn't written."""
        path = self.at(table)
        self._write(table, rows, f"{path}.new", order)
        fs, where = _hadoop(self.spark, path)
        for old in (where, _hadoop(self.spark, f"{path}.d")[1]):
            fs.delete(old, True)
        fs.rename(_hadoop(self.spark, f"{path}.new")[1], where)

    def save_names(self, names: DataFrame) -> None:
        """Rewrites the names by entity, each entity's in order of appending."""
        self.rewrite("names", names, ("entity_id", "seq"))

    def save_edges(self, hierarchy: DataFrame, relations: DataFrame) -> None:
        """Rewrites both kinds of edges, hierarchy first, each in order of appending."""
        both = hierarchy.withColumn("edge_type", F.lit("hierarchy")).unionByName(relations.withColumn("edge_type", F.lit("relation")), allowMissingColumns=True)
        self.rewrite("edges", both, ("edge_type", "seq"))

    def save_listed(self, table: str, rows: DataFrame) -> None:
        """Rewrites a listed table as one JSON list in order of seq, in parts."""
        own = [c for c in rows.columns if c != "seq"]
        self._write_whole(table, rows, "seq", F.to_json(F.struct(*own)), "[]")

    def save_keyed(self, table: str, rows: DataFrame, key: str) -> None:
        """Rewrites a keyed table as one JSON object with ascending keys, in parts."""
        quoted = F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]$", 1)
        self._write_whole(table, rows, key, F.concat(quoted, F.lit(":"), F.to_json(F.struct(*rows.columns))), "{}")


def versions_by_entity(versions: DataFrame, uid: str) -> DataFrame:
    return versions.where(F.array_contains("affected_entities", uid))


def versions_by_type(versions: DataFrame, change_type: str) -> DataFrame:
    return versions.where(F.col("change_type") == change_type)


def recent_versions(versions: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` by seq; all with 0."""
    return versions.orderBy(F.desc("seq")).limit(n) if n else versions


def create_versions(changes: DataFrame, millis: Column) -> DataFrame:
    """From (key, timestamp, change_type, change_reason, affected_entities, details) rows of the version log; the identifier comes
    from the time and the key, so a retried task gives the same."""
    return changes.select(F.concat(F.lit("sv_"), ulid(millis, F.col("key"))).alias("version_id"), "timestamp", "change_type", "change_reason", F.coalesce("affected_entities", F.array().cast("array<string>")).alias("affected_entities"), "details")


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """seq, organ_key, organ_name and the fields of every repository of a source registry."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", S.REGISTRY).alias("r"))
    organs = text.select(F.posexplode("r.organs").alias("o", "organ_key", "organ"))
    rows = organs.select("o", "organ_key", F.col("organ.name").alias("organ_name"), F.posexplode_outer("organ.repositories").alias("i", "repo"))
    return rows.select((F.col("o") * 1_000_000 + F.coalesce("i", F.lit(0))).cast("bigint").alias("seq"), "organ_key", "organ_name", "repo.*")


def tracked(repos: DataFrame) -> DataFrame:
    """One row a repository name (the last of equal names) with the fields whose changes count."""
    fields = ("status", "tier", "promotion_status", "implementation_status", "ci_workflow")
    return repos.where("name is not null").groupBy(F.col("name").alias("entity_id")).agg(F.max_by(F.struct(*fields), "seq").alias("x")).select("entity_id", "x.*")


def bootstrap(repos: DataFrame, entities: DataFrame, edges: DataFrame, at_millis: int) -> tuple[DataFrame, DataFrame]:
    """New entities (organs by organ_key, repositories by org/name) and hierarchy edges of those that aren't there yet.

    entities: uid, entity_type, tag (an organ's key or a repository's org/name). Existing rows are left as they are;
    equal repositories inside one file are all created; one without org or name never counts as existing. Of several organs
    with one key the last by seq (where entities have it) is the parent.
    """
    uid = lambda kind, key: entity_uid(F.lit(kind), F.lit(at_millis), key)
    have = entities.select("entity_type", "tag")
    organs = repos.groupBy(F.col("organ_key").alias("tag")).agg(F.min_by("organ_name", "seq").alias("name"))
    organs = organs.join(have.where("entity_type = 'organ'"), "tag", "left_anti").select(uid("organ", F.col("tag")).alias("uid"), F.lit("organ").alias("entity_type"), "tag", "name")
    named = repos.where("name is not null or org is not null").withColumn("tag", F.concat_ws("/", F.coalesce("org", F.lit("")), F.coalesce("name", F.lit(""))))
    whole = (F.coalesce("org", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    known = have.where("entity_type = 'repo'").select("tag").distinct().withColumn("__known", F.lit(True))
    fresh = named.join(known, "tag", "left").where(F.col("__known").isNull() | ~whole)
    fresh = fresh.select(uid("repo", F.concat_ws("#", "tag", F.col("seq").cast("string"))).alias("uid"), F.lit("repo").alias("entity_type"), "tag", "name", "organ_key")
    place = F.col("seq") if "seq" in entities.columns else F.lit(0)
    every = entities.select("uid", "entity_type", "tag", place.cast("bigint").alias("place"))
    every = every.unionByName(organs.drop("name").unionByName(fresh.select("uid", "entity_type", "tag")).withColumn("place", F.lit((1 << 63) - 1)))
    parents = every.where("entity_type = 'organ'").groupBy(F.col("tag").alias("organ_key")).agg(F.max_by("uid", F.struct("place", "uid")).alias("parent_id"))
    kids = named.select("tag", "organ_key").distinct().join(every.where("entity_type = 'repo'").select("tag", F.col("uid").alias("child_id")), "tag")
    links = kids.join(parents, "organ_key").select("parent_id", "child_id").distinct()
    links = links.join(edges.where("valid_to is null").select("parent_id", "child_id"), ["parent_id", "child_id"], "left_anti")
    return organs.unionByName(fresh.drop("organ_key")), links
