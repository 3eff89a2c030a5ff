"""Session defaults, and cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType


def session(name: str = "stemma", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC, and whatever ``conf`` adds (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local one is made only where that is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession):
    """What is written inside has the shuffles that led to it deleted as soon as it is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir``, so that a loop's plan stays short and survives lost executors.

    Unlike after ``checkpoint()``, the planner knows the true size, the rows are computed once, and the shuffles that led to
    them are deleted as soon as they are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stemma/step-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stemma_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`checkpointed` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stemma_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """``rows`` with dense numbers from 1 in the given order, without a window over all of them.

    Rows are dealt by ranges of the order and sorted there; a number is the place in the range plus the sizes of the ranges
    before it, of which there are as many as shuffle partitions. Written first, so that numbers are the same at every reading.
    """
    placed = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = checkpointed(placed.withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = placed.withColumn("__range", F.shiftright("__at", 33)).join(F.broadcast(starts), "__range")
    return out.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__range", "__start")


def running(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with before_<value> for each of the values (longs or doubles): the sum over all rows that come earlier in the order.

    Rows are dealt by ranges of the order and sorted there, so that a key with a third of all rows is spread; sums within a range
    are made as it streams by, and one row a range brings the sums of those before it. The order must be that of distinct rows.
    """
    rows = rows.select(*rows.columns, *[F.lit(0).cast(rows.schema[v].dataType).alias(f"before_{v}") for v in values], F.lit(0).alias("__range"))
    names = rows.columns

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, sums = TaskContext.get().partitionId(), dict.fromkeys(values)
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            for v in values:
                own = columns[v].to_numpy(zero_copy_only=False)
                if sums[v] is None:
                    sums[v] = own.dtype.type(0)
                upto = own.cumsum() + sums[v]
                columns[f"before_{v}"] = pa.array(upto - own, columns[v].type)
                sums[v] = upto[-1] if len(upto) else sums[v]
            columns["__range"] = pa.array([task] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, rows.schema))
    sizes = placed.groupBy("__range").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    out = placed.join(F.broadcast(starts), "__range")
    return out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"__{v}") for v in values}).drop("__range", *[f"__{v}" for v in values])


def running_within(rows: DataFrame, key: str, order: list[str], values: list[str], asked: str, kept: list[str]) -> DataFrame:
    """kept (the key among them) and before_<value> of the rows with a true ``asked``: the sums over all rows of the same key that come earlier in the order.

    As :func:`running`, but sums begin anew with each key (text), so nothing has to be taken off, and only rows asked for are
    written. A range ends with one row of what its last key came to, which later ranges that begin with that key add.
    """
    placed = rows.select(key, *[F.col(c) for c in order if c != key], *[c for c in {asked: 0, **dict.fromkeys(kept), **dict.fromkeys(values)} if c not in (key, *order)])
    types = {f.name: f.dataType for f in placed.schema.fields}
    out = StructType([*[StructField(c, types[c]) for c in kept], *[StructField(f"before_{v}", types[v]) for v in values],
                      StructField("__range", IntegerType()), StructField("__first", types[key]), StructField("__last", types[key]), StructField("__ends", BooleanType())])
    names, plain = placed.columns, out.fieldNames()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, first, last, seen = TaskContext.get().partitionId(), None, None, False
        tails = dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = dict(zip(names, batch.columns))
            k = columns[key]
            one, two = k.slice(0, n - 1), k.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
            new = np.ones(n, bool)
            new[1:] = ~same.to_numpy(zero_copy_only=False)
            goes_on = seen and k[0].as_py() == last
            first = first if seen else k[0].as_py()
            part, begins = new.cumsum() - 1, np.flatnonzero(new)
            for v in values:
                own = columns[v].to_numpy(zero_copy_only=False)
                upto = own.cumsum()
                base = (upto - own)[begins]
                if goes_on:
                    base[0] -= tails[v]
                columns[f"before_{v}"] = pa.array(upto - own - base[part], columns[v].type)
                tails[v] = upto[-1] - base[-1]
            seen, last = True, k[n - 1].as_py()
            mask = pc.fill_null(columns[asked], False)
            lines = {"__range": pa.array([task] * n, pa.int32()), "__first": pa.nulls(n, k.type), "__last": pa.nulls(n, k.type), "__ends": pa.array([False] * n)}
            made = pa.RecordBatch.from_arrays([(columns | lines)[c] for c in plain], names=plain)
            types_of = made.schema
            yield made.filter(mask)
        if seen:
            end = {f"before_{v}": tails[v] for v in values} | {"__range": task, "__first": first, "__last": last, "__ends": True}
            yield pa.RecordBatch.from_arrays([pa.array([end.get(c)], types_of.field(c).type) for c in plain], names=plain)

    keys = [F.col(c).asc_nulls_first() for c in [key, *[c for c in order if c != key]]]
    done = checkpointed(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, out))
    ends = done.where("__ends").select("__range", "__first", "__last", *[F.col(f"before_{v}").alias(f"__{v}") for v in values])
    tail = ends.select(F.col("__range").alias("__of"), F.col("__last").alias("__key"), *[f"__{v}" for v in values])
    carried = ends.select("__range", "__first").join(tail, (F.col("__of") < F.col("__range")) & F.col("__key").eqNullSafe(F.col("__first")))
    carried = carried.groupBy("__range").agg(F.first("__key").alias("__key"), *[F.sum(f"__{v}").alias(f"__{v}") for v in values])
    got = done.where("not __ends").drop("__first", "__last", "__ends").withColumnRenamed(key, "__own").join(F.broadcast(carried), "__range", "left")
    more = lambda v: F.when(F.col("__own").eqNullSafe(F.col("__key")), F.coalesce(f"__{v}", F.lit(0))).otherwise(0)
    got = got.withColumns({f"before_{v}": F.col(f"before_{v}") + more(v) for v in values}).withColumnRenamed("__own", key)
    return got.select(*kept, *[f"before_{v}" for v in values])
