"""Tables that executors share, and filters that keep texts out of shuffles.

A table written below ``spark.checkpoint.dir`` and read back cuts the lineage and
survives lost executors, unlike cached or locally checkpointed data. Its size on
disk is known to the planner, so a join with it is broadcast only if it really is
small. The shuffles that led to it are deleted as soon as it is written.

A :func:`bitmap` of keys is a table of at most ``MOST_BITS / 64`` rows, whatever
the number of keys, and so may be broadcast. It lets through every row whose key
is in it and few others; an exact join follows. With many more keys than bits it
lets nearly all through, and the exact join alone does the work.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 1 << 25
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local one is made only where that is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: For tables of large binary values: pages that hold several of them, and more effort.
TIGHT = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20)}

#: For tables whose rows are megabytes each: Parquet else looks at its buffers after a hundred rows only, and a row group is read at once.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}


def materialize(df: DataFrame, name: str, by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders by the columns ``by``, and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stemma/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options or {}).partitionBy(*by or []).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stemma_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stemma_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bitmap(keys: DataFrame, key: Column, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(__word, __bits) rows with a bit for each key's hash, and the number of bits: 16 a key, a power of two, ``most_bits`` at most."""
    n = keys.count()
    size = min(most_bits, 1 << max(12, (16 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(size))
    rows = keys.select(F.shiftright(place, 6).alias("__word"), F.pmod(place, F.lit(64)).cast("int").alias("__bit"))
    return rows.groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits")), size


def flagged(rows: DataFrame, key: Column, bits: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with __may: whether the key may be in the bitmap. A broadcast join with at most ``MOST_BITS / 64`` rows."""
    words, size = bits
    marked = rows.withColumn("__place", F.pmod(F.xxhash64(key), F.lit(size)))
    joined = marked.join(F.broadcast(words), F.shiftright("__place", 6) == F.col("__word"), "left")
    may = F.expr("coalesce(__bits & shiftleft(1L, cast(__place % 64 as int)), 0L) <> 0")
    return joined.withColumn("__may", may).drop("__place", "__word", "__bits")


def among(rows: DataFrame, key: Column, bits: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key may be in the bitmap."""
    return flagged(rows, key, bits).where("__may").drop("__may")


def identity(docs: DataFrame, id_: str = "doc_id", mark: str = "mark") -> list[Column]:
    """What tells rows of documents apart: the doc_id, and a hash of the text as doc_ids may repeat."""
    return [docs["doc_id"].cast("long").alias(id_), F.xxhash64(docs["text"]).alias(mark)]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs``, unchanged, that aren't in the written table ``gone`` (doc_id, mark). Only rows that the bitmap of
    ``gone`` lets through meet it in a join; all others stay where they are."""
    gone = gone.select(F.col("doc_id").cast("long").alias("__gone_id"), F.col("mark").alias("__gone_mark")).distinct()
    names = [f"__own{i}" for i in range(len(docs.columns))]
    own = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], *identity(docs, "__id", "__mark"))
    bits = bitmap(gone, F.struct("__gone_id", "__gone_mark"))
    rows = flagged(own, F.struct("__id", "__mark"), bits)
    same = F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__mark") == F.col("__gone_mark"))
    left = rows.where("__may").join(gone, same, "left_anti")
    return rows.where("not __may").union(left).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
