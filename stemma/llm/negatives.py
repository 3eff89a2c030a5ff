"""Hard-negative mining by distributed radix selection.

Anchors are held against all rows in cells of ``ANCHORS`` anchors by ``ROWS`` rows: an
equi-join of both tables on the cell's number, so that neither is broadcast and a
cell's memory is bounded. A cell computes integer scores by one matrix product.

An anchor's positives are its first rows of the same label. Each spans a window of
scores for negatives, and the kth row of a window is found by radix selection: cells
count the window's rows by the leading digit of their distance from the window's
upper end, the counts are added up, the digit that holds the kth row is located, and
only rows with that digit are counted by the next one. If the kth row is one of
several of equal score, the same goes on with the digits of their ids, so thousands of
copies of a vector never meet in one task. A window leaves the rounds as soon as whole
digits hold exactly k rows. Then only the rows up to the kth are gathered. A cell
reports digits only until it has counted the k rows itself: later ones cannot matter.

Nulls: rows with a null id, label or vector, or a component that is null or not
finite, take no part. Ties are settled by id. Of repeated anchors' ids one row is the
anchor, the least by label and vector; rows with an anchor's id are not its positives.
Repeated rows are candidates each. Vectors of unequal lengths are filled up with zeros.
Empty tables give empty results, an anchor without positives or a window without rows
no rows. Other columns are not looked at. Scores are exact up to 63 bits and wrap
beyond, as sums of longs do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

ANCHORS = 4096
ROWS = 16384
BITS = 8
CHUNK = 64
#: What a window has besides its anchor: its number, its positive, its upper end and width, how many rows are still to be
#: found, the digits found so far, and once it is closed the last distance and id to gather.
WINDOW = "j int, positive_id long, positive_score long, top long, width long, need long, near long, ids long, open boolean"


def vectors(table: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """A written table of row, vec_id, label, v: the rows that take part, with floor(scale * x) for every component x."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col("embedding"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return materialize(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", v.alias("v")), "vectors")


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integer inner products of the rows of a and b, in doubles only where these are exact."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Grid:
    """The cells of a table of vectors and its anchors."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        self.rows, self.anchors = rows, anchors
        n, width, low, high = rows.agg(F.count("*"), F.max(F.size("v")), F.min("vec_id"), F.max("vec_id")).first()
        self.width, self.low, self.id_bits = width or 0, low or 0, ((high or 0) - (low or 0)).bit_length()
        self.cells, self.blocks = max(1, -(-n // ROWS)), max(1, -(-anchors.count() // ANCHORS))

    def run(self, asking: DataFrame, find, schema: str) -> DataFrame:
        """``find(anchor, score, cell)`` gives columns of arrays for each row of ``asking`` (anchors, with windows) and each cell."""
        left = self.rows.select(F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("a"), F.pmod(F.xxhash64("row"), F.lit(self.cells)).cast("int").alias("s"), "vec_id", "label", "v")
        right = asking.select(F.pmod(F.xxhash64("anchor_id"), F.lit(self.blocks)).cast("int").alias("a2"), F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1))).alias("s2"), "anchor_id", "anchor_label", "anchor_v", "windows")
        width, names = self.width, [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64() if x.split()[1] == "long" else pa.int32() for x in schema.split(", ")]

        def cell(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
            found: list[list[np.ndarray]] = [[] for _ in names]
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            v = matrix(rows.column("v"), width) if rows.num_rows else np.zeros((0, width), np.int64)
            order = np.argsort(ids, kind="stable")
            ids, labels, v = ids[order], labels[order], v[order]
            for at in range(0, anchors.num_rows, CHUNK):
                some = anchors.slice(at, CHUNK)
                scores = products(matrix(some.column("anchor_v"), width), v)
                own = some.select(["anchor_id", "anchor_label", "windows"]).to_pylist()
                for anchor, score in zip(own, scores):
                    for columns in find(anchor, score, ids, labels):
                        for out, x in zip(found, columns):
                            out.append(x)
            return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(found, kinds)], names=names)

        return left.groupBy("a", "s").cogroup(right.groupBy("a2", "s2")).applyInArrow(cell, schema)


def anchors_of(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """A written table of anchor_id, anchor_label, anchor_v."""
    one = rows.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("x"))
    return materialize(one.select("anchor_id", F.col("x.label").alias("anchor_label"), F.col("x.v").alias("anchor_v")), "anchors")


def positives(grid: Grid, k: int) -> DataFrame:
    """anchor_id, j (from 1), positive_id, positive_score: each anchor's first k other rows of its label."""

    def find(anchor: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[list]:
        same = np.flatnonzero((labels == anchor["anchor_label"]) & (ids != anchor["anchor_id"]))
        if len(same) > k:  # everything from the kth score up, ties included, and of these the first k
            least = np.partition(score[same], len(same) - k)[len(same) - k]
            same = same[score[same] >= least]
        first = same[np.argsort(-score[same], kind="stable")[:k]]
        yield [np.full(len(first), anchor["anchor_id"]), ids[first], score[first]]

    empty = grid.anchors.withColumn("windows", F.array().cast("array<int>"))
    found = grid.run(empty, find, "anchor_id long, positive_id long, positive_score long")
    placed = found.withColumn("j", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")))
    return placed.where(F.col("j") <= k)


def windows_of(found: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """A window for each positive: scores from ``low`` to ``high`` hundredths of its own. top is the upper end."""
    # In hundreds and the rest, so that nothing overflows.
    parts = found.withColumn("rest", F.expr("pmod(positive_score, 100L)")).withColumn("hundreds", F.expr("(positive_score - rest) div 100"))
    ends = parts.withColumn("top", F.expr(f"{high} * hundreds + ({high} * rest) div 100"))
    ends = ends.withColumn("width", F.expr(f"top - ({low} * hundreds + ({low} * rest + 99) div 100)"))
    return ends.where("width >= 0").select("anchor_id", "j", "positive_id", "positive_score", "top", "width", F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("ids"), F.lit(True).alias("open"))


def with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    grouped = windows.groupBy("anchor_id").agg(F.collect_list(F.struct(*[c.split()[0] for c in WINDOW.split(", ")])).alias("windows"))
    return anchors.join(grouped, "anchor_id")


def count_digits(grid: Grid, windows: DataFrame, shift: int, by_id: bool) -> DataFrame:
    """anchor_id, j, digit, n: the rows of open windows that have the digits found so far, by the next digit of ``BITS`` bits."""
    base = grid.low

    def find(anchor: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[list]:
        other = np.flatnonzero(labels != anchor["anchor_label"])
        s = score[other]
        for w in anchor["windows"]:
            far = w["top"] - s
            if by_id:
                keys = ids[other[far == w["near"]]] - base
                held = keys[(keys >> shift >> BITS) == w["ids"]]
            else:
                held = far[(far >= 0) & (far <= w["width"])]
                held = held[(held >> shift >> BITS) == w["near"]]
            if len(held):
                digit, n = np.unique((held >> shift) & ((1 << BITS) - 1), return_counts=True)
                upto = int(np.searchsorted(np.cumsum(n), w["need"])) + 1
                yield [np.full(min(upto, len(n)), anchor["anchor_id"]), np.full(min(upto, len(n)), w["j"]), digit[:upto], n[:upto]]

    found = grid.run(with_windows(grid.anchors, windows.where("open")), find, "anchor_id long, j int, digit int, n long")
    return found.groupBy("anchor_id", "j", "digit").agg(F.sum("n").alias("n"))


def located(windows: DataFrame, counts: DataFrame, shift: int, by_id: bool, last_id: int) -> DataFrame:
    """Windows with the digit that holds the kth row, or closed where whole digits hold k rows or all there are."""
    digits = counts.groupBy("anchor_id", "j").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("digits"))
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(-1).alias("digit"), F.lit(0).cast("long").alias("n"))
    at = F.aggregate("digits", start, lambda s, x: F.when(s["before"] + s["n"] >= F.col("need"), s).otherwise(F.struct((s["before"] + s["n"]).alias("before"), x["digit"].alias("digit"), x["n"].alias("n"))))
    found = windows.join(digits, ["anchor_id", "j"], "left").withColumn("at", F.when(F.col("open") & F.col("digits").isNotNull(), at))
    held = F.col("at.before") + F.col("at.n")
    prefix = F.col("ids" if by_id else "near") * (1 << BITS) + F.col("at.digit")
    # Without rows, or with fewer than are needed: gather the whole window. With as many as are needed: up to this digit's end.
    short, exact = F.col("at").isNull() | (held < F.col("need")), held == F.col("need")
    end = (prefix + 1) * (1 << shift) - 1
    touched = F.col("open")
    near = F.col("near") if by_id else F.when(touched, F.when(short, F.col("width")).when(exact, end).otherwise(prefix)).otherwise(F.col("near"))
    if by_id:
        ids = F.when(touched, F.when(short, F.lit(last_id)).when(exact, end).otherwise(prefix)).otherwise(F.col("ids"))
    else:
        ids = F.when(touched, F.when(short | exact, F.lit(last_id)).otherwise(F.lit(0))).otherwise(F.col("ids"))
    need = F.when(touched & ~short & ~exact, F.col("need") - F.col("at.before")).otherwise(F.col("need"))
    return found.select("anchor_id", "j", "positive_id", "positive_score", "top", "width", need.alias("need"), near.cast("long").alias("near"), ids.cast("long").alias("ids"), (touched & ~short & ~exact).alias("open"))


def select_kth(grid: Grid, windows: DataFrame) -> DataFrame:
    """Closed windows: the first k rows have a distance less than ``near``, or that distance and an id up to ``ids`` from the least."""
    last_id = (1 << 63) - 1
    width = windows.agg(F.max("width")).first()[0] or 0
    for by_id, bits in ((False, width.bit_length()), (True, grid.id_bits)):
        for shift in range(BITS * max(0, -(-bits // BITS) - 1), -1, -BITS):
            if not windows.where("open").limit(1).count():
                return windows
            counts = count_digits(grid, windows, shift, by_id)
            new = materialize(located(windows, counts, shift, by_id, last_id), "windows")
            discard(windows)
            windows = new
    # Rows of one id: all their digits are equal, so they are gathered together and ranked.
    return windows


def gather(grid: Grid, windows: DataFrame, k: int) -> DataFrame:
    """anchor_id, j, negative_id, negative_score of the rows up to the kth of every window."""
    base = grid.low

    def find(anchor: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[list]:
        other = np.flatnonzero(labels != anchor["anchor_label"])
        s, keys = score[other], ids[other]
        for w in anchor["windows"]:
            far = w["top"] - s
            held = np.flatnonzero((far >= 0) & ((far < w["near"]) | ((far == w["near"]) & (keys - base <= w["ids"]))))
            held = held[np.argsort(far[held], kind="stable")[:k]]  # more than k only if ids repeat
            yield [np.full(len(held), anchor["anchor_id"]), np.full(len(held), w["j"]), keys[held], s[held]]

    return grid.run(with_windows(grid.anchors, windows), find, "anchor_id long, j int, negative_id long, negative_score long")


def mine(table: DataFrame, is_anchor: Column, label: Column | None = None, n_positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """For each anchor and positive the first k rows of other labels that score from ``low`` to ``high`` hundredths of the positive.

    table: vec_id, label, embedding. is_anchor is a condition on vec_id; label replaces the column of that name.
    """
    rows = vectors(table, F.col("label") if label is None else label, scale)
    anchors = anchors_of(rows, is_anchor)
    grid = Grid(rows, anchors)
    windows = select_kth(grid, materialize(windows_of(positives(grid, n_positives), k, low, high), "windows"))
    found = gather(grid, windows, k).withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "j").orderBy(F.desc("negative_score"), "negative_id"))).where(F.col("rank") <= k)
    out = materialize(found.join(windows, ["anchor_id", "j"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, anchors, windows)
    return out


def report(table: DataFrame) -> DataFrame:
    """The rows of the contract of op12."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(table, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), g AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 5
"""
