"""Hard-negative mining on one-dimensional distance keys, exact: the key intervals of an anchor grow until a bound certifies.

Vectors are integers (components times 256, rounded down) and scores inner products. With one more component,
sqrt(M^2 - |x|^2) with M the largest length, all vectors have length M, and to an anchor (q, 0) the distance is smaller the
higher the score: |q|^2 + M^2 - 2 * score is its square. Every row gets the key (pivot, distance to it) of its nearest
pivot. The table is stored sorted by key, cut into cells of CELL_ROWS rows, each an interval of one pivot's distances (an
annulus), so no key, pivot or group of copies is one task's alone. By the triangle inequality an interval bounds, from
both sides, the scores of its rows with an anchor.

Search. For each group of an anchor (its positives; per positive its negatives) the `k` best rows within a floor and a
ceiling are wanted. The first scan takes the intervals that hold the anchor's own key; what it finds raises the floor to
the k-th best. The second takes all other intervals that the bounds do not exclude, the floor rising on the way; what is
left out after it is certified not to matter. Positives have the anchor's label; for each of them the ceiling is its
score and the floor 4/5 of it. Anchors are a stated query set: blocks of BLOCK of them go to the tasks, and at most
BLOCK * PER * PER results of a scan come back.

Pivots come from a sample of SAMPLE rows (smallest hashes of ids); they have no influence on results, all rows are searched.

Defined results: rows with a null vec_id, label or vector, or a component that is null, not finite or beyond MOST in size
(scores are 64-bit), take no part. Where vectors differ in length, missing components count as 0; so an empty vector scores
0 with all. Rows that repeat a vec_id each take part, as anchors too, but are no others of each other. A positive whose
score is negative has no negatives; with a score of 0 those of score 0. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonlake.llm.common import small_batches, written

PER = 5
ANCHOR_EVERY = 100
CELL_ROWS = 2048
PIVOTS = 64
SAMPLE = 4096
BLOCK = 8192
#: Anchors whose scores with a cell are held at a time.
AT_ONCE = 512
MOST = 65_536.0
SCALE = 256

CELL = "pivot int, least double, most double, dims int, ids binary, labels binary, vectors binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NEVER = np.iinfo(np.int64).min


def taking_part(df: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; labels moved where the id is divisible by 7."""
    x = lambda v: v.cast("double")
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) <= MOST))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fit)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda v: F.floor(x(v) * SCALE).cast("int")).alias("vector"))


def matrix(column: pa.Array | list) -> np.ndarray:
    """Vectors as rows, missing components 0."""
    rows = column if isinstance(column, list) else None
    if rows is None:
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    else:
        flat, sizes = np.array([c for r in rows for c in r], np.int64), np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can leave 2^53."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Pivots:
    """Pivots as augmented vectors, all of length M."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most = most  # M squared
        full = self.augmented(sample)
        rng = np.random.default_rng(11)
        centre = full[rng.permutation(len(full))[:PIVOTS]]
        for _ in range(5):
            own = np.argmax(full @ centre.T, axis=1)
            sums = np.zeros_like(centre)
            np.add.at(sums, own, full)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centre = np.where(size > 0, sums / np.where(size > 0, size, 1) * np.sqrt(most), centre)
        self.centre = centre

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        """The added component stands first, so that lengths may differ."""
        rows = rows.astype(float)
        return np.hstack([np.sqrt(np.maximum(self.most - (rows**2).sum(1), 0))[:, None], rows])

    def keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distance to it."""
        full = self.augmented(rows)
        d = min(full.shape[1], self.centre.shape[1])
        near = full[:, :d] @ self.centre[:, :d].T
        own = np.argmax(near, axis=1)
        return own, np.sqrt(np.maximum(2 * self.most - 2 * near[np.arange(len(own)), own], 0))

    def from_anchors(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of anchors (q, 0) to all pivots, and |q|^2 + M^2."""
        d = min(rows.shape[1], self.centre.shape[1] - 1)
        whole = (rows.astype(float) ** 2).sum(1) + self.most
        return np.sqrt(np.maximum(whole[:, None] - 2 * rows[:, :d].astype(float) @ self.centre[:, 1 : d + 1].T, 0)), whole


# ---- index
def _keyed(pivots: Pivots) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            rows = matrix(column)
            pivot, distance = pivots.keys(rows)
            sizes = np.diff(column.offsets.to_numpy()).tolist()
            packed = [r[:n].astype("<i4").tobytes() for r, n in zip(rows, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(distance), batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["pivot", "distance", "vec_id", "label", "vector"])

    return run


def _celled(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cell(table: pa.Table) -> pa.RecordBatch:
        vectors = matrix([np.frombuffer(v, "<i4").tolist() for v in table["vector"].to_pylist()])
        ids, distance = table["vec_id"].to_numpy(), table["distance"].to_numpy()
        values = [[int(table["pivot"][0].as_py())], [float(distance.min())], [float(distance.max())], [vectors.shape[1]]]
        blobs = [[ids.astype("<i8").tobytes()], [table["label"].to_numpy().astype("<i8").tobytes()], [vectors.astype("<i4").tobytes()]]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values + blobs, kinds, strict=True)], names=[c.split()[0] for c in CELL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows:
                pivot = held["pivot"].to_numpy()
                size = min(rows, int(np.searchsorted(pivot, pivot[0], "right")))
                if size == held.num_rows and size < rows:
                    break  # more of the interval may follow
                yield cell(held.slice(0, size).combine_chunks())
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield cell(held.combine_chunks())

    return run


def index(df: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Pivots] | None:
    """Cells of all rows, sorted by (pivot, distance), written to the shared folder; None where no row takes part."""
    rows = taking_part(df)
    length = F.aggregate("vector", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v)
    most = rows.agg(F.max(length)).first()[0]
    if most is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    pivots = Pivots(matrix(sample), float(most))
    keyed = small_batches(rows).mapInArrow(_keyed(pivots), "pivot int, distance double, vec_id long, label long, vector binary")
    placed = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return written(placed.mapInArrow(_celled(cell_rows), CELL), "cells"), pivots


# ---- search
class Wanted:
    """What a block of anchors asks for: groups, each an anchor's row with a floor and a ceiling, and one label rule."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, pivots: Pivots, anchor: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, same: bool, own: bool):
        self.ids, self.labels, self.rows, self.anchor, self.ceiling, self.same, self.own = ids, labels, rows, anchor, ceiling, same, own
        self.floor = floor.copy()
        self.pivot, self.distance = pivots.keys(rows)
        self.far, self.whole = pivots.from_anchors(rows)
        #: Rounding in distances stays far below this share of |q|^2 + M^2.
        self.slack = 1e-6 * self.whole + 1
        self.found = np.zeros((3, 0), np.int64)  # group, -score, id: the PER best of each group so far, sorted

    def touched(self, pivot: int, least: float, most: float) -> np.ndarray:
        """Anchors for which an interval may hold a wanted row; own intervals belong to the first scan alone."""
        edge = self.slack / np.sqrt(self.whole)
        home = (self.pivot == pivot) & (self.distance >= least - edge) & (self.distance <= most + edge)
        far = self.far[:, pivot]
        near = np.maximum(np.maximum(far - most, least - far), 0)
        upper, lower = (self.whole - near**2) / 2 + self.slack, (self.whole - (far + most) ** 2) / 2 - self.slack
        floor, ceiling = np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
        np.minimum.at(floor, self.anchor, self.floor.astype(float))
        np.maximum.at(ceiling, self.anchor, self.ceiling.astype(float))
        return np.flatnonzero((home == self.own) & (upper >= floor) & (lower <= ceiling))

    def take(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, touched: np.ndarray) -> None:
        """Adds a cell's rows for the anchors that it touches."""
        groups = np.argsort(self.anchor, kind="stable")
        begin, end = (np.searchsorted(self.anchor[groups], touched, s) for s in ("left", "right"))
        for at in range(0, len(touched), AT_ONCE):
            some = touched[at : at + AT_ONCE]
            scores = products(self.rows[some], vectors)
            fits = ((labels == self.labels[some, None]) == self.same) & (ids != self.ids[some, None])
            for turn in range(int((end - begin)[at : at + AT_ONCE].max(initial=0))):  # the turn-th group of each anchor
                has = begin[at : at + AT_ONCE] + turn < end[at : at + AT_ONCE]
                group = groups[np.where(has, begin[at : at + AT_ONCE] + turn, 0)]
                a, row = np.nonzero(fits & has[:, None] & (scores >= self.floor[group, None]) & (scores <= self.ceiling[group, None]))
                if len(a):
                    self._add(np.stack([group[a], -scores[a, row], ids[row]]))

    def _add(self, new: np.ndarray) -> None:
        touched = np.isin(self.found[0], new[0])
        both = np.concatenate([self.found[:, touched], new], axis=1)
        both = both[:, np.lexsort((both[2], both[1], both[0]))]
        first = np.searchsorted(both[0], both[0])
        rank = np.arange(both.shape[1]) - first
        full = rank == PER - 1
        self.floor[both[0, full]] = np.maximum(self.floor[both[0, full]], -both[1, full])
        self.found = np.concatenate([self.found[:, ~touched], both[:, rank < PER]], axis=1)


def _scanner(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(*sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                touched = wanted.touched(row["pivot"], row["least"], row["most"])
                if len(touched):
                    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                    wanted.take(ids, labels, np.frombuffer(row["vectors"], "<i4").reshape(len(ids), row["dims"]).astype(np.int64), touched)
        group, score, found = wanted.found
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(-score), pa.array(found)], names=["group", "score", "id"])

    return run


def _limited(found: DataFrame) -> DataFrame:
    """The PER best of each group; each task limits its own before the shuffle."""
    order = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PER)


def _searched(cells: DataFrame, pivots: Pivots, anchors: tuple, group_of: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, same: bool) -> DataFrame:
    """(group, score, id, rank) of both scans: own intervals first, then all that the floors from there do not exclude."""
    spark = cells.sparkSession
    scan = lambda floor, own: cells.mapInArrow(_scanner(spark.sparkContext.broadcast((*anchors, pivots, group_of, floor, ceiling, same, own))), "group long, score long, id long")
    near = written(_limited(scan(floor, True)), "near")
    full = near.filter(F.col("rank") == PER).select("group", "score").toArrow()
    floor = floor.copy()
    floor[full["group"].to_numpy()] = np.maximum(floor[full["group"].to_numpy()], full["score"].to_numpy())
    return _limited(near.drop("rank").unionByName(scan(floor, False)))


def mined(df: DataFrame, every: int = ANCHOR_EVERY, block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Hard negatives of the anchors, rows whose vec_id is divisible by `every`."""
    spark = df.sparkSession
    indexed = index(df, cell_rows)
    out = spark.createDataFrame([], RESULT)
    if indexed is None:
        return out
    cells, pivots = indexed
    asked = taking_part(df).filter(F.col("vec_id") % every == 0)
    blocks = -(-asked.count() // block)
    place = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        some = asked.filter(place == b).orderBy("vec_id").toArrow()  # about `block` rows
        rows = matrix(some["vector"].combine_chunks())
        anchors = (some["vec_id"].to_numpy(), some["label"].to_numpy(), rows)
        n = len(rows)
        positive = _searched(cells, pivots, anchors, np.arange(n), np.full(n, NEVER), np.full(n, np.iinfo(np.int64).max), True).orderBy("group", "rank").toArrow()
        if not positive.num_rows:
            continue
        anchor, score, own = (positive[c].to_numpy() for c in ("group", "score", "id"))
        negative = _searched(cells, pivots, anchors, anchor, -(-80 * score // 100), score, False)
        names = spark.createDataFrame(pa.table({"group": np.arange(len(own)), "anchor_id": anchors[0][anchor], "positive_id": own, "positive_score": score}))
        found = negative.join(F.broadcast(names), "group")  # a row a positive of the block
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = found if blocks == 1 else out.unionByName(written(found, "negatives"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > 65536)) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
      FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER own AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW own AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER own <= 5
"""
