"""Elements of a page: regions from arrays, what tables leave over, classes, and the region at a place."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators.assemble import PAGE
from pagequarry.operators.matching import BOX, contained


def layout_elements(pages: DataFrame, min_score: float | None = None) -> DataFrame:
    """One row for each region of (class_names, boxes, scores): parallel arrays, whose classes may lack (then empty)
    and whose scores may lack (then 1). With ``min_score`` regions of a higher score alone stay."""
    rows = pages.select(*PAGE, F.posexplode(F.arrays_zip("boxes", "class_names", "scores")).alias("region_idx", "r"))
    made = rows.select(*PAGE, "region_idx", F.coalesce("r.class_names", F.lit("")).alias("type"), F.coalesce("r.scores", F.lit(1.0)).alias("confidence"), *[F.col("r.boxes")[i].alias(n) for i, n in enumerate(BOX)])
    return made if min_score is None else made.where(F.col("confidence") > min_score)


def positive(boxes: DataFrame) -> DataFrame:
    """Boxes that leave a crop of some width and height."""
    return boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def beside_tables(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Words whose centre lies in no cell; each word of a page has its own ``p``."""
    held = contained(words, cells.select(*PAGE, "cell_idx", *BOX), "cell_idx").select(*PAGE, "p").distinct()
    return words.join(held, [*PAGE, "p"], "left_anti")


def region_at(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Words with ``region``, the type of the smallest region that holds their centre; ties go to the first."""
    r = regions.select(*PAGE, "region_idx", *BOX, "type")
    inside = contained(points, r, "region_idx").select(*PAGE, "p", "region_idx").join(r, [*PAGE, "region_idx"])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = inside.groupBy(*PAGE, "p").agg(F.min_by("type", F.struct(area, "region_idx")).alias("region"))
    return points.join(best, [*PAGE, "p"], "left")


def by_class(boxes: DataFrame, column: str) -> DataFrame:
    """One row for each page: a map of class to its boxes, in their order ``p``."""
    box = F.array(*BOX)
    lists = boxes.groupBy(*PAGE, column).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", box.alias("b")))), lambda v: v["b"]).alias("_b"))
    return lists.groupBy(*PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column).alias("key"), F.col("_b").alias("value"))))).alias("boxes"))


def class_universe(gts: DataFrame, preds: DataFrame, column: str) -> DataFrame:
    return gts.select(column).union(preds.select(column)).distinct()


def vocabulary_union(*vocabs: Column) -> Column:
    """Characters of several vocabularies, each once, in the order in which they first occur."""
    return F.array_join(F.array_distinct(F.filter(F.concat(*[F.split(v, "") for v in vocabs]), lambda c: c != "")), "")


def rejoin(tiles: DataFrame, ratio: float) -> DataFrame:
    """One row for each crop of (crop, tile, value, confidence, last_overlap): its tiles' readings as one, the least confidence."""
    parts = tiles.groupBy("crop").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "value"))), lambda v: v["value"]).alias("p"), F.min("confidence").alias("confidence"), F.max("last_overlap").alias("_r"))
    return parts.select("crop", F.when(F.size("p") == 1, F.col("p")[0]).otherwise(T.join_readings(F.col("p"), ratio, ratio)).alias("value"), "confidence")


#: Allowed rows of a key that a task holds at once, rows that are compared with them in one go, and the slices
#: of a key's rows: enough of them to share the work, few enough that the allowed rows are not sent about too often.
HELD, TOGETHER, SLICE_ROWS, MOST_SLICES = 200_000, 256, 20_000, 16
#: Cosines in single precision that are this much below the largest are not the largest in double precision.
NEAR = 1e-4


def _matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows of doubles; what they lack is not a number."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] >= width:
        return flat.reshape(len(sizes), sizes[0])
    made = np.full((len(sizes), max(width, int(sizes.max(initial=0)))), np.nan)
    made[np.arange(made.shape[1]) < sizes[:, None]] = flat
    return made


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of two matrices, added from the first element on."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


class _Allowed:
    """Rows of one key among which the nearest are looked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.least = ids[order], vectors[order], ids[order[0]]
        self.length = np.sqrt(_dots(self.vectors, self.vectors))
        told = np.flatnonzero(self.length > 0)
        self.ids, self.vectors, self.length = self.ids[told], self.vectors[told], self.length[told]
        self.unit = np.ascontiguousarray((self.vectors / self.length[:, None]).T, np.float32)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines; a row whose cosines are all undefined has the smallest id, and -2."""
        near, best = np.full(len(vectors), self.least), np.full(len(vectors), -2.0)
        if not len(self.ids) or vectors.shape[1] != self.vectors.shape[1]:
            return near, best
        length = np.sqrt(_dots(vectors, vectors))
        told = np.flatnonzero(length > 0)
        for at in range(0, len(told), TOGETHER):
            some = told[at : at + TOGETHER]
            rough = (vectors[some] / length[some, None]).astype(np.float32) @ self.unit
            row, col = np.nonzero(rough >= rough.max(1, keepdims=True) - np.float32(NEAR))
            exact = _dots(vectors[some[row]], self.vectors[col]) / (length[some[row]] * self.length[col])
            order = np.lexsort((col, -exact, row))
            first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
            near[some[row[first]]], best[some[row[first]]] = self.ids[col[first]], exact[first]
        return near, best


def nearest(rows: DataFrame, allowed: DataFrame, key: str, vector: str) -> DataFrame:
    """``rows`` with ``near``, the id of the allowed row of the same key whose vector has the largest cosine; ties go to the smaller id.

    Every row is compared with every allowed row of its key, by products of matrices; those that are close to the
    largest are computed again in double precision. Of allowed rows with the same vector the one with the smallest id
    stands for all. A task has a slice of a key's rows and a block of ``HELD`` of its allowed rows, so no pairs are
    written; vectors are of numbers, of one length.
    """
    kind = rows.schema["id"].dataType.simpleString()
    right = allowed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).agg(F.min("id").alias("_id"))
    left = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"), F.col("id").alias("_id"))
    parts = left.groupBy("_key").agg(F.least(F.lit(MOST_SLICES), F.ceil(F.count(F.lit(1)) / SLICE_ROWS)).cast("int").alias("_parts"))
    blocks = allowed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("_blocks"))
    sizes = parts.join(blocks, "_key")
    deal = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = right.join(sizes, "_key").withColumn("_i", every("_parts")).select("_key", "_i", deal("_blocks").alias("_j"), F.lit(0).alias("_asks"), "_id", "_v")
    asks = left.join(sizes, "_key").withColumn("_j", every("_blocks")).select("_key", deal("_parts").alias("_i"), "_j", F.lit(1).alias("_asks"), "_id", "_v")
    place = ["_key", "_i", "_j"]
    both = held.unionByName(asks).repartition(*place).sortWithinPartitions(*place, "_asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, found = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*[batch.column(n).to_pylist() for n in (*place, "_asks")], strict=True))
            cuts = [0, *[k for k in range(1, len(marks)) if marks[k] != marks[k - 1]], len(marks)]
            for a, b in itertools.pairwise(cuts):
                some, (*group, asks_) = batch.slice(a, b - a), marks[a]
                ids = some.column("_id").to_numpy(zero_copy_only=False)
                if group != here:
                    here, waiting, found = group, [], None
                if not asks_:
                    waiting.append((ids, _matrix(some.column("_v"))))
                    continue
                if waiting:
                    width = max(v.shape[1] for _, v in waiting)
                    found = _Allowed(np.concatenate([i for i, _ in waiting]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1])), constant_values=np.nan) for _, v in waiting]))
                    waiting = []
                if found is not None:
                    near, best = found.nearest(_matrix(some.column("_v"), found.vectors.shape[1]))
                    yield pa.RecordBatch.from_arrays([some.column("_id"), pa.array(near).cast(some.column("_id").type), pa.array(best, pa.float64())], names=["id", "near", "best"])

    told = both.mapInArrow(run, f"id {kind}, near {kind}, best double")
    best = told.groupBy("id").agg(F.max(F.struct("best", (-F.col("near")).alias("near"))).alias("_m")).select("id", (-F.col("_m.near")).cast(kind).alias("near"))
    return rows.join(best, "id", "left")
