"""Boxes that meet, and their one-to-one pairs, for many pages at once in numpy.

Boxes of both sides come as one frame, ``side`` 0 for the truth and 1 for predictions, in which the rows of a
document follow one another. They are read once, as they come, and neither dealt nor sorted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.assemble import PAGE

BOX = ["x0", "y0", "x1", "y1"]
#: Rows that are taken at once, whole documents of them, and cells of the grid in which a page's boxes are looked up.
ROWS, ACROSS, DOWN = 65_536, 12, 40


def together(gts: DataFrame, preds: DataFrame, *columns: str, rising: bool = False) -> DataFrame:
    """Both sides in one frame, document by document; ``rising``, documents rise from one partition to the next too."""
    sides = [d.select(*PAGE, F.lit(k).alias("side"), "_id", *BOX, *columns) for k, d in enumerate((gts, preds))]
    every = sides[0].unionByName(sides[1])
    return (every.repartitionByRange("doc_id") if rising else every.repartition("doc_id")).sortWithinPartitions("doc_id")


def codes(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal values have equal numbers; null has -1."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pc.fill_null(pc.dictionary_encode(values).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def by_documents(boxes: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``run`` over tables of whole documents, with the number of each row's document, which rises from 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            whole = pa.Table.from_batches(held).combine_chunks()
            doc = codes(whole.column("doc_id"))
            new = np.r_[True, doc[1:] != doc[:-1]]
            end = n if last else int(np.flatnonzero(new)[-1])  # the last document may go on
            held, n = whole.slice(end).to_batches(), n - end
            if end:
                yield from run(whole.slice(0, end).combine_chunks(), (np.cumsum(new) - 1)[:end]).to_batches(max_chunksize=10_000)

        least = ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= least:
                yield from done(False)
                least = max(ROWS, 2 * n)  # one long document is not copied for each batch
        if n:
            yield from done(True)

    return boxes.mapInArrow(each, schema)


def _cells(page: np.ndarray, at: np.ndarray, some: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every cell of its page's grid that a box of ``some`` lies in; ``at`` gives cells of coordinates."""
    left, right = np.minimum(at[some, 0], at[some, 2]), np.maximum(at[some, 0], at[some, 2])
    top, bottom = np.minimum(at[some, 1], at[some, 3]), np.maximum(at[some, 1], at[some, 3])
    wide = right - left + 1
    n = wide * (bottom - top + 1)
    of = np.repeat(np.arange(len(some)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    cell = (page[some][of] * DOWN + top[of] + k // wide[of]) * ACROSS + left[of] + k % wide[of]
    order = np.argsort(cell, kind="stable")
    return cell[order], some[of[order]]


def meeting(page: np.ndarray, box: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(truth, prediction, IoU) of all boxes of one page that overlap, as row numbers. Boxes without a place meet none."""
    fine = np.isfinite(box).all(1)
    if not len(page) or not fine.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at = np.zeros(box.shape, np.int64)
    for k, cells in ((0, ACROSS), (1, DOWN)):
        low, high = np.full(page.max() + 1, np.inf), np.full(page.max() + 1, -np.inf)
        for c in (k, k + 2):
            np.minimum.at(low, page[fine], box[fine, c])
            np.maximum.at(high, page[fine], box[fine, c])
        span = np.where(high > low, high - low, 1.0)
        for c in (k, k + 2):
            at[fine, c] = np.minimum((box[fine, c] - low[page[fine]]) / span[page[fine]] * cells, cells - 1).astype(np.int64)
    cell_a, a = _cells(page, at, np.flatnonzero(fine & (side == 0)), box)
    cell_b, b = _cells(page, at, np.flatnonzero(fine & (side == 1)), box)
    first = np.searchsorted(cell_b, cell_a, "left")
    n = np.searchsorted(cell_b, cell_a, "right") - first
    x0, y0, x1, y1 = np.ascontiguousarray(box.T)
    found = []
    stops = np.cumsum(n)
    start = 0
    while start < len(a):  # boxes in crowded cells meet in turns
        stop = max(start + 1, int(np.searchsorted(stops, (stops[start - 1] if start else 0) + 4_000_000, "right")))
        some = n[start:stop]
        total = int(some.sum())
        i = np.repeat(a[start:stop], some)
        j = b[np.repeat(first[start:stop] - (np.cumsum(some) - some), some) + np.arange(total)]
        cell = np.repeat(cell_a[start:stop], some)
        for low, high in ((y0, y1), (x0, x1)):
            keep = np.flatnonzero((low[i] < high[j]) & (low[j] < high[i]))
            i, j, cell = i[keep], j[keep], cell[keep]
        # each pair once, in the cell of the corner at which their overlap begins
        keep = (page[i] * DOWN + np.maximum(at[i, 1], at[j, 1])) * ACROSS + np.maximum(at[i, 0], at[j, 0]) == cell
        i, j = i[keep], j[keep]
        ax0, ay0, ax1, ay1 = x0[i], y0[i], x1[i], y1[i]
        bx0, by0, bx1, by1 = x0[j], y0[j], x1[j], y1[j]
        both = np.maximum(0.0, np.minimum(ax1, bx1) - np.maximum(ax0, bx0)) * np.maximum(0.0, np.minimum(ay1, by1) - np.maximum(ay0, by0))
        union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - both
        found.append((i, j, np.where(union > 0, both / np.where(union > 0, union, 1.0), 0.0)))
        start = stop
    i, j, iou = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (a[:0], b[:0], np.empty(0))
    order = np.lexsort((j, i))
    return i[order], j[order], iou[order]


def paired(i: np.ndarray, j: np.ndarray, iou: np.ndarray, assign: Callable[[pd.DataFrame], pd.DataFrame]) -> np.ndarray:
    """Which of the meetings are the pairs, one to one, of the largest sum: those of boxes that meet no other, and ``assign`` for the rest."""
    if not len(i):
        return np.empty(0, np.int64)
    crowded = (np.bincount(i)[i] > 1) | (np.bincount(j)[j] > 1)
    lone, rest = np.flatnonzero(~crowded), np.flatnonzero(crowded)
    if not len(rest):
        return lone
    chosen = assign(pd.DataFrame({"a_id": i[rest], "b_id": j[rest], "iou": iou[rest]}, index=rest))
    return np.sort(np.r_[lone, chosen.index.to_numpy()])


def places(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Boxes and sides of a table's rows; those of no page or document have no place."""
    box = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in BOX], 1)
    for c in PAGE:
        if table.column(c).null_count:
            box[table.column(c).is_null().to_numpy()] = np.nan
    return box, table.column("side").to_numpy()


def pages_of(table: pa.Table, doc: np.ndarray) -> np.ndarray:
    """A number for each row's page, from 0."""
    at = codes(table.column("page_idx"))
    return np.unique(doc * (at.max() + 2) + at + 1, return_inverse=True)[1]
