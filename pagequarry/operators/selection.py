"""Greedy selections that depend on what was kept before: grouped pandas, a page at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pagequarry.operators.assemble import PAGE


def nms(boxes: DataFrame, thresh: float = 0.5) -> DataFrame:
    """Rows left of (doc_id, page_idx, box_id, x0..y1, score): by falling score, a box stays if its IoU with every
    kept one is at most ``thresh``. Ties go to the smaller box_id."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y0", "box_id"])
        x0, y0, x1, y1 = (f[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
        rank = np.empty(len(f), np.int64)
        rank[np.lexsort((f["box_id"].to_numpy(), -f["score"].to_numpy()))] = np.arange(len(f))
        # pairs that overlap in height: those after a box that start above its lower edge
        above = np.arange(len(f))
        count = np.maximum(np.searchsorted(y0, y1, "left") - above - 1, 0)
        a = np.repeat(above, count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        meet = (x0[a] < x1[b]) & (x0[b] < x1[a])
        a, b = a[meet], b[meet]
        both = (np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b])) * (np.minimum(y1[a], y1[b]) - y0[b])
        area = (x1 - x0) * (y1 - y0)
        close = both > thresh * (area[a] + area[b] - both)
        a, b = a[close], b[close]
        first = np.where(rank[a] < rank[b], a, b)
        order = np.argsort(rank[first], kind="stable")
        left = [True] * len(f)
        # by the rank of the better box, whose own fate is settled by then
        for k, other in zip(first[order].tolist(), (a + b - first)[order].tolist()):
            if left[k]:
                left[other] = False
        return f[left]

    src = boxes.select(*PAGE, "box_id", "x0", "y0", "x1", "y1", "score")
    return src.groupBy(*PAGE).applyInPandas(run, src.schema)
