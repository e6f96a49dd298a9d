"""Evaluation of detected boxes, texts, classes and table cells against the truth.

Boxes are paired one to one within a page so that the sum of IoUs is largest. Pairs of which neither box meets
another are settled by joins; the rest, page by page, in numpy. Every metric is a sum of counters that is
divided at the end, so documents can be added up; a ratio with nothing to divide by is null. With ``met_only``,
documents of which no truth meets a prediction are left out; otherwise they have zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import same_text
from pagequarry.operators.assemble import PAGE
from pagequarry.operators import pairing
from pagequarry.operators.matching import BOX, overlaps, ratio

#: Buckets of scores in which detections are ranked apart, and thresholds of the mean average precision.
BUCKETS, THRESHOLDS = 4096, tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


def heaviest(weight: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs, each used once, of the largest sum of non-negative weights.

    Rows are added one by one; each takes the cheapest alternating path to a free column, with prices that keep
    every used edge tight.
    """
    flipped = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flipped else weight)
    n, m = cost.shape
    owner = np.full(m, -1)
    row_price, col_price = np.zeros(n), np.zeros(m)
    for new in range(n):
        far = cost[new] - row_price[new] - col_price
        via, open_ = np.full(m, new), np.ones(m, bool)
        tree, total = [], 0.0
        while True:
            col = int(np.where(open_, far, np.inf).argmin())
            total = far[col]
            open_[col] = False
            if owner[col] < 0:
                break
            row = int(owner[col])
            tree.append((row, col))
            there = total + cost[row] - row_price[row] - col_price
            nearer = open_ & (there < far)
            far[nearer], via[nearer] = there[nearer], row
        row_price[new] += total
        for row, c in tree:
            row_price[row] += total - far[c]
            col_price[c] -= total - far[c]
        while True:  # back along the path, every column changes hands
            row = int(via[col])
            before = np.flatnonzero(owner == row)
            owner[col] = row
            if row == new:
                break
            col = int(before[before != col][0])
    found = [(int(r), c) for c, r in enumerate(owner) if r >= 0]
    return [(c, r) for r, c in found] if flipped else found


def _assign(f: pd.DataFrame) -> pd.DataFrame:
    """The chosen pairs of one page, group by group of boxes that meet."""
    a, left = pd.factorize(f["a_id"])
    b, right = pd.factorize(f["b_id"])
    label = np.arange(len(left) + len(right))
    while True:  # the smallest label around spreads over each group
        low = np.minimum(label[a], label[b + len(left)])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b + len(left), low)
        if (new == label).all():
            break
        label = new
    keep = []
    for _, part in f.assign(_a=a, _b=b).groupby(label[a], sort=False):
        rows, cols = part["_a"].unique(), part["_b"].unique()
        weight = np.zeros((len(rows), len(cols)))
        at = {(x, y): k for x, y, k in zip(part["_a"], part["_b"], part.index, strict=True)}
        weight[pd.Index(rows).get_indexer(part["_a"]), pd.Index(cols).get_indexer(part["_b"])] = part["iou"]
        keep += [at[k] for x, y in heaviest(weight) if (k := (rows[x], cols[y])) in at]
    return f.loc[keep]


def matched(gts: DataFrame, preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, all overlaps) of boxes with ids: columns of the page, a_id (truth), b_id (prediction), iou."""
    met = overlaps(gts, preds, "_id", "_id").select(*PAGE, "a_id", "b_id", "iou")
    a, b = Window.partitionBy(*PAGE, "a_id"), Window.partitionBy(*PAGE, "b_id")
    counted = met.withColumn("_n", F.greatest(F.count(F.lit(1)).over(a), F.count(F.lit(1)).over(b)))
    lone = counted.where("_n = 1").drop("_n")
    # a group with more than pairs of one: all its edges, also those whose own boxes meet once
    rest = counted.where("_n > 1").drop("_n")
    return lone.unionByName(rest.groupBy(*PAGE).applyInPandas(_assign, rest.schema)), met


def _counts(gts: DataFrame, preds: DataFrame, met: DataFrame, how: str = "left") -> DataFrame:
    """doc_id, n_gt, n_pred and the sum over predictions of their best IoU; documents of one side alone count too, unless
    ``how`` is inner."""
    n = gts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gt")).join(preds.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pred")), "doc_id", "full")
    best = met.groupBy(*PAGE, "b_id").agg(F.max("iou").alias("i")).groupBy("doc_id").agg(F.sum("i").alias("_best"))
    return n.join(best, "doc_id", how).na.fill(0, ["n_gt", "n_pred", "_best"])


def _counters(boxes: DataFrame, thresh: float, values: str | None, null_safe: bool) -> DataFrame:
    """A row for each document with counts of both sides, the sum over predictions of their best IoU, the pairs from
    ``thresh`` on, and those of equal ``values``; with more rows (_x, _y, _k) for how often values of near pairs differ,
    unless ``null_safe``, which counts equal values alone."""
    told = values is not None and not null_safe
    kind = lambda c: boxes.schema[c].dataType.simpleString()
    schema = f"doc_id {kind('doc_id')}, n_gt long, n_pred long, _best double, _met long, _near long, _same long" + (f", _x {kind(values)}, _y {kind(values)}, _k long" if told else "")

    def run(t: pa.Table, doc: np.ndarray) -> pa.Table:
        box, side = pairing.places(t)
        docs = int(doc[-1]) + 1
        i, j, iou = pairing.meeting(pairing.pages_of(t, doc), box, side)
        best = np.zeros(len(doc))
        np.maximum.at(best, j, iou)
        kept = pairing.paired(i, j, iou, _assign)
        kept = kept[iou[kept] >= thresh]
        i_near, j_near = i[kept], j[kept]
        tally = lambda rows: np.bincount(doc[rows], minlength=docs)
        ids = t.column("doc_id").take(pa.array(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])))
        same = np.ones(len(kept), bool)
        if values is not None:
            x, y = t.column(values).take(pa.array(i_near)), t.column(values).take(pa.array(j_near))
            cx, cy = np.split(pairing.codes(pa.concat_arrays([x.combine_chunks(), y.combine_chunks()])), 2)
            same = (cx == cy) & (null_safe | (cx >= 0))
        made = [ids, tally(side == 0), tally(side == 1), np.bincount(doc, best, minlength=docs), tally(i), tally(i_near), tally(i_near[same])]
        if told:
            apart = np.flatnonzero(~same & (cx >= 0) & (cy >= 0))
            key = np.stack([doc[i_near][apart], cx[apart], cy[apart]], 1)
            _, first, often = np.unique(key, axis=0, return_index=True, return_counts=True)
            at, zero = apart[first], np.zeros(len(first), np.int64)
            more = [ids.take(pa.array(doc[i_near][at])), zero, zero, zero.astype(float), zero, zero, zero]
            none = pa.nulls(docs, x.type)
            join = lambda p, q: pa.chunked_array([*(p.chunks if isinstance(p, pa.ChunkedArray) else [pa.array(p)]), *(q.chunks if isinstance(q, pa.ChunkedArray) else [pa.array(q)])])
            made = [join(p, q) for p, q in zip([*made, none, none, np.zeros(docs, np.int64)], [*more, x.take(pa.array(at)), y.take(pa.array(at)), often], strict=True)]
        return pa.table(made, names=[c.split()[0] for c in schema.split(", ")])

    return pairing.by_documents(boxes.select(*PAGE, "side", *BOX, *([values] if values else [])), run, schema)


def _of_documents(counters: DataFrame, hits: list[str], near_only: bool, met_only: bool) -> DataFrame:
    some = counters.where("_near > 0") if near_only else counters.where("_met > 0") if met_only else counters
    rates = [c for n in hits for c in (ratio(F.col(n), F.col("n_gt")).alias(f"recall_{n}"), ratio(F.col(n), F.col("n_pred")).alias(f"precision_{n}"))]
    return some.select("doc_id", "n_gt", "n_pred", *rates, F.bround(F.try_divide("_best", "n_pred"), 2).alias("mean_iou"))


def localization_of(boxes: DataFrame, thresh: float = 0.5, met_only: bool = False) -> DataFrame:
    """``localization`` of both sides in one frame, as ``pairing.together`` gives it."""
    return _of_documents(_counters(boxes, thresh, None, False).withColumnRenamed("_near", "boxes"), ["boxes"], False, met_only)


def localization(gts: DataFrame, preds: DataFrame, thresh: float = 0.5, met_only: bool = False) -> DataFrame:
    """Recall, precision and mean IoU of boxes per document; a pair counts from ``thresh`` on."""
    return localization_of(pairing.together(gts, preds), thresh, met_only)


def _both(gts: DataFrame, preds: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    a = gts.select(*PAGE, F.col("_id").alias("a_id"), F.col(column).alias("_x"))
    b = preds.select(*PAGE, F.col("_id").alias("b_id"), F.col(column).alias("_y"))
    return pairs.join(a, [*PAGE, "a_id"]).join(b, [*PAGE, "b_id"])


def recognition_of(boxes: DataFrame, thresh: float = 0.5, met_only: bool = False) -> DataFrame:
    """``recognition`` of both sides in one frame, as ``pairing.together`` gives it."""
    same = same_text(F.col("_x"), F.col("_y"))
    # equal texts are equal in every way; the others are compared, those of a document that are alike once
    told = [(F.sum("_same") + F.sum(F.when(F.coalesce(c, F.lit(False)), F.col("_k")).otherwise(0))).alias(n) for n, c in same.items()]
    counters = _counters(boxes, thresh, "value", False).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in ("n_gt", "n_pred", "_best", "_met", "_near")], *told)
    return _of_documents(counters, list(same), met_only, met_only)


def recognition(gts: DataFrame, preds: DataFrame, thresh: float = 0.5, met_only: bool = False) -> DataFrame:
    """End-to-end reading per document: a pair of boxes counts if its ``value`` agrees, in four ways. ``met_only``
    asks for a pair from ``thresh`` on."""
    return recognition_of(pairing.together(gts, preds, "value"), thresh, met_only)


def detection_of(boxes: DataFrame, thresh: float = 0.5, column: str = "label", met_only: bool = False) -> DataFrame:
    """``detection`` of both sides in one frame, as ``pairing.together`` gives it."""
    return _of_documents(_counters(boxes, thresh, column, True).withColumnRenamed("_same", "classes"), ["classes"], False, met_only)


def detection(gts: DataFrame, preds: DataFrame, thresh: float = 0.5, column: str = "label", met_only: bool = False) -> DataFrame:
    """Boxes with classes per document: a pair counts if its classes are equal."""
    return detection_of(pairing.together(gts, preds, column), thresh, column, met_only)


def table_cells(gts: DataFrame, preds: DataFrame, logic: Column, thresh: float = 0.5) -> DataFrame:
    """Recall, precision and F1 of cells per document, and the share of matched cells whose place in the table agrees."""
    pairs, _ = matched(gts, preds)
    near = _both(gts.withColumn("_logic", logic), preds.withColumn("_logic", logic), pairs.where(F.col("iou") >= thresh), "_logic")
    hits = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("_x") == F.col("_y")).cast("long")).alias("s"))
    every = _counts(gts, preds, pairs).join(hits, "doc_id", "left").na.fill(0, ["m", "s"])
    f1 = F.when(F.col("m") > 0, F.round(2 * F.col("m") / (F.col("n_gt") + F.col("n_pred")), 6))
    return every.select("doc_id", ratio(F.col("m"), F.col("n_gt")).alias("recall"), ratio(F.col("m"), F.col("n_pred")).alias("precision"), f1.alias("f1"), ratio(F.col("s"), F.col("m")).alias("structure"))


def _judged(t: pa.Table, doc: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of predictions, first and last threshold for which each is right, as a half-open range, number of its label).

    A detection belongs to the box of its class and page with the highest IoU; it is right where no better one of
    its box is beyond the threshold."""
    box, side = pairing.places(t)
    i, j, iou = pairing.meeting(pairing.pages_of(t, doc), box, side)
    label = pairing.codes(t.column("label"))
    alike = (label[i] == label[j]) & (label[i] >= 0)
    i, j, iou = i[alike], j[alike], iou[alike]
    ids = pc.rank(t.column("_id").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    score = pc.fill_null(t.column("score").cast(pa.float64()), -np.inf).to_numpy()
    if len(j) and np.bincount(j).max() > 1:
        order = np.lexsort((ids[i], -iou, j))
        i, j, iou = i[order], j[order], iou[order]
        best = np.r_[True, j[1:] != j[:-1]]
        i, j, iou = i[best], j[best], iou[best]
    reach = np.searchsorted(thresholds, iou, "right")
    before = np.zeros(len(j), np.int64)
    if len(i) and np.bincount(i).max() > 1:
        order = np.lexsort((ids[j], -np.where(np.isnan(score), np.inf, score)[j], i))
        i, j, reach = i[order], j[order], reach[order]
        new = np.r_[True, i[1:] != i[:-1]]
        base = np.cumsum(new) * (len(thresholds) + 1)
        before[1:] = np.where(new[1:], 0, np.maximum.accumulate(base + reach)[:-1] - base[1:])
    start, stop = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    right = reach > before
    start[j[right]], stop[j[right]] = before[right], reach[right]
    rows = np.flatnonzero(side == 1)
    return rows, start[rows], stop[rows], label


def _blobs(t: pa.Table, doc: np.ndarray, thresholds: np.ndarray, kind: type) -> pa.Table:
    """A row for each class and score with what its predictions are right for, in the order of their documents, pages
    and ids; and one for each class with the number of its truths."""
    rows, start, stop, label = _judged(t, doc, thresholds)
    p = t.take(pa.array(rows))
    score = p.column("score").cast(pa.float64())
    known = pc.fill_null(score, -np.inf).to_numpy()
    order_of = lambda c: pc.rank(p.column(c).combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    order = np.lexsort((order_of("_id"), order_of("page_idx"), doc[rows], -known, label[rows]))
    by = np.stack([label[rows][order].astype(float), np.where(np.isnan(known), np.inf, known)[order]])
    first = np.flatnonzero(np.r_[True, (by[:, 1:] != by[:, :-1]).any(0)]) if len(rows) else np.empty(0, np.int64)
    got = (start * (len(thresholds) + 1) + stop)[order].astype(kind)
    at, n_true = np.unique(label[t.column("side").to_numpy() == 0], return_counts=True)
    one = np.zeros(label.max() + 2, np.int64)
    one[label] = np.arange(len(label))  # some row of each class; null is last
    ends, none = pa.array(order[first]), lambda x: pa.nulls(len(at), x.type)
    bucket = pc.floor(pc.multiply(score, float(BUCKETS))).cast(pa.int64(), safe=False).take(ends).combine_chunks()
    labels = [p.column("label").take(ends).combine_chunks(), t.column("label").take(pa.array(one[at])).combine_chunks()]
    scores, docs = p.column("score").take(ends).combine_chunks(), t.column("doc_id").take(pa.array(np.zeros(len(first) + len(at), np.int64)))
    blobs = pa.array([*(x.tobytes() for x in (np.split(got, first[1:]) if len(first) else [])), *[b""] * len(at)], pa.binary())
    return pa.table([pa.concat_arrays(labels), pa.concat_arrays([bucket, none(bucket)]), pa.concat_arrays([scores, none(scores)]), docs, blobs, np.r_[np.zeros(len(first), np.int64), n_true]], names=["label", "_scored", "score", "doc_id", "_got", "_gt"])


def _sums(batches: Iterator[pa.RecordBatch], width: int, kind: type, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of the rows of ``_blobs``: truths, predictions, and those right for each threshold."""
    for batch in batches:
        made = np.zeros((width, batch.num_rows), np.int64)
        for row, blob in enumerate(batch.column("_got")):
            start, stop = np.divmod(np.frombuffer(blob.as_py(), kind).astype(np.int64), width)
            made[0, row] = len(start)
            made[1:, row] = np.cumsum(np.bincount(start, minlength=width) - np.bincount(stop, minlength=width))[: width - 1]
        yield pa.record_batch([batch.column("label"), batch.column("_scored"), batch.column("_gt"), *map(pa.array, made)], names=names)


def _peaks(batches: Iterator[pa.RecordBatch], thresholds: np.ndarray, kind: type, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(label, threshold, level of recall, best precision) of buckets in order, whose first row tells of what is above them."""
    width = len(thresholds) + 1
    key, head, label, best = None, None, None, None
    n, tps = 0, np.zeros(width - 1, np.int64)

    def ended() -> Iterator[pa.RecordBatch]:
        if head is None:
            return
        at = np.argwhere(best > 0)
        if head[0] == 0:  # the class's first bucket: every threshold has a row
            at = np.unique(np.concatenate([at, np.stack([np.arange(width - 1), np.zeros(width - 1, np.int64)], 1)]), axis=0)
        if len(at):
            yield pa.record_batch([pa.concat_arrays([label] * len(at)), pa.array(thresholds[at[:, 0]]), pa.array(at[:, 1].astype(np.int32)), pa.array(best[at[:, 0], at[:, 1]])], names=names)

    def ranked(blobs: list[bytes]) -> None:
        nonlocal n
        start, stop = np.divmod(np.frombuffer(b"".join(blobs), kind).astype(np.int64), width)
        rank = n + np.arange(1, len(start) + 1)
        for k in range(width - 1):
            at = np.flatnonzero((start <= k) & (k < stop))
            right = tps[k] + np.arange(1, len(at) + 1)
            tps[k] += len(at)
            r = right / head[1]
            low = np.floor(r * 100).astype(np.int64)
            level = np.where((low + 1) * 0.01 <= r, low + 1, np.where(low * 0.01 <= r, low, low - 1))
            np.maximum.at(best[k], level, right / rank[at])
        n += len(start)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([pairing.codes(batch.column(c)) for c in ("label", "_scored")])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            here = (batch.column("label")[a].as_py(), batch.column("_scored")[a].as_py())
            if here != key:
                yield from ended()
                key, head = here, batch.column("_head")[a].as_py()
                if head is not None:
                    label = batch.column("label").slice(a, 1)
                    n, tps, best = head[0], np.array(head[2:], np.int64), np.zeros((width - 1, 102))
                    a += 1
            if head is None:  # a class without truth
                continue
            held, size = [], 0
            for blob in batch.column("_got").slice(a, b - a):
                held.append(blob.as_py())
                size += len(held[-1])
                if size > 1 << 20:
                    ranked(held)
                    held, size = [], 0
            if held:
                ranked(held)
    yield from ended()


def average_precision_of(boxes: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``average_precision`` of both sides in one frame, whose documents rise within partitions and from one to the next.

    So all that travels of a detection is what it is right for, in one row with those of its score next to it."""
    levels = np.array(sorted(thresholds))
    width, tps = len(levels) + 1, [f"_tp{k}" for k in range(len(levels))]
    number = np.uint8 if width * width <= 256 else np.uint32
    kind = {c: boxes.schema[c].dataType.simpleString() for c in ("label", "score", "doc_id")}
    told = pairing.by_documents(boxes, lambda t, doc: _blobs(t, doc, levels, number), f"label {kind['label']}, _scored long, score {kind['score']}, doc_id {kind['doc_id']}, _got binary, _gt long")
    dealt = told.repartition("label", "_scored")
    some = dealt.mapInArrow(lambda batches: _sums(batches, width, number, ["label", "_scored", "_gt", "_n", *tps]), f"label {kind['label']}, _scored long, _gt long, _n long, " + ", ".join(f"{n} long" for n in tps))
    of = some.groupBy("label", "_scored").agg(*[F.sum(n).alias(n) for n in ("_gt", "_n", *tps)])
    above = Window.partitionBy("label").orderBy(F.desc("_scored")).rowsBetween(Window.unboundedPreceding, -1)
    sum_above = [F.coalesce(F.sum(n).over(above), F.lit(0)) for n in ("_n", *tps)]
    heads = of.select("label", "_scored", F.array(sum_above[0], F.sum("_gt").over(Window.partitionBy("label")), *sum_above[1:]).alias("_head")).where("_head[1] > 0")
    every = dealt.withColumn("_head", F.lit(None).cast("array<long>")).unionByName(heads, allowMissingColumns=True)
    placed = every.repartition("label", "_scored").sortWithinPartitions("label", "_scored", F.col("_head").isNull(), F.desc("score"), "doc_id")
    names = ["label", "threshold", "k", "p"]
    peaks = placed.mapInArrow(lambda batches: _peaks(batches, levels, number, names), f"label {kind['label']}, threshold double, k int, p double")
    # the best precision at a recall or beyond it
    best = peaks.groupBy("threshold", "label").agg(F.collect_list(F.struct("k", "p")).alias("_c"))
    beyond = lambda k: F.aggregate(F.filter("_c", lambda c: c["k"] >= k), F.lit(0.0), lambda a, c: F.greatest(a, c["p"]))
    return best.select("threshold", "label", F.round(F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), beyond), F.lit(0.0), lambda a, x: a + x) / 101, 6).alias("ap"))


def average_precision(gts: DataFrame, preds: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, label, ap) by 101 levels of recall over all pages; classes without truth are left out.

    A detection belongs to the box of its class and page with the highest IoU, taken or not; of those beyond the
    threshold the best-scored one is right. Detections are ranked in buckets of scores, and buckets added up, so
    no task holds a class. Rows have _id, label and a box, predictions a score between 0 and 1.
    """
    return average_precision_of(pairing.together(gts.withColumn("score", F.lit(None).cast("double")), preds, "label", "score", rising=True), thresholds)
