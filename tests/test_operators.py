"""Literal cases of operators."""

import itertools
import json
import random

import numpy as np

from pyspark.sql import functions as F

from pagequarry.functions import geometry as G
from pagequarry.functions import text as T
from pagequarry.operators import assemble, export, metrics, order, selection
from pagequarry.sources import annotations


def words(spark, boxes):
    return spark.createDataFrame([(0, 0, i, f"w{i}", *map(float, b), 0.5) for i, b in enumerate(boxes)], "doc_id long, page_idx int, p long, value string, x0 double, y0 double, x1 double, y1 double, confidence double")


def test_lines_break_at_wide_gaps(spark):
    step = assemble.PARAGRAPH_BREAK
    left = [0.03 + 0.04 * k for k in range(4)] + [0.03 + 0.04 * 4 + step]
    found = assemble.lines_of(words(spark, [(x, 0.31, x + 0.035, 0.33) for x in left])).orderBy("row", "sub")
    assert [r.text for r in found.collect()] == ["w0 w1 w2 w3", "w4"]


def boxes(spark, n, seed, spread=0.5):
    rng = random.Random(seed)
    made = [(x, y, x + rng.uniform(0.05, 0.3), y + rng.uniform(0.05, 0.3)) for x, y in ((rng.uniform(0, spread), rng.uniform(0, spread)) for _ in range(n))]
    rows = [(0, 0, i, *b, rng.random(), f"v{i % 3}", i % 2) for i, b in enumerate(made)]
    return rows, spark.createDataFrame(rows, "doc_id long, page_idx int, _id long, x0 double, y0 double, x1 double, y1 double, score double, value string, label int")


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def test_heaviest_matching():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 5), (5, 3), (6, 6)):
        w = rng.random((n, m)) * (rng.random((n, m)) > 0.4)
        pairs = metrics.heaviest(w)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        tall = w if n <= m else w.T
        best = max(sum(tall[i, p[i]] for i in range(len(tall))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert abs(sum(w[a, b] for a, b in pairs) - best) < 1e-9


def test_metrics_on_boxes_that_meet_several(spark):
    (a, gts), (b, preds) = boxes(spark, 6, 1, 0.3), boxes(spark, 5, 2, 0.3)
    w = [[iou(x[3:7], y[3:7]) for y in b] for x in a]
    assert sum(v > 0 for row in w for v in row) > 10
    best = max(itertools.permutations(range(6), 5), key=lambda p: sum(w[i][j] for j, i in enumerate(p)))
    hits = [(i, j) for j, i in enumerate(best) if w[i][j] >= 0.2]
    r = metrics.localization(gts, preds, 0.2).first()
    assert (r.n_gt, r.n_pred, r.recall_boxes) == (6, 5, round(len(hits) / 6, 6)) and r.recall_boxes <= 1
    assert r.mean_iou == round(sum(max(row[j] for row in w) for j in range(5)) / 5, 2)
    assert metrics.detection(gts, preds, 0.2).first().precision_classes == round(sum(a[i][9] == b[j][9] for i, j in hits) / 5, 6)
    assert metrics.recognition(gts, preds, 0.2).first().precision_raw == round(sum(a[i][8] == b[j][8] for i, j in hits) / 5, 6)
    only = metrics.localization(gts.limit(0), preds).first()
    assert (only.n_gt, only.recall_boxes, only.precision_boxes) == (0, None, 0.0)


def test_average_precision(spark):
    (a, gts), (b, preds) = boxes(spark, 30, 5), boxes(spark, 40, 6)
    for r in metrics.average_precision(gts, preds, (0.2, 0.5)).collect():
        truth, taken, tp, curve = [x for x in a if x[9] == r.label], set(), 0, []
        for n, d in enumerate(sorted((x for x in b if x[9] == r.label), key=lambda x: -x[7]), 1):
            over, k = max((iou(t[3:7], d[3:7]), -t[2]) for t in truth)
            if over >= r.threshold and k not in taken:
                taken.add(k)
                tp += 1
            curve.append((tp / len(truth), tp / n))
        assert r.ap == round(sum(max((p for c, p in curve if c >= k * 0.01), default=0) for k in range(101)) / 101, 6)


def test_same_text(spark):
    df = spark.createDataFrame([("\u20ac10", "eur10"), ("Caf\u00e9", "CAFE"), ("a", "a"), ("a", "b")], "a string, b string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in T.same_text(F.col("a"), F.col("b")).items()]).collect()]
    assert got == [(False, False, False, True), (False, False, False, True), (True, True, True, True), (False, False, False, False)]
    t = spark.createDataFrame([("caf\u00e9 \u2603\u20ac",)], "t string").select(T.translate_vocabulary(F.col("t"), "acefEUR")).first()[0]
    assert t == "cafe\u25a0EUR"


def test_reading_order_roles_columns_and_captions():
    two = np.array([(0.1, 0.1 + 0.1 * k, 0.45, 0.18 + 0.1 * k) for k in range(4)] + [(0.55, 0.1 + 0.1 * k, 0.9, 0.18 + 0.1 * k) for k in range(4)])
    mixed = [5, 0, 7, 3, 1, 4, 2, 6]
    assert [mixed[k] for k in order.in_order(two[mixed])] == list(range(8))
    rows = np.array([(0.5, 0.1, 0.6, 0.2), (0.1, 0.11, 0.2, 0.21), (0.1, 0.3, 0.2, 0.4)])
    assert order.in_order(rows) == [1, 0, 2] and order.in_order(rows[:0]) == []
    boxes_ = np.array([(0.1, 0.9, 0.9, 0.95), (0.1, 0.5, 0.9, 0.55), (0.1, 0.2, 0.9, 0.48), (0.1, 0.02, 0.9, 0.05), (0.1, 0.1, 0.9, 0.15)])
    assert order.by_role(boxes_, ["footer", "caption", "float", "header", "body"]) == [3, 4, 2, 1, 0]


def test_right_to_left_order(spark):
    df = words(spark, [(0.1, 0.1, 0.2, 0.2), (0.5, 0.1, 0.6, 0.2), (0.1, 0.3, 0.6, 0.4)])
    assert [r.value for r in order.ordered(df, "rtl").orderBy("ord").collect()] == ["w1", "w0", "w2"]


def test_exports_of_lists_tables_and_furniture(spark):
    rows = [(0, 0, 0, "Page-header", ["top"], None), (0, 0, 1, "Title", ["a", "*b*"], None), (0, 0, 2, "List-item", ["one", "more"], None), (0, 0, 3, "List-item", ["- two"], None), (0, 0, 4, "Text", ["1. x", " "], None), (0, 0, 5, "Table", [], [["h", "i|"], ["", "c"]])]
    items = spark.createDataFrame(rows, "doc_id long, page_idx int, ord int, label string, lines array<string>, grid array<array<string>>")
    got = {n: export.page_exports(items, export.format_of(n), furniture=False).first().export for n in (" MD", "html", "txt")}
    assert got[" MD"] == "# a \\*b\\*\n\n- one more\n- \\- two\n\n\\1. x\n\n| h | i\\| |\n| --- | --- |\n|  | c |"
    assert got["html"] == "<h1>a *b*</h1>\n<ul>\n<li>one more</li>\n<li>- two</li>\n</ul>\n<p>1. x</p>\n<table>\n<tr><th>h</th><th>i|</th></tr>\n<tr><td></td><td>c</td></tr>\n</table>"
    assert got["txt"].startswith("a\n*b*\n\none more\n- two\n\n1. x")
    assert export.page_exports(items.where("ord = 0"), export.format_of("text")).first().export == "top"


def test_iou_of_empty_boxes_is_zero(spark):
    df = spark.createDataFrame([(0.0,) * 8], [f"{s}{c}" for s in "ab" for c in ("x0", "y0", "x1", "y1")])
    assert df.select(G.iou("a", "b")).first()[0] == 0


def test_nms(spark):
    rows, df = boxes(spark, 25, 9, 0.4)
    for thresh in (0.05, 0.3, 1.0):
        kept = []
        for r in sorted(rows, key=lambda r: -r[7]):
            if all(iou(r[3:7], k[3:7]) <= thresh for k in kept):
                kept.append(r)
        assert sorted(r.box_id for r in selection.nms(df.withColumnRenamed("_id", "box_id"), thresh).collect()) == sorted(r[2] for r in kept)
    assert selection.nms(df.withColumnRenamed("_id", "box_id").limit(0)).count() == 0


def test_order_points_and_page_edge(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.5, 0.4)], "x0 double, y0 double, x1 double, y1 double")
    o = df.select(G.order_points(G.bbox_to_polygon(*map(F.col, df.columns))).alias("o")).first().o
    assert [(p.x, p.y) for p in o] == [(0.1, 0.2), (0.5, 0.2), (0.5, 0.4), (0.1, 0.4)]


def test_ctc_and_direction(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 2, 2],)], "p array<int>")
    assert df.select(T.ctc_path(F.col("p"), "ab", 0)).first()[0] == "aab"
    d = spark.createDataFrame([("שלום",), ("abc",), ("",)], "t string").select(T.direction(F.col("t")).alias("d"))
    assert [r.d for r in d.collect()] == ["rtl", "ltr", "ltr"]


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a.png": {"img_dimensions": [1, 2], "img_hash": "x", "polygons": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}}))
    r = annotations.detection_labels(spark, str(tmp_path / "d.json")).collect()
    assert (r[0].image, r[0].box_idx, len(r[0].poly)) == ("a.png", 0, 4)
    (tmp_path / "c.txt").write_text("0,0,1,0,1,1,0,1,a,b\nbroken\n")
    assert [(x.text, x.poly[1]) for x in annotations.corner_csv(spark, str(tmp_path / "c.txt")).collect()] == [("a,b", [1.0, 0.0])]
    (tmp_path / "f.json").write_text(json.dumps({"form": [{"id": 1, "label": "q", "box": [0], "words": [{"box": [0, 0, 1, 1], "text": "x"}, {"box": [0], "text": ""}]}]}))
    assert [x.text for x in annotations.form_json(spark, str(tmp_path / "f.json")).collect()] == ["x"]


def joined(a, b, ratio):
    """Every overlap tried in turn."""
    if min(len(a), len(b)) <= 1:
        return a + b
    left, right = a[:-1], b[1:]
    expected = round(len(b) * ratio) - 2
    ways = []
    for k in range(1, min(len(left), len(right)) + 1):
        wrong = sum(x != y for x, y in zip(left[len(left) - k :], right[:k]))
        ways.append((wrong > 0, wrong + abs(k - expected), k))
    differs, _, k = min(ways)
    if differs and expected < 1:
        return a + b if expected < 0 else left + right
    return left + right[k:]


def test_join_overlapping(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    cases = [(word(rng.randint(0, 7)), word(rng.randint(0, 7)), rng.choice((0.25, 0.5, 0.75))) for _ in range(120)]
    for ratio in (0.25, 0.5, 0.75):
        df = spark.createDataFrame([(a, b) for a, b, r in cases if r == ratio], "a string, b string")
        for r in df.withColumn("j", T.join_overlapping(F.col("a"), F.col("b"), ratio)).collect():
            assert r.j == joined(r.a, r.b, ratio), (r.a, r.b, ratio)
    three = spark.createDataFrame([(["readingZ", "Qingroo", "groomsX"],)], "p array<string>").select(T.join_readings(F.col("p"), 0.5, 0.7)).first()[0]
    assert three == joined(joined("readingZ", "Qingroo", 0.5), "groomsX", 0.7)
