"""Queries on small tables of their own, where they differed from their SQL."""

import re

import duckdb
import pytest

from pagequarry.queries import ORACLE_SQL, QUERIES
from tests.test_queries import normal


def compared(spark, folder, name, **tables):
    """Rows of a query and those of its SQL over tables given as (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found, made = con.execute(ORACLE_SQL[name]), QUERIES[name](spark, str(folder))
    names = [c[0] for c in found.description]
    return normal(made.collect(), made.columns), normal(found.fetchall(), names)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(**texts):
    return {"documents": (DOCUMENTS, [(int(k[1:]), t, "en", "x", len(t)) for k, t in texts.items()])}


@pytest.mark.parametrize("name", ["detection_metric", "localization", "ocr_metric"])
def test_documents_without_a_pair(spark, tmp_path, name):
    """Document 17 has one word, and its prediction is of noise alone."""
    got, want = compared(spark, tmp_path, name, **documents(d17="word", d18="some words here"))
    assert got == want and len(got) == 1


def test_json_adds_words_in_order(spark, tmp_path):
    """Means that end in a half of the last digit: sums of lines, added up, round the other way."""
    texts = {f"d{k}": " ".join(["word"] * n) for k, n in ((1905, 320), (2513, 64), (2886, 1056), (3144, 64), (3544, 64), (3631, 64), (5044, 64))}
    got, want = compared(spark, tmp_path, "export_json", **documents(**texts))
    assert got == want


def test_nearest_in_blocks(spark, monkeypatch):
    """Slices and blocks give what all pairs give; copies, empty vectors and keys without allowed rows too."""
    import random

    from pagequarry.operators import elements

    monkeypatch.setattr(elements, "HELD", 7)
    monkeypatch.setattr(elements, "SLICE_ROWS", 11)
    rng = random.Random(4)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(40)] + [[0.0] * 4]
    rows = [(k, rng.randint(0, 3), rng.choice(vectors)) for k in range(300)]
    allowed = [r for r in rows if r[1] and r[0] % 3 == 0]

    def cosine(x, y):
        dot = lambda a, b: sum(map(float.__mul__, a, b))
        under = dot(x, x) ** 0.5 * dot(y, y) ** 0.5
        return dot(x, y) / under if under else -2.0

    want = {i: max(((cosine(v, w), -j) for j, m, w in allowed if m == k), default=(0, None))[1] for i, k, v in rows}
    schema = "id long, label int, v array<float>"
    found = elements.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(allowed, schema), "label", "v").collect()
    assert {r["id"]: r["near"] for r in found} == {i: None if j is None else -j for i, j in want.items()}


def plan(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds_are_not_rows_of_windows(spark):
    """Detections are ranked once, not once for each threshold."""
    lines = plan(spark, "coco_map").splitlines()
    ranks = [k for k, x in enumerate(lines) if "Window" in x and "score" in x]
    assert ranks and not any("0.55" in x and "Generate explode" in x for x in lines[ranks[0] :])


@pytest.mark.parametrize("name", ["export_text", "export_markdown", "export_asciidoc", "export_html_document", "reading_segments"])
def test_pages_are_ordered_in_batches(spark, name):
    text = plan(spark, name)
    assert "MapInArrow" in text and "FlatMapGroups" not in text


def test_hocr_makes_a_word_once(spark):
    assert plan(spark, "export_hocr_classes").count("ocrx_word") <= 2


@pytest.mark.parametrize("name", ["export_asciidoc", "export_html_document", "export_markdown", "export_text"])
def test_exports_hold_every_page(spark, tmp_path, name):
    """Pages whose second column is short, long, or all but full, and a page after them."""
    texts = {f"d{n}": " ".join(f"w{k}" for k in range(n)) for n in (7, 405, 531, 541, 799, 1250)}
    got, want = compared(spark, tmp_path, name, **documents(**texts))
    assert got == want
    found = {doc: set(re.findall(r"w[0-9]+", text)) for doc, text in got}
    furniture = lambda k: name == "export_text" and k // 10 % 40 in (0, 39)
    assert found == {n: {f"w{k}" for k in range(n) if not furniture(k)} for n in (7, 405, 531, 541, 799, 1250) if any(not furniture(k) for k in range(n))}


@pytest.mark.parametrize("name", ["coco_map", "localization", "detection_metric", "ocr_metric"])
def test_boxes_are_not_dealt(spark, name):
    """Texts are dealt, the boxes made of them neither dealt nor joined."""
    text = plan(spark, name)
    dealt = [x for x in text.splitlines() if "Repartition" in x]
    assert "Join" not in text and dealt and not any("x0" in x or "_id#" in x.replace("doc_id#", "") for x in dealt)


def test_both_sides(spark):
    """One frame has the words and the predictions made of them."""
    from pagequarry.plans import fixtures

    w = fixtures.words(spark, "/root/testdata/sf0.001")
    names = ["side", "doc_id", "page_idx", "_id", "x0", "y0", "x1", "y1", "value", "score"]
    want = w.selectExpr("0 as side", "p * 2 as _id", "confidence as score", "*").select(names).unionByName(fixtures.predictions(w).selectExpr("1 as side", "p * 2 + fp as _id", "*").select(names))
    got = fixtures.both_sides(w, "value", "score").select(names)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
