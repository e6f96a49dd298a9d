"""Kernels against plain loops, images as rows, and hOCR read back."""

import xml.etree.ElementTree as ET

import numpy as np
import pytest

from pagequarry.functions import pixels as P
from pagequarry.operators import hocr, images


def noise(*shape, seed=0):
    return np.random.default_rng(seed).integers(0, 256, shape, dtype=np.uint8)


def test_morphology():
    x = (np.random.default_rng(1).random((9, 12)) > 0.4).astype(np.int64)
    for y in range(9):
        for z in range(12):
            near = x[max(0, y - 1) : y + 2, max(0, z - 1) : z + 2]
            assert P.dilate(x, 3)[y, z] == near.max() and P.erode(x, 3)[y, z] == near.min()


def test_components():
    for seed in range(20):
        x = np.random.default_rng(seed).random((15, 17)) > 0.55
        want, n = np.zeros(x.shape, int), 0
        for at in zip(*np.nonzero(x)):
            if want[at]:
                continue
            n += 1
            todo = [at]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 15 and 0 <= b < 17 and x[a, b] and not want[a, b]:
                    want[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (P.components(x) == want).all()
    assert P.components(np.zeros((3, 3), bool)).max() == 0


def test_map_boxes():
    prob = np.zeros((40, 60))
    prob[10:16, 20:40] = 0.9
    prob[30, 30] = 0.9
    found = P.map_boxes(prob, unclip=1.5)
    grow = 6 * 20 * 1.5 / 52
    assert len(found) == 1 and np.allclose(found[0], [(20 - grow) / 60, (10 - grow) / 40, (40 + grow) / 60, (16 + grow) / 40, 0.9])
    assert P.map_boxes(prob, least_score=0.95) == [] and P.map_boxes(prob * 0) == []
    assert P.box_score(prob, np.array([(20, 10), (39, 10), (39, 15), (20, 15)]), straight=False) == pytest.approx(0.9)


def test_rotations_resizes_and_borders():
    image = noise(12, 12, 3)
    assert (P.rotate(image, 0) == image).all()
    quarter = P.rotate(image, 90)
    assert all((quarter[y, x] == image[x, 12 - y]).all() for y in range(1, 12) for x in range(12))
    wide = P.rotate(noise(10, 30, 3), 30, expand=True)
    assert abs(wide.shape[1] / wide.shape[0] - 3) < 0.1 and P.rotate(noise(10, 30, 3), 30, True, True).shape == (10, 30, 3)
    assert (P.resize(image, 12, 12) == image).all() and (P.resize(np.full((5, 7, 3), 9, np.uint8), 11, 3) == 9).all()
    framed = P.pad(image + (image == 0), (2, 3), (1, 4))
    assert (P.without_border(framed) == image + (image == 0)).all() and P.without_border(framed * 0).shape == framed.shape
    out, (left, top) = P.fit(np.full((10, 20, 3), 5, np.uint8), 20, 20)
    assert (left, top) == (0, 5) and (out[5:15] == 5).all() and out[:5].max() == 0
    assert np.allclose(P.fit_boxes(np.array([[0, 0, 1, 1.0]]), (10, 20), (10, 20), (20, 20), (left, top)), [[0, 0.25, 1, 0.75]])


def test_crops_and_masks():
    image = noise(10, 20, 3)
    (part,) = P.crops(image, np.array([[0.1, 0.2, 0.5, 0.6]]))
    assert (part == image[2:7, 2:11]).all()
    assert (P.crops(image, np.array([[1, 2, 3, 4]]))[0] == image[2:4, 1:3]).all() and P.crops(image, np.zeros((0, 4))) == []
    with pytest.raises(ValueError):
        P.crops(image, np.zeros((1, 5)))
    masked = P.mask(image, np.array([[0.1, 0.2, 0.5, 0.6]]), 7)
    assert (masked[2:7, 2:11] == 7).all() and (masked[7:] == image[7:]).all() and P.mask(image, np.zeros((0, 4))) is image
    assert (P.upright(np.rot90(image), 1) == image).all() and (P.upright(image, 0) == image).all()
    straight = P.turned_crop(image, np.array([(0.1, 0.2), (0.5, 0.2), (0.5, 0.6), (0.1, 0.6)]))
    assert straight.shape == (4, 8, 3) and (straight[0, 0] == image[2, 2]).all()
    assert P.turned_crop(image, np.zeros((4, 2))).size == 0


def test_augmentation_is_keyed():
    image = noise(6, 5, 3)
    for fn in (P.inverted, P.noisy, P.shuffled_channels):
        assert (fn(image, 3) == fn(image, 3)).all() and fn(image, 3).dtype == np.uint8
    assert any((P.noisy(image, 3, std=0.2) != P.noisy(image, 4, std=0.2)).ravel())
    assert (np.sort(P.shuffled_channels(image, 1), 2) == np.sort(image, 2)).all()
    assert (P.mirrored(P.mirrored(image)) == image).all()
    assert np.allclose(P.blurred(np.full((5, 6, 3), 0.5), 1.2), 0.5) and P.blurred(image / 255, 2).std() < (image / 255).std()
    planes = P.to_planes(image)
    assert planes.shape == (3, 6, 5) and np.allclose(P.normalized(planes, (0.5,) * 3, (0.5,) * 3), planes * 2 - 1)


def rows(spark, *given):
    return spark.createDataFrame([(n, *(i.shape if i is not None else (None,) * 3), bytearray(i.tobytes()) if i is not None else None) for n, i in given], images.SCHEMA)


def test_images_as_rows(spark):
    a, b = noise(10, 20, 3), noise(4, 4, 1, seed=1)
    df = rows(spark, ("a", a), ("b", b), ("none", None))
    boxes = spark.createDataFrame([("a", 1, 0.1, 0.2, 0.5, 0.6), ("a", 0, 0.0, 0.0, 1.0, 1.0), ("none", 0, 0.0, 0.0, 1.0, 1.0), ("other", 0, 0.0, 0.0, 1.0, 1.0)], "image string, idx long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.image, r.idx): images.pixels_of(r) for r in images.crop_images(df, boxes).collect()}
    assert set(got) == {("a", 0), ("a", 1)} and (got["a", 1] == a[2:7, 2:11]).all() and (got["a", 0] == a).all()
    masked = {r.image: images.pixels_of(r) for r in images.mask_images(df, boxes, 0).collect()}
    assert masked["a"].max() == 0 and (masked["b"] == b).all() and masked["none"] is None
    assert {r.image: (r.height, r.width) for r in images.fit_images(df, 8, 8).collect()} == {"a": (8, 8), "b": (8, 8), "none": (None, None)}
    assert images.fit_images(df.limit(0), 8, 8).count() == 0
    prob = np.zeros((20, 20))
    prob[5:12, 5:12] = 0.8
    maps = spark.createDataFrame([("m", 20, 20, prob.ravel().tolist()), ("n", 1, 1, None)], "image string, height int, width int, prob array<double>")
    assert [(r.image, round(r.score, 6)) for r in images.map_boxes(maps).collect()] == [("m", 0.8)]


def test_read_images(spark, tmp_path):
    # a bitmap of two pixels, red then blue, and a file that is no image
    head = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + bytes([0, 0, 255, 255, 0, 0, 0, 0]))
    (tmp_path / "b.bmp").write_bytes(b"none")
    found = {r.image[-5:]: images.pixels_of(r) for r in images.read(spark, str(tmp_path)).collect()}
    assert found["a.bmp"].tolist() == [[[255, 0, 0], [0, 0, 255]]] and found["b.bmp"] is None


def test_hocr_read_back(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 0, "a<&", 0.905, 0.1, 0.1, 0.2, 0.2), (1, 0, 0, 0, 1, None, 0.5, 0.3, 0.1, 0.4, 0.2), (1, 0, 2, 5, 0, 'q"', 1.0, 0.5, 0.5, 0.6, 0.6)], "doc_id long, page_idx int, segment int, ord int, place int, value string, confidence double, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(1, 0, 1, 0, 1, "c1", 0.5, 0.3, 0.3, 0.4, 0.35), (1, 0, 1, 0, 0, "c0", 0.5, 0.1, 0.3, 0.2, 0.4), (1, 0, 1, 2, 0, "", 0.5, 0.1, 0.45, 0.2, 0.5)], "doc_id long, page_idx int, segment int, row_start int, col_start int, value string, confidence double, x0 double, y0 double, x1 double, y1 double")
    text = hocr.page_hocr(words, 1000, 800, tables=cells).first().export
    root = ET.fromstring(text.encode())
    named = {e.get("id"): e for e in root.iter() if e.get("id")}
    assert [e for e in named if e.startswith(("block", "table_1"))] == ["block_1", "table_1", "table_1_row_1", "table_1_cell_1_1", "table_1_cell_1_2", "table_1_row_3", "table_1_cell_3_1", "block_2"]
    assert [named[f"word_{k}"].text for k in (1, 2, 3)] == ["a<&", None, 'q"'] and named["table_1_cell_1_1"].text == "c0"
    assert named["word_1"].get("title") == "bbox 80 100 160 200; x_wconf 90" and named["line_1"].get("title").startswith("bbox 80 100 320 200; baseline")
    assert named["table_1"].get("title") == "bbox 80 300 320 500" and named["page_1"].get("title") == "image; bbox 0 0 800 1000; ppageno 0"
    kie = spark.createDataFrame([(1, 0, 'k"', 0, "v", 0.5, 0.1, 0.1, 0.2, 0.2)], "doc_id long, page_idx int, class string, ord int, value string, confidence double, x0 double, y0 double, x1 double, y1 double")
    ids = [e.get("id") for e in ET.fromstring(hocr.class_hocr(kie, 1000, 800).first().export.encode()).iter() if e.get("id")]
    assert ids == ["page_1", 'k"_prediction_1', 'k"_par_1', 'k"_line_1', 'k"_word_1']
