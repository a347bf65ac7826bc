"""Image files, settings, prepared masks, contours, placements and border repairs on small inputs made by hand."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.operators import topology, validate
from cartolith.plans import edits, extraction
from cartolith.sources import geojson, images


def pixels(spark, image):
    rows = [(x, y, *map(int, image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, "x int, y int, r int, g int, b int")


def test_image_files(spark, tmp_path):
    gray = np.zeros((4, 6, 1), np.uint8)
    gray[1:3, 2:5], gray[0, 0] = 255, 100
    rgba = np.random.default_rng(0).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    for name, image in (("gray", gray), ("color", rgba)):
        (tmp_path / f"{name}.png").write_bytes(images.encode_png(image))
    mask = images.read_binary_mask(spark, str(tmp_path / "gray.png"), size=(6, 4))
    assert tuple(images.mask_report(mask).first()) == (24, 6, 18, 1)
    with pytest.raises(Exception, match="not 5x4"):
        images.read_binary_mask(spark, str(tmp_path / "gray.png"), size=(5, 4)).count()
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in images.read_pixels(spark, str(tmp_path / "color.png")).collect()}
    assert got == {(x, y): tuple(map(int, rgba[y, x])) for x in range(5) for y in range(3)}
    assert {r.a for r in images.read_pixels(spark, str(tmp_path / "gray.png")).collect()} == {255}
    hashes = {r.path.rpartition("/")[2]: r.sha256 for r in images.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.png")}


def test_settings_ids_and_datasets(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"fill": {"most": 5}, "name": "a"}))
    assert geojson.read_config(spark, str(tmp_path / "c.json"), {"fill": {"most": 12, "mode": "safe"}, "land": 128}) == {"fill": {"most": 5, "mode": "safe"}, "name": "a", "land": 128}
    point = lambda i, more: {"type": "Feature", **more, "properties": {"id": i}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [point("own", {}), point("inner", {"id": "outer"})]}))
    assert [r.id for r in geojson.read_features(spark, str(tmp_path / "p.geojson")).orderBy("ord").collect()] == ["own", "outer"]
    paths = {"a": str(tmp_path / "p.geojson"), "raw": str(tmp_path / "missing.geojson")}
    loaded = geojson.base_datasets(spark, paths, ("raw",), False)
    assert loaded["a"].count() == 2 and loaded["raw"].count() == 0
    ids = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    geojson.write_ids(ids, str(tmp_path / "ids"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["a", "b", "c"]


def test_one_unclaimed_feature(spark):
    cells = spark.createDataFrame([(x, y) for y in range(2, 8) for x in range(3, 9)], "x int, y int")
    (row,) = extraction.unclaimed_product(cells).collect()
    assert (row.rgb, row.polygon_count, row.hole_count) == ([128, 128, 128], 1, 0)
    assert extraction.unclaimed_product(cells.limit(0)).count() == 0


def test_annotated_and_drawn_masks(spark):
    image = np.full((12, 16, 3), 255, np.uint8)
    image[2:10, 2:14] = (190, 120, 50)
    image[2:10, 7] = (20, 100, 100)  # a boundary drawn in teal
    image[5, 4] = (0, 0, 0)  # a hole, which is filled
    got = extraction.annotated_mask(pixels(spark, image), (190, 120, 50), 10, 5).collect()
    assert {(r.x, r.y) for r in got} == {(x, y) for x in range(2, 14) for y in range(2, 10) if x != 7}
    assert len({r.component for r in got}) == 2
    drawn = np.zeros((14, 20, 3), np.uint8)
    drawn[:, :] = (10, 10, 200)
    drawn[2:12, 2:18] = (220, 200, 100)
    drawn[2:12, 9] = (100, 10, 10)
    faces = extraction.drawn_mask(pixels(spark, drawn), [1.0, 2.0, 3.0, 2.0, 1.0], 20.0, 60, 1, 4, 1, 4).collect()
    assert {r.face for r in faces} == {1, 2} and {(r.face, r.x < 9) for r in faces} == {(1, True), (2, False)}


def test_border_preview_counts_sealed_leaks(spark):
    rows = [("a", x, y, -1 if x == y else 0) for x in range(5) for y in range(5)] + [("b", x, 0, 0) for x in range(3)]
    got = extraction.border_preview(spark.createDataFrame(rows, "owner string, x int, y int, value int")).collect()
    assert {r.owner: r.n for r in got} == {"a": 9}  # four diagonal steps are closed


def test_contours_keep_small_parts_as_boxes(spark):
    cells = spark.createDataFrame([(x, y, 1) for x in range(8) for y in range(6)] + [(20, 20, 2)], "x int, y int, label int")
    got = {r.label: r["shape"] for r in topology.contours(cells, 0.5).collect()}
    assert len(got[1]) == 1 and len(got[1][0][0]) == 5 and {(p["x"], p["y"]) for p in got[2][0][0]} == {(20, 20), (21, 20), (21, 21), (20, 21)}


def test_land_under_a_click(spark):
    country = spark.createDataFrame([(x, 0) for x in range(6)] + [(9, 0)], "x int, y int")
    land = spark.createDataFrame([(x, 0) for x in range(4)], "x int, y int")
    at = lambda x: sorted(r.x for r in edits.region_territory_at(country, x, 0, land).collect())
    assert at(1) == [0, 1, 2, 3] and at(9) == [9]


def test_regions_are_placed_on_their_territory(spark):
    cells = spark.createDataFrame([("a" if x < 3 else "b", x, y) for x in range(6) for y in range(4)], "owner string, x int, y int")
    territory = spark.createDataFrame([(x + 30, y + 10) for x in range(12) for y in range(8)], "x int, y int")
    moved, fit = extraction.place_regions(cells, territory, 1.5, 2.5, 0.25, 2)
    assert fit.first().scale == 2 and fit.first().iou == 1
    assert {r.owner: r["count"] for r in moved.groupBy("owner").count().collect()} == {"a": 48, "b": 48}
    row = extraction.region_report(moved, territory).first()
    assert (row.iou, row.overlap_area) == (1, 0)


def test_borders_are_closed_and_run_to_the_coast(spark):
    square = lambda x0, x1: [[[{"x": float(a), "y": float(b)} for a, b in ((x0, 0), (x1, 0), (x1, 4), (x0, 4), (x0, 0))]]]
    made = spark.createDataFrame([("p", square(0, 4)), ("q", square(7, 9))], f"id string, shape {topology.SHAPE}")
    row = extraction.close_border(made, "p", "q").first()
    assert row.length == 3 and {p["x"] for p in row.points} == {4, 7}
    line = spark.createDataFrame([([(2.0, 1.0), (2.0, 3.0)],)], f"points {g.RING}")
    coast = spark.createDataFrame([("t", square(-9, 30))], f"id string, shape {topology.SHAPE}")
    assert extraction.extend_to_coast(line, coast).first().length == 1
    with pytest.raises(ValueError):
        extraction.extend_to_coast(line, coast, 0.5)


def test_a_drawing_may_fail_for_seven_reasons(spark):
    good = (1.0, 1.0, 0, 0, 0, 1.0, 0)
    bad = (0.1, 0.1, 9, 9, 1, 0.9, 1)
    rows = spark.createDataFrame([good, bad, *((*good[:i], bad[i], *good[i + 1 :]) for i in range(7))], "inside_ratio double, contour_iou double, overseas_area long, wrong_country_area long, labels_outside long, area_ratio double, missing_pairs long")
    got = [r.failures for r in validate.linework_gate(rows, 0.5, 0.5, 1.0, 1.0).collect()]
    assert got[0] == [] and len(got[1]) == 7 and [f for (f,) in got[2:]] == got[1]
    with pytest.raises(Exception, match="required borders are missing"):
        validate.enforce(validate.linework_gate(rows.where(F.col("missing_pairs") > 0), 0.5, 0.5, 1.0, 1.0)).count()
