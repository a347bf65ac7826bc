"""Features, shapes, files and edits on small tables made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.operators import features as ft
from cartolith.operators import fits, overlay, ranking, shapes, topology, validate
from cartolith.plans import edits, extraction
from cartolith.session import new_folder
from cartolith.sources import geojson, images
from cartolith.streaming import edits as log_edits


def square(x0, y0, x1, y1):
    return [[[{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]]


def test_boxes_map_onto_each_other(spark):
    c = g.alignment(F.array(*map(F.lit, (10.0, 20.0, 110.0, 220.0))), F.array(*map(F.lit, (500.0, 300.0, 700.0, 800.0))))
    row = spark.range(1).select(g.to_world(F.lit(10.0), F.lit(20.0), c).alias("a"), g.to_world(F.lit(110.0), F.lit(220.0), c).alias("b")).first()
    assert tuple(row.a) == (500, 300) and tuple(row.b) == (700, 800)


def test_strokes_snap_to_the_grid():
    assert shapes.grid_line(np.array([(0, 0), (3, 3), (6, 3)])).tolist() == [[0, 0], [3, 3], [6, 3]]
    assert shapes.grid_line(np.array([(0.5, 0.4)])).tolist() == [[0.5, 0.4]]
    assert shapes.grid_line(np.array([(0.5, -0.5), (2, 0)])).tolist() == [[1, 0], [2, 0]]


def test_points_and_outlines(spark):
    df = spark.createDataFrame([("a", square(0, 0, 4, 4))], f"id string, shape {topology.SHAPE}")
    got = df.select(g.in_multipolygon(F.lit(4.0), F.lit(2.0), F.col("shape")).alias("edge"), g.clamped_inside(F.lit(9.0), F.lit(2.0), F.col("shape")).alias("p"), g.ring_counts(F.col("shape")).alias("c")).first()
    assert got.edge and tuple(got.p) == (4, 2) and (got.c.rings, got.c.vertices, got.c.open) == (1, 5, 0)
    assert shapes.inner_points(df).first().clearance == pytest.approx(2, abs=0.05)
    assert shapes.rasterized(df).count() == 16
    gap, p, q = shapes.shortest_link(np.array([(0, 0), (1, 0), (1, 1), (0, 0)], float), np.array([(3, 0), (5, 0), (5, 2), (3, 0)], float))
    assert gap == 2 and p.tolist() == [1, 0] and q.tolist() == [3, 0]
    with pytest.raises(ValueError):
        shapes.coast_link(np.array([0.0, 0.0]), np.array([(20, 0), (30, 0), (20, 0)], float))


def test_uniform_fit(spark):
    local = spark.createDataFrame([(x, y) for x in range(4) for y in range(3)], "x int, y int")
    target = spark.createDataFrame([(x + 10, y + 20) for x in range(8) for y in range(6)], "x int, y int")
    fit = fits.best_fit(local, target, 1.0, 2.5, 0.25).first()
    assert (fit.scale, fit.ox, fit.oy, fit.iou) == (2, 10, 20, 1)


def test_images_round_trip(spark):
    rng = np.random.default_rng(1)
    for n in (1, 3, 4):
        image = rng.integers(0, 256, (5, 7, n))
        assert (images.decode(images.encode_png(image)) == image).all()
    assert images.decode(b"P5\n# note\n2 1\n255\n\x00\xff").ravel().tolist() == [0, 255]


def test_geojson(spark):
    folder = new_folder(spark, "geo")
    df = spark.createDataFrame([("b", square(0, 0, 1, 1)), ("a", square(0, 0, 2, 2) + square(5, 5, 6, 6))], f"id string, shape {topology.SHAPE}")
    geojson.write_collection(geojson.feature_lines(df, geojson.geometry_json("Shape", F.col("shape")), []), f"{folder}/f.geojson")
    back = geojson.shapes(geojson.read_features(spark, f"{folder}/f.geojson"))
    assert {(r.id, r.type, r["shape"] == [s for s in df.collect() if s.id == r.id][0]["shape"]) for r in back.collect()} == {("b", "Polygon", True), ("a", "MultiPolygon", True)}
    assert geojson.read_features(spark, f"{folder}/none.geojson", missing_ok=True).count() == 0
    spark.createDataFrame([('{"type": "Other"}',)], "v string").write.text(f"{folder}/bad")
    with pytest.raises(Exception, match="FeatureCollection"):
        geojson.read_features(spark, f"{folder}/bad").count()
    assert geojson.write_state({"borders": df}, folder, {"borders": "borders-clip"}) == ["borders", "borders-clip"]
    assert geojson.read_state(spark, folder, {"borders": df.schema, "gone": df.schema})["gone"].count() == 0


def test_integrity_checks(spark):
    palette = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "r int, g int, b int")
    with pytest.raises(Exception, match="no id for colour 4,5,6"):
        ft.ids_of_colors(palette, spark.createDataFrame([("1,2,3", "a")], "rgb string, id string")).count()
    with pytest.raises(Exception, match="several colours"):
        ft.ids_of_colors(palette, spark.createDataFrame([("1,2,3", "a"), ("4,5,6", "a")], "rgb string, id string")).count()
    parts = spark.createDataFrame([("p", square(0, 0, 4, 4)), ("q", square(2, 2, 6, 6))], f"id string, shape {topology.SHAPE}")
    anchor = lambda x: spark.createDataFrame([("k", x, x)], "key string, x double, y double")
    assert overlay.exactly_one(anchor(1.0), parts, "key").first().id == "p"
    with pytest.raises(Exception, match="exactly one"):
        overlay.exactly_one(anchor(3.0), parts, "key").count()
    report = spark.createDataFrame([(0.2, 0.9)], "iou double, boundary_f double")
    with pytest.raises(Exception, match="contour IoU"):
        validate.enforce(validate.alignment_gate(report, 0.5, 0.5)).count()
    labels = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert {tuple(r) for r in validate.one_label_each(spark.createDataFrame([("a",), ("b",)], "id string"), labels).collect()} == {("a", 2), ("b", 0), ("z", 1)}


def test_suffixes_skip_what_is_taken(spark):
    rows = spark.createDataFrame(list(enumerate(["r", "r", "r-2", "r", "s"])), "k int, id string")
    got = {r.k: r.id for r in ranking.unique_ids(rows, "id", "k").collect()}
    assert len(set(got.values())) == 5 and got[0] == "r" and got[2] == "r-2" and got[4] == "s"


def small_map(spark):
    countries = [("country-001", x, y) for x in range(4) for y in range(4)] + [("country-002", x, y) for x in range(4, 8) for y in range(4)]
    regions = [(f"{o}-region-0{1 if y < 2 else 2}", x, y) for o, x, y in countries]
    rows = [("country-001", "One", 0), ("country-002", "Two", 1)]
    region_rows = [(f"country-00{c}-region-0{k}", f"R{k}", f"country-00{c}", k, k == 1) for c in (1, 2) for k in (1, 2)]
    cells = "owner string, x int, y int"
    return edits.Map(spark.createDataFrame(countries, cells), spark.createDataFrame(rows, "id string, name string, slot int"), spark.createDataFrame(regions, cells), spark.createDataFrame(region_rows, "id string, name string, country_id string, number int, is_capital boolean"))


def areas(df):
    return {r.owner: r.area for r in overlay.areas(df).collect()}


def test_edits_keep_the_map_whole(spark):
    m = small_map(spark)
    land = m.countries.select("x", "y")
    brush = spark.createDataFrame([(x, 0) for x in range(2, 12)], "x int, y int")
    assert areas(edits.expand_country(m.countries, "country-001", brush, land)) == {"country-001": 20, "country-002": 12}
    moved = edits.transfer_region(m, "country-001-region-01", "country-002")
    assert areas(moved.countries) == {"country-001": 8, "country-002": 24}
    new = moved.region_rows.where("country_id = 'country-002'").collect()
    assert {r.id for r in new} >= {"country-002-region-03"} and sum(r.is_capital for r in new) == 1
    made = edits.create_country(m, m.regions.where("owner = 'country-001-region-01'").select("x", "y"), "Free", within=1.0)
    assert areas(made.countries)["country-003"] == 8 and "country-003-region-01" in areas(made.regions)
    assert {r.id for r in made.region_rows.collect()} == set(areas(made.regions))
    cut = edits.slice_region(m, [(-1.0, 1.0), (5.0, 1.0)], "country-001")
    assert areas(cut.regions)["country-001-region-03"] == 4
    claimed = edits.claim_island(m, 0, 0, land.where("x < 4"), "country-002")
    assert areas(claimed.countries) == {"country-002": 32}
    assert edits.territory_at(m, 0, 0, land).count() == 16
    history = edits.History(m)
    history.apply(lambda now: edits.delete_region(now, "country-001-region-01"))
    assert history.undo() is m and history.redo() is not m


def test_labels_stay_or_move(spark):
    m = small_map(spark)
    old = spark.createDataFrame([("country-001", 1.0, 1.0), ("country-002", 0.0, 0.0)], "id string, x double, y double")
    out = edits.borders_and_labels(m, old, old)
    assert {r.id: r.kept for r in out["country_labels"].collect()} == {"country-001": True, "country-002": False}
    made = edits.outlines(m.countries)
    rows = spark.createDataFrame([("country-001", "One", None, 16.0), ("country-002", "Two", "s", 20000.0)], "id string, name string, state_group_id string, area double")
    got = {r.country_id: (r.method, r.label_rank) for r in extraction.production_labels(made, rows, old.limit(1)).collect()}
    assert got == {"country-001": ("manual-override", 3), "country-002": ("largest-component-polylabel", 2)}


def test_edit_log_stream(spark):
    folder = new_folder(spark, "log")
    rows = [(1, "2024-01-01 00:00:00", "a", "rename", "A"), (2, "2024-01-01 00:01:00", "b", "rename", "B"), (3, "2024-01-01 00:11:00", "a", "delete", None)]
    spark.createDataFrame(rows, "seq long, at string, id string, action string, name string").selectExpr("seq", "cast(at as timestamp) at", "id", "action", "name").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(log_edits.LOG).parquet(f"{folder}/in")
    log_edits.keep_state(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    assert {(r.id, r.name) for r in spark.read.parquet(f"{folder}/out/0").where("action <> 'delete'").collect()} == {("b", "B")}
    static = spark.read.parquet(f"{folder}/in")
    assert log_edits.latest(static).count() == 1 and log_edits.activity(static).count() == 2
