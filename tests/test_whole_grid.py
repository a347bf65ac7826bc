"""Queries without SQL over all cells of the grid."""

from collections import Counter

from cartolith import catalog
from cartolith.catalog import fixtures as fx


def test_region_queries_take_the_whole_grid(spark, sf_dir):
    catalog.load()
    cells = {(r.x, r.y): r.noise < 700 for r in fx.grid(spark, sf_dir).select("x", "y", "noise").collect()}
    region = lambda x, y: f"country-{1 + x // 30:03d}-region-0{1 + (y >= 50)}"
    owned = Counter(region(x, y) for (x, y), mine in cells.items() if mine)
    cut = {r.owner: r.area for r in catalog.QUERIES["sliced_regions"](spark, sf_dir).collect()}
    assert sum(cut.values()) == sum(owned.values()) and {o: cut[o] for o in owned if not o.startswith("country-001")} == {o: n for o, n in owned.items() if not o.startswith("country-001")}
    snapped = {r.owner: r.area for r in catalog.QUERIES["snapped_regions"](spark, sf_dir).collect()}
    assert set(snapped) == set(owned) and sum(snapped.values()) == len(cells)
    drawn = lambda x, y: x % 20 == 10 or y % 15 == 7
    photo = catalog.QUERIES["photo_regions"](spark, sf_dir).collect()
    assert {r.owner for r in photo} == {"photo"} and sum(r.area for r in photo) == len(cells)
    faces, left = 0, {p for p in cells if not drawn(*p)}
    while left:
        faces, queue = faces + 1, [left.pop()]
        while queue:
            x, y = queue.pop()
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
            left -= near
            queue += near
    assert len(photo) == faces
