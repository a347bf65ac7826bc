"""Grids as cell tables (x, y, ...): neighbours, morphology, components, floods and nearest seeds.

Components work on square tiles: a tile's cells are labelled by an array kernel, then the labels that touch across
tile borders are joined, by one task while there are few pairs of them, else by alternating stars. Fills run on tiles as
well, which hand on the values at their borders until none gets better. No task holds more than a tile. Nearest seeds
are found by columns and then by bands of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.session import written

#: Steps to neighbours in the order in which fills try them.
AROUND_8 = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
AROUND_4 = ((1, 0), (-1, 0), (0, 1), (0, -1))
TILE = 512
#: Pairs of touching labels up to which one task joins them all (16 bytes each).
FEW_PAIRS = 1_000_000
#: Rows of a band that finds its nearest seeds together.
BAND = 32


def neighbours(cells: DataFrame, steps=AROUND_8, keep: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, k, nx, ny, keep...) for each cell and step, whether there is a cell at (nx, ny) or not."""
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(steps)))).alias("s")
    out = cells.select("x", "y", *keep, step)
    return out.select("x", "y", *keep, F.col("s.k").alias("k"), (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"))


def adjacent(cells: DataFrame, steps=AROUND_8, keep: tuple[str, ...] = ()) -> DataFrame:
    """neighbours() that are cells, with their columns of `keep` as n_<name>."""
    there = cells.select(F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(c).alias(f"n_{c}") for c in keep))
    return neighbours(cells, steps, keep).join(there, ["nx", "ny"])


def odd(size: int) -> int:
    size = max(1, int(size))
    return size + 1 - size % 2


def _box(size: int) -> list[tuple[int, int]]:
    reach = odd(size) // 2
    return [(dx, dy) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]


def _sliding(cells: DataFrame, value: str, size: int, combine) -> DataFrame:
    """combine over rows, then over columns, of a square window; cells that aren't there are ignored."""
    reach = odd(size) // 2
    for axis in ("x", "y"):
        shift = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("s")
        spread = cells.select("x", "y", value, shift).withColumn(axis, F.col(axis) + F.col("s"))
        here = cells.select("x", "y")
        cells = spread.groupBy("x", "y").agg(combine(value).alias(value)).join(here, ["x", "y"])
    return cells


def dilate(cells: DataFrame, value: str = "value", size: int = 3) -> DataFrame:
    return _sliding(cells.select("x", "y", value), value, size, F.max)


def erode(cells: DataFrame, value: str = "value", size: int = 3) -> DataFrame:
    return _sliding(cells.select("x", "y", value), value, size, F.min)


def close(cells: DataFrame, value: str = "value", size: int = 3) -> DataFrame:
    return erode(dilate(cells, value, size), value, size)


def gradient(cells: DataFrame, value: str = "value", size: int = 3) -> DataFrame:
    wide, thin = dilate(cells, value, size), erode(cells, value, size).withColumnRenamed(value, "thin")
    return wide.join(thin, ["x", "y"]).select("x", "y", (F.col(value) - F.col("thin")).alias(value))


def blurred(cells: DataFrame, value: str, weights: list[float]) -> DataFrame:
    """A separable weighted mean (weights are those of one axis); the weights of missing cells are left out."""
    reach = len(weights) // 2
    for axis in ("x", "y"):
        step = F.explode(F.array(*(F.struct(F.lit(i - reach).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)))).alias("o")
        spread = cells.select("x", "y", value, step).withColumn(axis, F.col(axis) + F.col("o.s"))
        mean = spread.groupBy("x", "y").agg((F.sum(F.col(value) * F.col("o.w")) / F.sum("o.w")).alias(value))
        cells = mean.join(cells.select("x", "y"), ["x", "y"])
    return cells


def local_contrast(cells: DataFrame, value: str, weights: list[float], threshold: float) -> DataFrame:
    """Cells and whether they are darker than their blurred surroundings by more than the threshold."""
    smooth = blurred(cells.select("x", "y", value), value, weights).withColumnRenamed(value, "smooth")
    return cells.join(smooth, ["x", "y"]).withColumn("dark", F.col("smooth") - F.col(value) > threshold).drop("smooth")


def _tile_labels(x: np.ndarray, y: np.ndarray, steps) -> np.ndarray:
    """Least cell index (in row-major order) that each cell of a tile reaches."""
    order = np.lexsort((x, y))
    grid = np.full((int(y.max() - y.min()) + 3, int(x.max() - x.min()) + 3), -1, np.int64)
    gx, gy = x - x.min() + 1, y - y.min() + 1
    grid[gy[order], gx[order]] = np.arange(len(x))
    label = np.arange(len(x))
    while True:
        best = label.copy()
        for dx, dy in steps:
            near = grid[gy[order] + dy, gx[order] + dx]
            there = near >= 0
            best[there] = np.minimum(best[there], label[near[there]])
        best = best[best]
        if np.array_equal(best, label):
            out = np.empty(len(x), np.int64)
            out[order] = order[label]
            return out
        label = best


def _stars(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root): the least node that each reaches, by alternating large and small stars."""
    now, seen = written(edges.where("u <> v").distinct(), "edges"), None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
    raise RuntimeError("components didn't settle")


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, root) as _stars() has it, for a written table of pairs that fits into a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                u, v = root(u), root(v)
                up[max(u, v)] = min(u, v)
        nodes = [n for n in list(up) if root(n) != n]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "root"])

    return pairs.coalesce(1).mapInArrow(run, "node long, root long")


def linked(pairs: DataFrame, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(node, root) of nodes that aren't their own root: the least node that each reaches. pairs: a written table of u and v."""
    return _joined(pairs) if pairs.count() <= few_pairs else _stars(pairs)


def components(cells: DataFrame, steps=AROUND_8, tile: int = TILE, few_pairs: int = FEW_PAIRS, by: str | None = None) -> DataFrame:
    """(x, y, component): the least cell number (y * 2^32 + x) that each cell reaches. Coordinates are 0 to 2^31 - 1.

    by: a column of whole numbers; cells of unlike values don't hang together.
    """
    kind = F.lit(0).cast("long") if by is None else F.col(by).cast("long")
    placed = cells.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), kind.alias("kind")).distinct()
    placed = placed.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        first = _tile_labels(x, y, steps)
        return pd.DataFrame({"x": x, "y": y, "kind": pdf["kind"], "node": y[first] * (1 << 32) + x[first]})

    local = written(placed.groupBy("tx", "ty", "kind").applyInPandas(label, "x long, y long, kind long, node long"), "tiles")
    edge = ((F.col("x") % tile).isin(0, tile - 1)) | ((F.col("y") % tile).isin(0, tile - 1))
    border = local.where(edge)
    crossing = adjacent(border, steps, ("node", "kind")).where((F.col("node") < F.col("n_node")) & (F.col("kind") == F.col("n_kind")))
    crossing = written(crossing.select(F.col("node").alias("u"), F.col("n_node").alias("v")).distinct(), "crossing")
    roots = linked(crossing, few_pairs)
    return local.join(roots, "node", "left").select("x", "y", F.coalesce("root", "node").alias("component"))


def component_stats(labelled: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Area, bounding box, centroid and more aggregates of each component."""
    return labelled.groupBy("component").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        (F.max("x") - F.min("x") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        *extra,
    )


def keep_large(cells: DataFrame, least: int, steps=AROUND_8) -> DataFrame:
    """The cells of components of at least so many cells."""
    labelled = components(cells, steps)
    large = component_stats(labelled).where(F.col("area") >= least).select("component")
    return labelled.join(large, "component", "left_semi").select("x", "y")


def enclosed(free: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The free cells of a box that can't be reached, side by side, from its outside."""
    inside = free.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    labelled = components(inside, AROUND_4)
    border = labelled.where((F.col("x").isin(x0, x1)) | (F.col("y").isin(y0, y1))).select("component").distinct()
    return labelled.join(border, "component", "left_anti").select("x", "y")


def box_cells(spark: SparkSession, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    rows = spark.range(y0, y1 + 1).select(F.col("id").cast("int").alias("y"))
    return rows.select(F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x"), "y")


def fill_holes(cells: DataFrame) -> DataFrame:
    """cells and the cells that they enclose."""
    box = cells.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None:
        return cells.select("x", "y")
    x0, y0, x1, y1 = box[0] - 1, box[1] - 1, box[2] + 1, box[3] + 1
    mine = cells.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    free = box_cells(cells.sparkSession, x0, y0, x1, y1).join(mine, ["x", "y"], "left_anti")
    shifted = free.select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"))
    holes = enclosed(shifted, 0, 0, x1 - x0, y1 - y0).select((F.col("x") + x0).cast("int").alias("x"), (F.col("y") + y0).cast("int").alias("y"))
    return mine.union(holes).distinct()


NEVER = np.iinfo(np.int64).max


def _fill_tile(x: np.ndarray, y: np.ndarray, far: np.ndarray, seed: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Distances and seed numbers of cells that start with some, spread to all that they reach: the shortest distance,
    and of the seeds at that distance the least. Cells that are not reached have NEVER."""
    x0, y0 = x.min() - 1, y.min() - 1
    spot = np.full((int(y.max() - y0) + 2, int(x.max() - x0) + 2), -1, np.int64)
    spot[y - y0, x - x0] = np.arange(len(x))
    far, seed = far.copy(), seed.copy()
    level = int(far.min())
    front = np.flatnonzero(far == level)
    while level != NEVER:
        for dx, dy in steps:
            near = spot[y[front] - y0 + dy, x[front] - x0 + dx]
            there = near >= 0
            to, by = near[there], seed[front[there]]
            shorter = far[to] > level + 1
            far[to[shorter]] = level + 1
            seed[to[shorter]] = NEVER
            equal = far[to] == level + 1
            np.minimum.at(seed, to[equal], by[equal])
        level += 1
        front = np.flatnonzero(far == level)
        if not len(front):
            level = int(far[far > level].min(initial=NEVER))
            front = np.flatnonzero(far == level)
    return far, seed


#: Tables of changed tiles after which a fill's tiles are written anew as one table.
VERSIONS = 16


def latest(versions: list[DataFrame], keys: list[str]) -> DataFrame:
    """The cells of each tile (keys) from the last of the tables that has it."""
    if len(versions) == 1:
        return versions[0].drop("changed")
    tiles = [v.select(*keys).distinct().withColumn("version", F.lit(i)) for i, v in enumerate(versions)]
    last = functools.reduce(DataFrame.union, tiles).groupBy(*keys).agg(F.max("version").alias("version"))  # a row a tile
    all_ = functools.reduce(DataFrame.unionByName, (v.drop("changed").withColumn("version", F.lit(i)) for i, v in enumerate(versions)))
    return all_.join(last, [*keys, "version"], "left_semi").drop("version")


def flood(cells: DataFrame, steps=AROUND_8, tile: int = TILE) -> DataFrame:
    """(x, y, label, distance): seeds spread over cells; unreached cells have label 0 and distance -1.

    cells: x, y (0 to 2^31 - 1), seed (0: none). Among seeds at equal distance the first one in row-major order wins.
    That is the one that a queue would serve first: it serves cells by distance, and those of a distance in the order
    of the seeds they came from.

    Each tile spreads what it has, once. From then on only changes move: cells beside a border that have become nearer, or as near
    to an earlier seed, go to the tile beyond, and of the tiles that get some, those with a cell that this improves are
    written anew. Settled tiles stay where they are; they are read again, and written again every VERSIONS rounds.
    """
    kind = cells.schema["seed"].dataType.simpleString()
    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("x", "y")}
    number = F.when(F.col("seed") > 0, F.col("y").cast("long") * (1 << 32) + F.col("x"))
    at = {"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)}
    start = cells.select("x", "y", F.when(F.col("seed") > 0, 0).otherwise(NEVER).cast("long").alias("far"), F.coalesce(number, F.lit(NEVER)).alias("by"), F.greatest(F.col("seed"), F.lit(0)).cast(kind).alias("label")).withColumns(at)
    schema = f"x {kinds['x']}, y {kinds['y']}, far long, by long, label {kind}, tx long, ty long, changed boolean"
    names = ["x", "y", "far", "by", "label", "tx", "ty"]

    def spread(own: pd.DataFrame, beside: pd.DataFrame | None) -> pd.DataFrame:
        if not len(own):
            return own.reindex(columns=[*names, "changed"])
        both = own if beside is None else pd.concat([own[names[:5]], beside[names[:5]]], ignore_index=True)
        was, old = both["far"].to_numpy(np.int64), both["by"].to_numpy(np.int64)
        far, by = _fill_tile(both["x"].to_numpy(np.int64), both["y"].to_numpy(np.int64), was, old, steps)
        n = len(own)
        changed = (far[:n] != was[:n]) | (by[:n] != old[:n])
        if beside is not None and not changed.any():
            return own.iloc[:0].reindex(columns=names).assign(changed=False)
        seeds, place = np.unique(old, return_index=True)
        label = both["label"].to_numpy()[place[np.searchsorted(seeds, by[:n])]]
        return own[names].assign(far=far[:n], by=by[:n], label=label, changed=changed)

    def first(own: pd.DataFrame) -> pd.DataFrame:
        return spread(own, None)

    def again(key, own: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        return spread(own, beside)

    edge = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    versions = [written(start.groupBy("tx", "ty").applyInPandas(first, schema), "flood")]
    news = versions[0].where(edge & (F.col("far") != NEVER))
    while not news.isEmpty():
        ring = neighbours(news, AROUND_8, ("far", "by", "label", "tx", "ty")).withColumns({"bx": F.floor(F.col("nx") / tile), "by_": F.floor(F.col("ny") / tile)})
        ring = ring.where((F.col("bx") != F.col("tx")) | (F.col("by_") != F.col("ty")))
        new = [(F.col(c) + F.lit(0)).cast(t).alias(c) for c, t in (*kinds.items(), ("far", "long"), ("by", "long"), ("label", kind))]  # columns that aren't those of the tiles
        halo = ring.select(*new, F.col("bx").alias("tx"), F.col("by_").alias("ty"))
        mine = latest(versions, ["tx", "ty"]).join(halo.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
        patch = written(mine.groupBy("tx", "ty").cogroup(halo.groupBy("tx", "ty")).applyInPandas(again, schema), "flood")
        news = patch.where(F.col("changed") & edge)
        versions.append(patch)
        if len(versions) > VERSIONS:
            versions = [written(latest(versions, ["tx", "ty"]).withColumn("changed", F.lit(False)), "flood")]
    never = F.col("far") == NEVER
    return latest(versions, ["tx", "ty"]).select("x", "y", F.when(never, 0).otherwise(F.col("label")).cast(kind).alias("label"), F.when(never, -1).otherwise(F.col("far")).alias("distance"))


def nearest_seed(cells: DataFrame, seeds: DataFrame, radius: int | None = None) -> DataFrame:
    """(x, y, label, d2) of the seed nearest to each cell, ties by the seed's (y, x).

    Null only where there is no seed, or none within a radius if one is given. First each column that has seeds tells
    its nearest one to each row; then rows look along those, from each cell to both sides as far as it can get nearer.
    A task holds a column's seeds, and then a band of rows. seeds: x, y, label.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.select("x", "y").schema.fields} | {"label": seeds.schema["label"].dataType.simpleString()}
    box = cells.agg(F.min("y"), F.max("y")).first()
    if box[0] is None or seeds.isEmpty():
        return cells.select("x", "y", F.lit(None).cast(kinds["label"]).alias("label"), F.lit(None).cast("long").alias("d2"))
    low, high = int(box[0]), int(box[1])

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        at, rows = pdf["y"].to_numpy(np.int64), np.arange(low, high + 1)
        below = np.clip(np.searchsorted(at, rows), 0, len(at) - 1)
        above = np.maximum(below - 1, 0)
        pick = np.where(np.abs(rows - at[above]) <= np.abs(at[below] - rows), above, below)
        return pd.DataFrame({"x": pdf["x"].iloc[0], "y": rows, "sy": at[pick], "label": pdf["label"].to_numpy()[pick]})

    columns = seeds.select("x", "y", "label").groupBy("x").applyInPandas(column, f"x {kinds['x']}, y long, sy long, label {kinds['label']}")

    def band(key, own: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_row = {y: p for y, p in beside.groupby("y")}
        for y, mine in own.groupby("y"):
            p = by_row[y].sort_values("x")
            sx, sy = p["x"].to_numpy(np.int64), p["sy"].to_numpy(np.int64)
            gap = (sy - y) ** 2
            x = mine["x"].to_numpy(np.int64)
            right = np.searchsorted(sx, x)
            best = np.full((len(x), 3), NEVER)  # d2, sy, sx
            which = np.full(len(x), -1)
            for side in (0, 1):
                live, step = np.arange(len(x)), 0
                while len(live):
                    i = right[live] + step if side else right[live] - 1 - step
                    inside = (i >= 0) & (i < len(sx))
                    live, i = live[inside], i[inside]
                    along = (sx[i] - x[live]) ** 2
                    near = along <= best[live, 0]
                    live, i, along = live[near], i[near], along[near]
                    d2 = along + gap[i]
                    old = best[live]
                    better = (d2 < old[:, 0]) | ((d2 == old[:, 0]) & ((sy[i] < old[:, 1]) | ((sy[i] == old[:, 1]) & (sx[i] < old[:, 2]))))
                    best[live[better]] = np.stack([d2, sy[i], sx[i]], axis=1)[better]
                    which[live[better]] = i[better]
                    step += 1
            out.append(mine.assign(label=p["label"].to_numpy()[which], d2=best[:, 0]))
        return pd.concat(out) if out else own.assign(label=None, d2=None)

    rows = F.floor(F.col("y") / BAND).alias("band")
    mine = cells.select("x", "y").distinct()
    found = mine.groupBy(rows).cogroup(columns.join(mine.select("y").distinct(), "y", "left_semi").groupBy(rows)).applyInPandas(band, f"x {kinds['x']}, y {kinds['y']}, label {kinds['label']}, d2 long")
    if radius is None:
        return found
    near = F.col("d2") <= radius * radius
    return found.select("x", "y", F.when(near, F.col("label")).alias("label"), F.when(near, F.col("d2")).alias("d2"))


def stroke_cells(strokes: DataFrame, per_unit: int = 2) -> DataFrame:
    """Distinct cells under strokes. strokes: points (array of x, y), sampled `per_unit` times a unit."""
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))).alias("e")
    edges = strokes.where(F.size("points") >= 2).select(pair)
    x0, y0, x1, y1 = (F.col(f"e.{p}.{c}") for p in ("a", "b") for c in ("x", "y"))
    steps = F.greatest(F.lit(1), F.ceil(F.hypot(x1 - x0, y1 - y0) * per_unit)).cast("int")
    t = F.col("s") / F.col("n")
    dense = edges.select(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), steps.alias("n"), F.explode(F.sequence(F.lit(0), steps)).alias("s"))
    return dense.select(F.floor(F.col("x0") + (F.col("x1") - F.col("x0")) * t).cast("int").alias("x"), F.floor(F.col("y0") + (F.col("y1") - F.col("y0")) * t).cast("int").alias("y")).distinct()


def barrier_cells(cells: DataFrame, strokes: DataFrame) -> DataFrame:
    """cells (x, y, value) with -1 under strokes; strokes add no cells."""
    hit = stroke_cells(strokes).withColumn("hit", F.lit(True))
    return cells.join(hit, ["x", "y"], "left").select("x", "y", F.when(F.col("hit"), -1).otherwise(F.col("value")).alias("value"))


def sampled_image(cells: DataFrame, pixels: DataFrame, box: tuple[float, float, float, float], size: tuple[int, int], scale: tuple[float, float], shift: tuple[float, float], dark: Column) -> DataFrame:
    """(x, y, value): -1 where a pixel of a cell's window is dark, else 0. box: x0, y0, x1, y1 of the owner's bounds.

    pixels: x, y and what `dark` looks at, of an image of `size`, laid over the box by scale and shift. Windows are
    half a cell's pixels each way, one at least; cells that the image doesn't cover are 0.
    """
    wide, tall = max(1.0, box[2] - box[0]), max(1.0, box[3] - box[1])
    reach = [max(1, int(n / (w * s) * 0.55)) for n, w, s in zip(size, (wide, tall), scale, strict=True)]
    u = (F.col("x") + 0.5 - (box[0] + shift[0])) / (wide * scale[0])
    v = (F.col("y") + 0.5 - (box[1] + shift[1])) / (tall * scale[1])
    on = u.between(0, 1) & v.between(0, 1) & (u < 1) & (v < 1)
    placed = cells.select("x", "y", F.when(on, F.floor(u * size[0])).alias("cx"), F.when(on, F.floor(v * size[1])).alias("cy"))
    marks = pixels.where(dark).select("x", "y")
    wide_marks = marks.select(F.explode(F.sequence(F.col("x") - reach[0], F.col("x") + reach[0])).alias("cx"), "y")
    reached = wide_marks.select("cx", F.explode(F.sequence(F.col("y") - reach[1], F.col("y") + reach[1])).alias("cy")).distinct().withColumn("hit", F.lit(True))
    return placed.join(reached, ["cx", "cy"], "left").select("x", "y", F.when(F.col("hit"), -1).otherwise(0).alias("value"))
