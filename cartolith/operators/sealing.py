"""Borders on photographed land: leaks and gaps sealed on tiles, and small faces merged by a table of which faces touch.

A border cell is -1, open land 0, anything else neither; cells that aren't there are neither. Both rules are stated for a walk
over the cells, row by row, that changes them on its way. What a cell becomes then depends on

* leaks: the cell, its neighbours to both sides, and the three below them, all as they were. A cell that has just been closed
  never closes the next one, as the two rules ask for opposite states of the cell below;
* gaps: the cells to the left and above as they have become, those to the right and below as they were. So closed cells
  can run on over any distance, but only to the right and down. A tile is solved from the values beside it; where its
  right column or bottom row then has more closed cells, the tile beyond is solved again, until none has.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.grid import AROUND_4, TILE, latest, neighbours
from cartolith.session import written

#: Value of what isn't land.
NEITHER = -999
KEYS = ["owner", "tx", "ty"]


def _together(own: pd.DataFrame, beside: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """A tile's cells and those beside it, of which there may be none."""
    return pd.concat([own[columns], beside[columns]], ignore_index=True) if "x" in beside else own[columns]


def _grid_of(x: np.ndarray, y: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, int, int]:
    """An image of cells with a margin of one cell that isn't there."""
    x0, y0 = int(x.min()) - 1, int(y.min()) - 1
    image = np.full((int(y.max()) - y0 + 2, int(x.max()) - x0 + 2), NEITHER, np.int64)
    image[y - y0, x - x0] = value
    return image, x0, y0


def leaks_closed(image: np.ndarray) -> np.ndarray:
    """Closes corners through which land leaks between two border cells that touch diagonally; the image's rim stays as it is."""
    out = image.copy()
    border, open_ = image == -1, image == 0
    here, left, right = (slice(0, -1), slice(1, -1)), (slice(0, -1), slice(0, -2)), (slice(0, -1), slice(2, None))
    low, low_left, low_right = (slice(1, None), slice(1, -1)), (slice(1, None), slice(0, -2)), (slice(1, None), slice(2, None))
    first = open_[here] & border[left] & border[low] & open_[low_left]
    second = open_[here] & ~first & border[right] & border[low] & open_[low_right]
    out[here][first | second] = -1
    return out


def gaps_closed(was: np.ndarray, became: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Closes open cells between border cells to both sides, or above and below. became: what is known of the cells beside it.

    Cells are taken by the sum of their places, as each depends on the ones to the left and above only.
    """
    out = became.copy()
    border = was == -1
    height, width = was.shape
    ys, xs = np.nonzero(inner & (was == 0))
    order = np.argsort(ys + xs, kind="stable")
    ys, xs = ys[order], xs[order]
    cuts = np.flatnonzero(np.diff(ys + xs)) + 1
    for y, x in zip(np.split(ys, cuts), np.split(xs, cuts), strict=True):
        closed = ((out[y, x - 1] == -1) & border[y, np.minimum(x + 1, width - 1)]) | ((out[y - 1, x] == -1) & border[np.minimum(y + 1, height - 1), x])
        out[y[closed], x[closed]] = -1
    return out


def _beside(cells: DataFrame, tile: int, steps, keep: tuple[str, ...]) -> DataFrame:
    """Cells once for each other tile that one of their neighbours is in, with that tile's place."""
    at = {"bx": F.floor(F.col("nx") / tile), "by": F.floor(F.col("ny") / tile)}
    ring = neighbours(cells, steps, (*keep, "tx", "ty")).withColumns(at).where((F.col("bx") != F.col("tx")) | (F.col("by") != F.col("ty")))
    return ring.select("x", "y", *keep, F.col("bx").alias("tx"), F.col("by").alias("ty")).distinct()


def sealed(cells: DataFrame, gaps: bool = True, tile: int = TILE) -> DataFrame:
    """cells (owner, x, y, value) with leaks between border cells closed, and gaps of one cell, for each owner by itself.

    Gaps in the outermost rows and columns of an owner's cells stay. No task holds more than a tile of an owner and the cells
    around it. A cell counts once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("owner", "x", "y", "value"))
    at = {"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)}
    start = written(cells.select("owner", "x", "y", "value").dropDuplicates(["owner", "x", "y"]).withColumns(at), "photo")
    edge = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)

    def close_leaks(key, own: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own.reindex(columns=["owner", "x", "y", "value", "tx", "ty"])
        both = _together(own, beside, ["x", "y", "value"])
        image, x0, y0 = _grid_of(both["x"].to_numpy(), both["y"].to_numpy(), both["value"].to_numpy())
        return own[["owner", "x", "y", "value", "tx", "ty"]].assign(value=leaks_closed(image)[own["y"] - y0, own["x"] - x0])

    border = start.where(edge & F.col("value").isin(-1, 0))
    halo = _beside(border, tile, ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)), ("owner", "value"))
    halo = written(halo, "halo")  # a table, as two sides of one join may not be the same
    tight = start.groupBy(*KEYS).cogroup(halo.groupBy(*KEYS)).applyInPandas(close_leaks, f"{schema}, tx long, ty long")
    if not gaps:
        return tight.select("owner", "x", "y", "value")
    tight = written(tight, "tight")
    box = written(tight.groupBy("owner").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")), "boxes")
    land = tight.join(box, "owner").withColumn("inner", (F.col("x") != F.col("x0")) & (F.col("x") != F.col("x1")) & (F.col("y") != F.col("y0")) & (F.col("y") != F.col("y1"))).drop("x0", "y0", "x1", "y1")
    # the tile keeps what its cells were; cells beside it come with what they were and have become
    land = land.withColumns({"now": F.col("value"), "changed": F.lit(True)})
    fields = f"{schema}, tx long, ty long, inner boolean, now {kinds['value']}, changed boolean"
    names = ["owner", "x", "y", "value", "tx", "ty", "inner", "now"]

    def close_gaps(key, own: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own.reindex(columns=[*names, "changed"])
        both = _together(own, beside, ["x", "y", "value", "now"])
        x, y = both["x"].to_numpy(), both["y"].to_numpy()
        was, x0, y0 = _grid_of(x, y, both["value"].to_numpy())
        became, _, _ = _grid_of(x, y, both["now"].to_numpy())
        mine = np.zeros(was.shape, bool)
        mine[own["y"] - y0, own["x"] - x0] = own["inner"]
        now = gaps_closed(was, became, mine)[own["y"] - y0, own["x"] - x0]
        return own[names].assign(now=now, changed=now != own["now"].to_numpy())

    def around(state: DataFrame) -> DataFrame:
        return _beside(state.where(edge & F.col("value").isin(-1, 0)), tile, AROUND_4, ("owner", "value", "now"))

    halo = written(around(land.where("value = -1")), "halo")
    versions = [written(land.groupBy(*KEYS).cogroup(halo.groupBy(*KEYS)).applyInPandas(close_gaps, fields), "gaps")]
    while True:
        news = written(_beside(versions[-1].where(F.col("changed") & edge), tile, ((1, 0), (0, 1)), ("owner",)).select(*KEYS).distinct(), "news")
        news = news.join(versions[0].select(*KEYS).distinct(), KEYS, "left_semi")
        if news.isEmpty():
            return latest(versions, KEYS).select("owner", "x", "y", F.col("now").alias("value"))
        state = latest(versions, KEYS)
        active = state.join(news, KEYS, "left_semi")
        halo = written(around(state.where("now = -1")).join(news, KEYS, "left_semi"), "halo")
        versions.append(written(active.groupBy(*KEYS).cogroup(halo.groupBy(*KEYS)).applyInPandas(close_gaps, fields), "gaps"))


def touching_faces(labels: DataFrame) -> DataFrame:
    """(owner, label, other, y, x, k): faces that touch, with the first place, row by row, and step where label meets other."""
    mine = labels.where("label > 0").select("owner", "x", "y", "label")
    there = mine.select("owner", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("label").alias("other"))
    met = neighbours(mine, AROUND_4, ("owner", "label")).join(there, ["owner", "nx", "ny"]).where("label <> other")
    return met.groupBy("owner", "label", "other").agg(F.min(F.struct("y", "x", "k")).alias("at")).select("owner", "label", "other", "at.y", "at.x", "at.k")


def without_noise(labels: DataFrame, least: int) -> DataFrame:
    """labels (owner, x, y, label) whose faces of fewer than `least` cells have gone to a neighbour each.

    By rising label, to the neighbour of most cells; of equals, to the one met first on a walk over the face's cells. Sizes
    are those of the start. A face that others have gone to has their neighbours too. A task folds an owner's
    table of faces that touch, not its cells.
    """
    kind = labels.schema["label"].dataType.simpleString()
    owner = labels.schema["owner"].dataType.simpleString()
    sizes = labels.where("label > 0").groupBy("owner", "label").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.join(touching_faces(labels), ["owner", "label"], "left")

    def fold(group: pa.Table) -> pa.Table:
        size: dict[int, int] = {}
        near: dict[int, dict[int, tuple]] = defaultdict(dict)
        for label, n, other, y, x, k in zip(*(group.column(c).to_pylist() for c in ("label", "n", "other", "y", "x", "k")), strict=True):
            size[label] = n
            if other is not None:
                near[label][other] = (y, x, k)
        gone: dict[int, int] = {}
        for label in sorted(size):
            if size[label] >= least or not near[label]:
                continue
            best = min(near[label], key=lambda o: (-size[o], near[label][o]))
            gone[label] = best
            for other, at in near.pop(label).items():
                back = near[other].pop(label)
                if other != best:  # the two touch where they did, or where the face that went did
                    near[best][other] = min(at, near[best].get(other, at))
                    near[other][best] = min(back, near[other].get(best, back))
        rows = []
        for label in gone:
            end = label
            while end in gone:
                end = gone[end]
            rows.append((label, end))
        names = group.column("owner").slice(0, 1).combine_chunks()
        return pa.table([pa.concat_arrays([names] * len(rows)) if rows else names.slice(0, 0), pa.array([r[0] for r in rows], group.column("label").type), pa.array([r[1] for r in rows], group.column("label").type)], ["owner", "label", "into"])

    moves = pairs.groupBy("owner").applyInArrow(fold, f"owner {owner}, label {kind}, into {kind}")
    return labels.join(moves, ["owner", "label"], "left").select("owner", "x", "y", F.coalesce("into", "label").cast(kind).alias("label"))
