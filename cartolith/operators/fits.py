"""The uniform scale and shift with which one set of cells covers another best, at any size of the sets.

Small images are correlated as wholes, scales dealt over the cluster. Large ones are never put together: both sets become
packed tiles. For each scale, numbers of cells in blocks of C x C give a bound of what any shift within a window of C x C
can cover; a block of the moved set can at most cover the cells of the four blocks that it may touch. Windows are then
taken by falling bound, one at first and then more at a time: tiles of the moved set meet the tiles below them, each pair is correlated over
the window's shifts, and the pairs' images are added up. It ends when no window left has a bound as good as the best
that was found, so the result is that of trying all shifts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.session import written

#: Cells of the boxes that are fitted as whole images, blocks of a coarse image, side of a moved tile, windows that are looked at together.
WHOLE, COARSE, SIDE, TOGETHER = 1 << 20, 1 << 12, 512, 64
#: Shifts up to which a window is counted shift by shift, not in frequency space.
FEW_SHIFTS = 16
#: Scales whose blocks are counted together.
SCALES = 64


def uniform_fits(local: np.ndarray, target: np.ndarray, scales: np.ndarray) -> pd.DataFrame:
    """Best shift and IoU for each scale of a mask (0/1) within a larger one, by correlation in frequency space."""
    rows, need = [], float(target.sum())
    for scale in scales.tolist():
        at_y, at_x = sources(local.shape[0], scale), sources(local.shape[1], scale)
        height, width = len(at_y), len(at_x)
        if width > target.shape[1] or height > target.shape[0]:
            continue
        part = local[np.ix_(at_y, at_x)].astype(float)
        size = (target.shape[0] + height - 1, target.shape[1] + width - 1)
        found = np.rint(np.fft.irfft2(np.fft.rfft2(target, size) * np.fft.rfft2(part[::-1, ::-1], size), size))
        found = found[height - 1 : target.shape[0], width - 1 : target.shape[1]]
        y, x = np.unravel_index(int(found.argmax()), found.shape)
        rows.append((scale, int(x), int(y), found[y, x] / max(1.0, part.sum() + need - found[y, x])))
    return pd.DataFrame(rows, columns=["scale", "x", "y", "iou"])


def sources(size: int, scale: float) -> np.ndarray:
    """For each row of a scaled image the row of the image that it shows."""
    scaled = max(1, round(size * scale))
    return np.minimum((np.arange(scaled) / scale).astype(int), size - 1)


@dataclass
class Box:
    """The number of a set's cells, and their box, widened by a margin."""

    count: int
    x: int
    y: int
    width: int
    height: int


def boxed(cells: DataFrame, pad: int, name: str) -> tuple[DataFrame, Box]:
    cells = written(cells.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct(), name)
    b = cells.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not b[0]:
        raise ValueError("a mask without cells can't be fitted")
    return cells, Box(b[0], b[1] - pad, b[2] - pad, b[3] - b[1] + 1 + 2 * pad, b[4] - b[2] + 1 + 2 * pad)


def image(cells: DataFrame, box: Box) -> np.ndarray:
    """A whole mask, of WHOLE cells at most."""
    p = cells.toPandas()
    out = np.zeros((box.height, box.width))
    out[p["y"].to_numpy() - box.y, p["x"].to_numpy() - box.x] = 1
    return out


def tiled(cells: DataFrame, box: Box, side: int, name: str) -> DataFrame:
    """(ty, tx, bits): images of side x side cells, packed."""

    def pack(group: pa.Table) -> pa.Table:
        tile = np.zeros((side, side), bool)
        tile[group.column("y").to_numpy() % side, group.column("x").to_numpy() % side] = True
        return pa.table([group.column("ty").slice(0, 1), group.column("tx").slice(0, 1), pa.array([np.packbits(tile).tobytes()])], ["ty", "tx", "bits"])

    at = cells.select((F.col("x") - box.x).alias("x"), (F.col("y") - box.y).alias("y"))
    at = at.withColumns({"ty": F.floor(F.col("y") / side), "tx": F.floor(F.col("x") / side)})
    return written(at.groupBy("ty", "tx").applyInArrow(pack, "ty long, tx long, bits binary"), name)


def _tile(bits: bytes, side: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=side * side).reshape(side, side)


def _span(at: np.ndarray, place: int, side: int) -> tuple[int, int]:
    """The rows of a scaled image that show a tile's rows."""
    return int(np.searchsorted(at, place * side)), int(np.searchsorted(at, (place + 1) * side))


def _block_counts(tiles: DataFrame, a: Box, side: int, low: float, step: float, count: int, block: int) -> DataFrame:
    """(id, by, bx, n): cells in blocks of the set scaled by low + id * step."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ty, tx, bits, part in frame.itertuples(index=False):
                tile, rows = _tile(bits, side).astype(np.float64), []
                for i in range(part * SCALES, min(count, (part + 1) * SCALES)):
                    at_y, at_x = sources(a.height, low + i * step), sources(a.width, low + i * step)
                    (y0, y1), (x0, x1) = _span(at_y, ty, side), _span(at_x, tx, side)
                    if y0 == y1 or x0 == x1:
                        continue
                    shown = []
                    for at, c0, c1, place in ((at_y, y0, y1, ty), (at_x, x0, x1, tx)):
                        m = np.zeros((c1 // block - c0 // block + 1, side))
                        np.add.at(m, (np.arange(c0, c1) // block - c0 // block, at[c0:c1] - place * side), 1)
                        shown.append(m)
                    n = np.rint(shown[0] @ tile @ shown[1].T).astype(np.int64)
                    by, bx = np.nonzero(n)
                    rows.append(pd.DataFrame({"id": i, "by": by + y0 // block, "bx": bx + x0 // block, "n": n[by, bx]}))
                if rows:
                    yield pd.concat(rows)

    parts = -(-count // SCALES)
    dealt = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition("ty", "tx", "part")
    return dealt.mapInPandas(run, "id long, by long, bx long, n long").groupBy("id", "by", "bx").agg(F.sum("n").alias("n"))


def _windows(blocks: DataFrame, a: Box, b: Box, coarse: np.ndarray, low: float, step: float, block: int) -> DataFrame:
    """(id, wy, wx, bound): the best IoU that shifts within each window of each scale may have."""

    def run(group: pa.Table) -> pa.Table:
        i = group.column("id")[0].as_py()
        height, width = (len(sources(n, low + i * step)) for n in (a.height, a.width))
        if height > b.height or width > b.width:
            return pa.table({c: pa.array([], k) for c, k in (("id", pa.int64()), ("wy", pa.int64()), ("wx", pa.int64()), ("bound", pa.float64()))})
        by, bx, n = (group.column(c).to_numpy() for c in ("by", "bx", "n"))
        high, wide = (b.height - height) // block + 1, (b.width - width) // block + 1
        cover = np.zeros((high, wide))
        for y, x, k in zip(by, bx, n, strict=True):
            cover += np.minimum(k, coarse[y : y + high, x : x + wide])
        bound = cover / np.maximum(1.0, n.sum() + b.count - cover)
        wy, wx = np.indices(cover.shape)
        return pa.table([pa.array(np.full(cover.size, i)), pa.array(wy.ravel()), pa.array(wx.ravel()), pa.array(bound.ravel())], ["id", "wy", "wx", "bound"])

    return blocks.groupBy("id").applyInArrow(run, "id long, wy long, wx long, bound double")


def _covered(windows: list, moved: DataFrame, fixed: DataFrame, a: Box, b: Box, side: int, low: float, step: float, block: int) -> dict[int, np.ndarray]:
    """For each window its image of covered cells by shift, added up over pairs of a moved tile and a tile below it.

    Only shifts that leave the moved set within the other one's box are in it.
    """
    room = {i: (b.height - len(sources(a.height, low + i * step)), b.width - len(sources(a.width, low + i * step))) for i in {w.id for w in windows}}
    shifts = [tuple(min(block, r - w * block + 1) for r, w in zip(room[w.id], (w.wy, w.wx), strict=True)) for w in windows]
    sent = moved.sparkSession.sparkContext.broadcast([(w.id, w.wy, w.wx, *h) for w, h in zip(windows, shifts, strict=True)])

    def spans(ty: int, tx: int, i: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int], tuple[int, int]]:
        at_y, at_x = sources(a.height, low + i * step), sources(a.width, low + i * step)
        return at_y, at_x, _span(at_y, ty, side), _span(at_x, tx, side)

    def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ty, tx, bits in frame.itertuples(index=False):
                rows = []
                for w, (i, wy, wx, hy, hx) in enumerate(sent.value):
                    _, _, (y0, y1), (x0, x1) = spans(ty, tx, i)
                    if y0 < y1 and x0 < x1:
                        ys = range((y0 + wy * block) // SIDE, (y1 + wy * block + hy - 2) // SIDE + 1)
                        xs = range((x0 + wx * block) // SIDE, (x1 + wx * block + hx - 2) // SIDE + 1)
                        rows += [(w, ty, tx, bits, y, x) for y in ys for x in xs]
                yield pd.DataFrame(rows, columns=["w", "ay", "ax", "own", "ty", "tx"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for w, ay, ax, own, ty, tx, bits in frame[["w", "ay", "ax", "own", "ty", "tx", "bits"]].itertuples(index=False):
                i, wy, wx, hy, hx = sent.value[w]
                at_y, at_x, (y0, y1), (x0, x1) = spans(ay, ax, i)
                part = _tile(own, side)[np.ix_(at_y[y0:y1] - ay * side, at_x[x0:x1] - ax * side)]
                size = (y1 - y0 + hy - 1, x1 - x0 + hx - 1)
                ground, top, left = np.zeros(size), y0 + wy * block - ty * SIDE, x0 + wx * block - tx * SIDE
                there = _tile(bits, SIDE)[max(0, top) : top + size[0], max(0, left) : left + size[1]]
                ground[max(0, -top) : max(0, -top) + there.shape[0], max(0, -left) : max(0, -left) + there.shape[1]] = there
                if hy * hx <= FEW_SHIFTS:
                    found = np.array([[np.count_nonzero(ground[j : j + y1 - y0, k : k + x1 - x0] * part) for k in range(hx)] for j in range(hy)], np.int64)
                else:
                    full = (size[0] + y1 - y0 - 1, size[1] + x1 - x0 - 1)
                    found = np.fft.irfft2(np.fft.rfft2(ground, full) * np.fft.rfft2(part[::-1, ::-1].astype(float), full), full)
                    found = np.rint(found[y1 - y0 - 1 : size[0], x1 - x0 - 1 : size[1]]).astype(np.int64)
                total[w] = total[w] + found if w in total else found
        yield pd.DataFrame([(w, image.ravel()) for w, image in total.items()], columns=["w", "image"])

    pairs = moved.mapInPandas(below, "w int, ay long, ax long, own binary, ty long, tx long").join(fixed, ["ty", "tx"])
    # packed pairs are small and their work isn't, so their number of tasks doesn't follow their bytes
    pairs = pairs.repartition(int(moved.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w", "ay", "ax", "ty", "tx")
    images: dict[int, np.ndarray] = {}

    def merge(group: pa.Table) -> pa.Table:
        whole = np.sum([x.values.to_numpy() for x in group.column("image")], axis=0)
        return pa.table([group.column("w").slice(0, 1), pa.array([whole], pa.list_(pa.int64()))], ["w", "image"])

    for r in pairs.mapInPandas(add, "w int, image array<long>").groupBy("w").applyInArrow(merge, "w int, image array<long>").collect():  # TOGETHER windows
        images[r.w] = np.array(r.image).reshape(shifts[r.w])
    return images


def best_fit(local: DataFrame, target: DataFrame, low: float, high: float, step: float = 1e-4, pad: int = 0) -> DataFrame:
    """One row (scale, ox, oy, iou): the uniform scale and shift of cells that cover target cells best.

    The moved cells stay within the target's box, widened by pad. Of equal fits the first scale wins, and of its shifts
    the topmost and then leftmost. No row if no scale fits into the box; sets without cells are an error.
    """
    spark = local.sparkSession
    (own, a), (ground, b) = boxed(local, 0, "moved"), boxed(target, pad, "ground")
    count = int(np.floor((high - low) / step + 1.5))
    schema = "scale double, ox double, oy double, iou double"
    if max(a.width * a.height, b.width * b.height) <= WHOLE:
        images = spark.sparkContext.broadcast((image(own, a), image(ground, b)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                fits = uniform_fits(*images.value, low + pdf["id"].to_numpy() * step)
                yield fits.assign(ox=b.x + fits["x"] - a.x * fits["scale"], oy=b.y + fits["y"] - a.y * fits["scale"])[["scale", "ox", "oy", "iou"]]

        fits = spark.range(count).mapInPandas(run, schema)
        return fits.agg(F.max_by(F.struct("scale", "ox", "oy", "iou"), F.struct("iou", -F.col("scale"))).alias("m")).where("m is not null").select("m.*")

    block = 1
    while -(-b.height // block) * -(-b.width // block) > COARSE:
        block *= 2
    side = max(8, min(SIDE, int(SIDE / max(high, 1e-9))))
    moved, fixed = tiled(own, a, side, "moved-tiles"), tiled(ground, b, SIDE, "ground-tiles")
    found = ground.groupBy(F.floor((F.col("y") - b.y) / block).alias("by"), F.floor((F.col("x") - b.x) / block).alias("bx")).count().toPandas()  # COARSE rows
    coarse = np.zeros((-(-b.height // block) + 2, -(-b.width // block) + 2))
    coarse[found["by"], found["bx"]] = found["count"]
    coarse[:-1] += coarse[1:].copy()
    coarse[:, :-1] += coarse[:, 1:].copy()
    blocks = written(_block_counts(moved, a, side, low, step, count, block), "moved-blocks")
    sizes = {r.id: r.n for r in blocks.groupBy("id").agg(F.sum("n").alias("n")).collect()}  # a row a scale
    windows = written(_windows(blocks, a, b, coarse, low, step, block), "windows")
    best: tuple | None = None
    left, together = windows, 1
    while True:
        if best is not None:
            left = left.where(F.col("bound") >= best[0])
        some = left.orderBy(F.desc("bound"), "id", "wy", "wx").limit(together).collect()
        if not some:
            break
        images = _covered(some, moved, fixed, a, b, side, low, step, block)
        together = min(TOGETHER, together * 2)
        for w, (i, wy, wx, _) in enumerate(some):
            cover = images.get(w, np.zeros((1, 1), np.int64))
            y, x = np.unravel_index(int(cover.argmax()), cover.shape)
            iou = float(cover[y, x] / max(1.0, sizes[i] + b.count - cover[y, x]))
            fit = (iou, -i, -(int(y) + wy * block), -(int(x) + wx * block))
            best = fit if best is None or fit > best else best
        last = some[-1]
        after = F.struct(-F.col("bound"), "id", "wy", "wx") > F.struct(F.lit(-last.bound), *(F.lit(last[c]).cast("long") for c in ("id", "wy", "wx")))
        left = windows.where(after)
    if best is None:
        return spark.createDataFrame([], schema)
    scale = low - best[1] * step
    return spark.createDataFrame([(scale, float(b.x - best[3] - a.x * scale), float(b.y - best[2] - a.y * scale), best[0])], schema)
