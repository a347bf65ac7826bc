"""Array kernels over shapes and strokes, each on its own row: rasters, strokes on the grid, inner points, fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions.geometry import RING

#: Lists of points as Arrow has them.
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _rowwise(df: DataFrame, keep: list[str], read: str, name: str, kind: str, made: pa.DataType, f: Callable) -> DataFrame:
    """df's `keep` columns and f(value) of each row's `read` column as `name`, of SQL type `kind` and Arrow type `made`.

    Values come as Arrow lists: pandas can't hold lists of lists of unlike lengths.
    """
    kinds = {c.name: c.dataType.simpleString() for c in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)  # one shape at a time is held as Python lists
                out = pa.array([f(row.column(read)[0].as_py())], made)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in keep), out], [*keep, name])

    return df.select(*dict.fromkeys([*keep, read])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` {kind}"]))


def grid_line(points: np.ndarray, step: float = 1.0) -> np.ndarray:
    """Grid points on a polyline in steps to one of eight neighbours, without those inside straight runs.

    Halves snap upward. A step goes along an axis, or both, as the doubled error of Bresenham's line has it.
    """
    if len(points) < 2:
        return points
    snapped = np.floor(points / step + 0.5).astype(np.int64)
    line = [tuple(snapped[0])]
    for (x, y), (tx, ty) in zip(snapped[:-1].tolist(), snapped[1:].tolist(), strict=True):
        dx, dy = abs(tx - x), abs(ty - y)
        sx, sy, error = (1 if x < tx else -1), (1 if y < ty else -1), dx - dy
        while (x, y) != (tx, ty):
            twice = 2 * error
            if twice > -dy:
                error, x = error - dy, x + sx
            if twice < dx:
                error, y = error + dx, y + sy
            line.append((x, y))
    line = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
    kept = line[:1]
    for here, after in zip(line[1:-1], line[2:], strict=False):
        ax, ay, bx, by = here[0] - kept[-1][0], here[1] - kept[-1][1], after[0] - here[0], after[1] - here[1]
        if ax * by - ay * bx or ax * bx + ay * by <= 0:
            kept.append(here)
    return np.array(kept + line[-1:] if len(line) > 1 else kept, float) * step


def grid_lines(strokes: DataFrame, key: str, points: str = "points", step: float = 1.0) -> DataFrame:
    def f(stroke: list[dict]) -> list[dict]:
        return [{"x": x, "y": y} for x, y in grid_line(_array(stroke), step).tolist()]

    return _rowwise(strokes, [key], points, "line", RING, POINTS, f)


def row_spans(rings: list[np.ndarray], y: int) -> list[tuple[int, int]]:
    """Cells (first, last) of a grid row whose centres are inside rings, by the even-odd rule."""
    cuts: list[float] = []
    for ring in rings:
        x0, y0, x1, y1 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
        hit = (y0 > y + 0.5) != (y1 > y + 0.5)
        cuts += ((x1 - x0) * (y + 0.5 - y0) / np.where(y1 == y0, 1, y1 - y0) + x0)[hit].tolist()
    cuts.sort()
    spans = [(int(np.ceil(a - 0.5)), int(np.ceil(b - 0.5)) - 1) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    return [s for s in spans if s[0] <= s[1]]


def rasterized(shapes: DataFrame, key: str = "id", shape: str = "shape") -> DataFrame:
    """(key, x, y) of the cells whose centres a shape holds; rows are cut by scan lines, so large shapes stream.

    Rings are closed; a ring that crosses itself is filled by the even-odd rule.
    """
    kinds = {c.name: c.dataType.simpleString() for c in shapes.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rings = [_array(r) for p in batch.column(shape)[i].as_py() or [] for r in p if len(r) >= 3]
                if rings:
                    low, high = min(r[:, 1].min() for r in rings), max(r[:, 1].max() for r in rings)
                    rows = [(y, a, b) for y in range(int(np.floor(low)), int(np.ceil(high)) + 1) for a, b in row_spans(rings, y)]
                    names = batch.column(key).take(pa.array([i] * len(rows), pa.int32()))
                    yield pa.RecordBatch.from_arrays([names, *(pa.array([r[k] for r in rows], pa.int32()) for k in range(3))], [key, "y", "a", "b"])

    spans = shapes.select(key, shape).mapInArrow(run, f"`{key}` {kinds[key]}, y int, a int, b int")
    return spans.select(key, F.explode(F.sequence("a", "b")).alias("x"), "y")


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rings' edges in one: starts, steps and squared lengths (1 for those of none)."""
    a = np.vstack([r[:-1] for r in rings])
    d = np.vstack([r[1:] for r in rings]) - a
    length = (d**2).sum(axis=1)
    return a, d, np.where(length == 0, 1, length)


class EdgeIndex:
    """Distances to an outline of many edges: they lie in blocks of EDGES that are near each other, and a block's box says how near
    its edges can be, and whether a ray to the right can cross them."""

    EDGES = 64

    def __init__(self, rings: list[np.ndarray]) -> None:
        a, d, length = _edges(rings)
        middle = a + d / 2
        low, high = middle.min(axis=0), middle.max(axis=0)
        at = ((middle - low) / np.maximum(high - low, 1e-300) * 65535).astype(np.uint64)
        order = np.argsort(_interleaved(at[:, 0]) | _interleaved(at[:, 1]) << np.uint64(1), kind="stable")
        self.a, self.d, self.length = a[order], d[order], length[order]
        starts = np.arange(0, len(a), self.EDGES)
        b = self.a + self.d
        self.low = np.minimum.reduceat(np.minimum(self.a, b), starts)
        self.high = np.maximum.reduceat(np.maximum(self.a, b), starts)

    def _edges_of(self, blocks: np.ndarray) -> np.ndarray:
        at = (blocks[:, None] * self.EDGES + np.arange(self.EDGES)).ravel()
        return at[at < len(self.a)]

    def distance(self, x: float, y: float) -> float:
        """Distance to the outline, negative outside."""
        here = np.array([x, y])
        gap = np.hypot(*np.maximum(0, np.maximum(self.low - here, here - self.high)).T)
        order, best, k = np.argsort(gap), np.inf, 0
        while k < len(order) and gap[order[k]] <= best:
            at = self._edges_of(order[k : k + 4])
            rel, d = here - self.a[at], self.d[at]
            t = np.clip((rel * d).sum(axis=1) / self.length[at], 0, 1)
            best, k = min(best, float(np.hypot(*(rel - t[:, None] * d).T).min())), k + 4
        at = self._edges_of(np.flatnonzero((self.low[:, 1] <= y) & (self.high[:, 1] >= y) & (self.high[:, 0] >= x)))
        rel, d = here - self.a[at], self.d[at]
        cut = (rel[:, 1] < 0) != (rel[:, 1] < d[:, 1])
        crossed = rel[cut, 0] < d[cut, 0] * rel[cut, 1] / d[cut, 1]
        return best if crossed.sum() % 2 else -best


def _interleaved(x: np.ndarray) -> np.ndarray:
    """The lowest 16 bits, each with a zero before it."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


#: Pairs of a place and an edge that are looked at together.
PAIRS = 1 << 18


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, in a row."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + count, count)


def _batches(count: np.ndarray) -> Iterator[slice]:
    """Slices of rows that have PAIRS pairs at most together, or are one row."""
    end, a = np.cumsum(count), 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PAIRS, side="right")))
        yield slice(a, b)
        a = b


class Rays:
    """Whether places are inside rings, by the even-odd rule: edges lie in strips across the shorter side of their box, and a place
    meets those of its strip."""

    def __init__(self, a: np.ndarray, d: np.ndarray) -> None:
        wide, tall = np.ptp(a, axis=0)
        self.along = 0 if wide <= tall else 1
        rises = d[:, 1 - self.along] != 0
        self.u, self.v, self.du, self.dv = a[rises, self.along], a[rises, 1 - self.along], d[rises, self.along], d[rises, 1 - self.along]
        low, high = np.minimum(self.v, self.v + self.dv), np.maximum(self.v, self.v + self.dv)
        self.low = low.min(initial=np.inf)
        self.side = np.abs(self.dv).mean() if len(low) else 1.0
        first = np.floor((low - self.low) / self.side).astype(np.int64)
        count = np.floor((high - self.low) / self.side).astype(np.int64) - first + 1
        strip = _runs(first, count)
        order = np.argsort(strip, kind="stable")
        self.edges = np.repeat(np.arange(len(first), dtype=np.int32), count)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(strip, minlength=1))])

    def inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u, v = (x, y) if self.along == 0 else (y, x)
        if not len(self.v):
            return np.zeros(len(u), bool)
        strip = np.floor((v - self.low) / self.side)
        there = (strip >= 0) & (strip < len(self.starts) - 1)
        strip = np.where(there, strip, 0).astype(np.int64)
        count = np.where(there, self.starts[strip + 1] - self.starts[strip], 0)
        out = np.zeros(len(u), bool)
        for s in _batches(count):
            e, q = self.edges[_runs(self.starts[strip[s]], count[s])], np.repeat(np.arange(s.stop - s.start), count[s])
            rise = v[s][q] - self.v[e]
            cut = np.flatnonzero((rise < 0) != (rise < self.dv[e]))
            e, q = e[cut], q[cut]
            right = u[s][q] - self.u[e] < self.du[e] * rise[cut] / self.dv[e]
            out[s] = np.bincount(q[right], minlength=s.stop - s.start) % 2 == 1
        return out


def deepest_point(rings: list[np.ndarray], tolerance: float = 0.05) -> tuple[float, float, float]:
    """(x, y, clearance) of the point farthest inside a polygon, by halving boxes that may still hold a better one.

    Many boxes are halved at once. A box keeps the edges that can be the nearest one to any of its points: with a distance D at its
    centre and a radius r, those within D + 2r of the centre; its parts look among these only. The boxes of one step have one
    size; those that may hold most go first, so that few boxes wait, however many edges there are.
    """
    a, d, length = _edges(rings)
    rays = Rays(a, d)
    (x0, y0), (x1, y1) = rings[0].min(axis=0), rings[0].max(axis=0)

    def distances(x: np.ndarray, y: np.ndarray, edges: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each place those to its edges."""
        out, q = np.empty(len(edges)), np.repeat(np.arange(len(x), dtype=np.int32), count)
        for i in range(0, len(edges), PAIRS):
            s = slice(i, i + PAIRS)
            e = edges[s]
            rx, ry, dx, dy = x[q[s]] - a[e, 0], y[q[s]] - a[e, 1], d[e, 0], d[e, 1]
            t = np.clip((rx * dx + ry * dy) / length[e], 0, 1)
            out[s] = np.hypot(rx - t * dx, ry - t * dy)
        return out

    best = (-np.inf, 0.0, 0.0)

    def looked_at(x: np.ndarray, y: np.ndarray, edges: np.ndarray, count: np.ndarray, radius: float) -> tuple:
        """Boxes that may hold a better point, by falling bound: bounds, centres, their edges and the places where these begin."""
        nonlocal best
        gaps = distances(x, y, edges, count)
        near = np.minimum.reduceat(gaps, np.cumsum(count) - count)
        left = near + radius > best[0] + tolerance
        which = np.flatnonzero(left)
        clearance = np.where(rays.inside(x[which], y[which]), near[which], -near[which])
        if len(which) and clearance.max() > best[0]:
            i = int(clearance.argmax())
            best = (float(clearance[i]), float(x[which[i]]), float(y[which[i]]))
        bound = clearance + radius
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > best[0] + tolerance]
        which, bound = which[order], bound[order]
        close = gaps <= np.repeat(near + 2 * radius, count)
        kept = np.add.reduceat(close, np.cumsum(count) - count, dtype=np.int64)
        starts = np.cumsum(kept) - kept
        edges = edges[close][_runs(starts[which], kept[which])]
        return bound, x[which], y[which], edges, np.concatenate([[0], np.cumsum(kept[which])])

    hx, hy = max((x1 - x0) / 2, 1e-9), max((y1 - y0) / 2, 1e-9)
    all_ = np.arange(len(a), dtype=np.int32)
    waiting = [(hx, hy, *looked_at(np.array([(x0 + x1) / 2]), np.array([(y0 + y1) / 2]), all_, np.array([len(a)]), float(np.hypot(hx, hy))))]
    while waiting:
        hx, hy, bound, x, y, edges, starts = waiting.pop()
        n = int(np.searchsorted(-bound, -(best[0] + tolerance)))  # bounds fall
        if not n:
            continue
        some = min(n, max(1, int(np.searchsorted(starts, starts[0] + PAIRS, side="right")) - 1))
        if some < n:
            waiting.append((hx, hy, bound[some:n], x[some:n], y[some:n], edges, starts[some : n + 1]))
        mine, count = edges[starts[0] : starts[some]], np.diff(starts[: some + 1])
        steps_x, steps_y = (np.array([-0.5, 0.5]) if h > other * 0.75 else np.zeros(1) for h, other in ((hx, hy), (hy, hx)))
        dx, dy = (v.ravel() for v in np.meshgrid(steps_x * hx, steps_y * hy))
        hx, hy = hx * (0.5 if len(steps_x) > 1 else 1), hy * (0.5 if len(steps_y) > 1 else 1)
        found = looked_at(np.add.outer(dx, x[:some]).ravel(), np.add.outer(dy, y[:some]).ravel(), np.tile(mine, len(dx)), np.tile(count, len(dx)), float(np.hypot(hx, hy)))
        if len(found[0]):
            waiting.append((hx, hy, *found))
    return best[1], best[2], best[0]


def _polygons(shape: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shape's points, and the places where its rings, and among these its polygons, begin; each with the end."""
    polygons = shape.values
    rings = polygons.flatten()
    points = rings.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    starts = (np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]) for v in (rings, polygons))
    return xy, *starts


def _largest(shape: pa.ListScalar) -> list[np.ndarray]:
    """The rings of a shape's largest polygon."""
    xy, rings, polygons = _polygons(shape)
    cross = np.zeros(len(xy) + 1)
    cross[1:-1] = xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]
    cross[rings[:-1]] = 0  # from one ring to the next
    area = np.abs(np.add.reduceat(cross, rings[:-1])) / 2
    area[1:] *= -1
    hulls = polygons[:-1]
    area[hulls] = np.abs(area[hulls])
    at = int(np.add.reduceat(area, hulls).argmax())
    return [xy[rings[i] : rings[i + 1]] for i in range(polygons[at], polygons[at + 1])]


def inner_points(shapes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(id, x, y, clearance) of the deepest point of each shape's largest polygon. Shapes are dealt over the tasks, whatever files they come from."""
    kind = shapes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deepest_point(_largest(shape), tolerance) for shape in batch.column("shape")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))], ["id", "x", "y", "clearance"])

    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shapes.select("id", "shape").repartition(parts, "id").mapInArrow(run, f"id {kind}, x double, y double, clearance double")


def side_of_line(cells: DataFrame, line: list[tuple[float, float]], reach: float = 1e5) -> DataFrame:
    """cells with `part`: 1 on one side of an open line whose ends run on straight, 2 on the other.

    A line whose ends are nearer than 35 is a lasso: part 2 is what it encloses.
    """
    points = np.array(line, float)
    if len(points) >= 3 and np.hypot(*(points[0] - points[-1])) < 35:
        ring = np.vstack([points, points[:1]])
    else:
        head, tail = points[0] - points[min(4, len(points) - 1)], points[-1] - points[max(0, len(points) - 5)]
        head, tail = head / (np.hypot(*head) or 1), tail / (np.hypot(*tail) or 1)
        first, last = points[0] + head * reach, points[-1] + tail * reach
        a, b = np.arctan2(*(first - points.mean(axis=0))[::-1]), np.arctan2(*(last - points.mean(axis=0))[::-1])
        turn = (a - b) % (2 * np.pi)
        arc = [points.mean(axis=0) + 2 * reach * np.array([np.cos(b + turn * t), np.sin(b + turn * t)]) for t in np.linspace(0, 1, 65)]
        ring = np.vstack([first, points, last, arc, first])
    kinds = {c.name: c.dataType.simpleString() for c in cells.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = pdf["x"].to_numpy() + 0.5, pdf["y"].to_numpy() + 0.5
            inside = np.zeros(len(pdf), bool)
            for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
                if y0 != y1:
                    inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            yield pdf.assign(part=np.where(inside, 2, 1).astype(np.int32))

    return cells.mapInPandas(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "part int"]))


def shortest_link(first: np.ndarray, second: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Distance and ends of the shortest line between two rings that don't cross: from a corner of one to the other."""
    best = (np.inf, first[0], second[0])
    for swap, (corners, ring) in enumerate(((first, second), (second, first))):
        a, d = ring[:-1], ring[1:] - ring[:-1]
        length = (d**2).sum(axis=1)
        for p in corners:
            t = np.clip(((p - a) * d).sum(axis=1) / np.where(length == 0, 1, length), 0, 1)
            q = a + t[:, None] * d
            gap = np.hypot(*(q - p).T)
            i = int(gap.argmin())
            if gap[i] < best[0]:
                best = (float(gap[i]), q[i] if swap else p, p if swap else q[i])
    return best


def coast_link(end: np.ndarray, coast: np.ndarray, most: float = 8.0) -> np.ndarray:
    """The coast's point nearest to a border's end; an error if it is farther than `most`."""
    gap, _, there = shortest_link(np.vstack([end, end]), coast)
    if gap > most:
        raise ValueError(f"border end is {gap:.2f} from the coast; {most} at most")
    return there
