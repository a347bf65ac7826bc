"""Chains of unit edges of any length: pieces within tiles, and the order of linked pieces.

A task holds the edges of one label, or one pair of labels, within one tile, and makes pieces of them: closed rings are
done, others end where the tile does. Pieces are linked by the vertices at their ends, and ranked() finds out which ones
follow each other by pointer jumping over rows: in each round a piece knows twice as many of its followers. Only a
ring's or an arc's own points meet in the end, as they are one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.session import written

#: Cells of a tile's side.
TILE = 512
#: So many links at most are followed by one task, a bound that is counted first.
FEW_LINKS = 1_000_000
_NOWHERE = (1 << 62)


def _leaders(node: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ranked() of arrays; following is -1 where there is none."""
    order = np.argsort(node)
    node, following = node[order], following[order]
    jump = np.where(following >= 0, np.searchsorted(node, following), -1)
    key = np.where(jump < 0, np.arange(len(node)), np.arange(len(node)) + len(node))  # ends come before all others
    off, span = np.zeros(len(node), np.int64), 1
    while True:
        goes = np.flatnonzero(jump >= 0)
        to = jump[goes]
        less = key[to] < key[goes]
        new_key, new_off, new_jump = key.copy(), off.copy(), jump.copy()
        new_key[goes[less]], new_off[goes[less]] = key[to[less]], off[to[less]] + span
        new_jump[goes] = jump[to]
        if not less.any():
            break
        key, off, jump, span = new_key, new_off, new_jump, span * 2
    back = np.empty(len(node), np.int64)
    back[order] = np.arange(len(node))
    return node[key % len(node)][back], off[back]


def ranked(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, leader, ahead): the end that following the links leads to, and how many links ahead it is.

    links: a written table of node and next (null: an end), one row a node, whole numbers from 0. On a ring, which has no end,
    the least node leads. Beyond `few` links, whose number is counted, rows are joined with those they lead to until
    nothing changes; the number of rounds is the binary logarithm of the longest chain.
    """
    if links.count() <= few:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column("node").to_numpy(), b.column("next").fill_null(-1).to_numpy(zero_copy_only=False)) for b in batches]
            if got:
                node, following = (np.concatenate(x) for x in zip(*got, strict=True))
                leader, ahead = _leaders(node, following)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(leader), pa.array(ahead)], ["node", "leader", "ahead"])

        return links.select(F.col("node").cast("long").alias("node"), F.col("next").cast("long").alias("next")).coalesce(1).mapInArrow(run, "node long, leader long, ahead long")
    end = F.when(F.col("next").isNull(), 0).otherwise(1)
    now, span = written(links.select("node", F.col("next").alias("jump"), F.struct(end.alias("kind"), F.col("node").alias("leader"), F.lit(0).cast("long").alias("ahead")).alias("best")), "ranks"), 1
    while True:
        there = now.select(F.col("node").alias("jump"), F.col("jump").alias("after"), F.col("best").alias("theirs"))
        theirs = F.struct(F.col("theirs.kind").alias("kind"), F.col("theirs.leader").alias("leader"), (F.col("theirs.ahead") + span).alias("ahead"))
        both = now.join(there, "jump", "left")
        less = F.col("theirs").isNotNull() & (F.struct("theirs.kind", "theirs.leader") < F.struct("best.kind", "best.leader"))
        new = written(both.select("node", F.col("after").alias("jump"), F.when(less, theirs).otherwise(F.col("best")).alias("best"), less.alias("moved")), "ranks")
        if new.where("moved").isEmpty():
            return now.select("node", "best.leader", "best.ahead")
        now, span = new.drop("moved"), span * 2


def _paths(following: list[int], heads: list[int]) -> list[tuple[bool, list[int]]]:
    """Walks from the heads on, and rings of what is left: (whether it is a ring, places in order)."""
    seen, out = bytearray(len(following)), []
    for closed, starts in ((False, heads), (True, range(len(following)))):
        for i in starts:
            if seen[i]:
                continue
            path = []
            while i >= 0 and not seen[i]:
                seen[i] = 1
                path.append(i)
                i = following[i]
            out.append((closed, path))
    return out


def _codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (y.astype(np.int64) << 32) + x


def straight(ring: np.ndarray) -> np.ndarray:
    """A closed ring without the points inside its straight runs, from its least point on."""
    body = ring[:-1]
    before, after = np.roll(body, 1, axis=0), np.roll(body, -1, axis=0)
    cross = (body[:, 0] - before[:, 0]) * (after[:, 1] - body[:, 1]) - (body[:, 1] - before[:, 1]) * (after[:, 0] - body[:, 0])
    body = body[cross != 0]
    body = np.roll(body, -np.lexsort((body[:, 1], body[:, 0]))[0], axis=0) if len(body) else body
    return np.vstack([body, body[:1]])


def _corners(line: np.ndarray) -> np.ndarray:
    """An open line of unit edges without the points inside its straight runs."""
    if len(line) < 3:
        return line
    step = np.diff(line, axis=0)
    return line[np.concatenate([[True], (step[1:] != step[:-1]).any(axis=1), [True]])]


def _sliced(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Points in a row as lists of (x, y) of so many each."""
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.float64)), pa.array(flat[:, 1].astype(np.float64))], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), points)


def lists(lines: list[np.ndarray]) -> pa.Array:
    """Lines of points as lists of (x, y)."""
    return _sliced(np.concatenate([np.empty((0, 2)), *lines]), np.array([len(x) for x in lines], np.int64))


def points_of(cell) -> np.ndarray:
    """The (x, y) of a list of points, an Arrow scalar."""
    points = cell.values
    return np.stack([points.field("x").to_numpy(), points.field("y").to_numpy()], axis=1)


#: area: the integral of x dy along a piece; want: the way of the piece before, where two of them come in; drop_x, drop_y: of its edges
#: that run down, the topmost and of these the leftmost.
RING_PIECE = "label int, closed boolean, x0 long, y0 long, want int, x1 long, y1 long, way int, area long, drop_x long, drop_y long, points array<struct<x:double,y:double>>"


def ring_pieces(group: pa.Table) -> pa.Table:
    """Pieces of the directed unit edges (label, x0, y0, x1, y1) of a label in a tile, which keep it on their right hand.

    Where two cells of the label touch at a corner only, two edges come in and two go out; each turns right, so that the cells stay apart.
    """
    x0, y0, x1, y1 = (group.column(c).to_numpy().astype(np.int64) for c in ("x0", "y0", "x1", "y1"))
    way = np.select([x1 > x0, y1 > y0, x1 < x0], [0, 1, 2], 3)  # east, south, west, north, as y grows downwards: one more is a turn to the right
    order = np.lexsort((way, _codes(x0, y0)))
    x0, y0, x1, y1, way = (v[order] for v in (x0, y0, x1, y1, way))
    start, end = _codes(x0, y0), _codes(x1, y1)
    low, high = np.searchsorted(start, end), np.searchsorted(start, end, side="right")
    second = np.minimum(low + 1, len(start) - 1)
    turn = (high - low == 2) & (way[second] == (way + 1) % 4)
    following = np.where(high == low, -1, np.where(turn, second, low))
    led = np.zeros(len(start), bool)
    led[following[following >= 0]] = True
    twice = np.searchsorted(start, start, side="right") - np.searchsorted(start, start) == 2
    paths = _paths(following.tolist(), np.flatnonzero(~led).tolist())
    closed = np.array([c for c, _ in paths])
    sizes = np.array([len(p) for _, p in paths])
    at = np.concatenate([np.array(p) for _, p in paths])
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    before = np.roll(at, 1)
    before[first] = at[last]
    corner = way[at] != way[before]
    corner[first[~closed]] = True
    down = np.where(way[at] == 1, _codes(x0[at], y0[at]), _NOWHERE)  # row by row
    drop = np.minimum.reduceat(down, first)
    area = np.add.reduceat(x0[at] * (y1[at] - y0[at]), first)
    # a ring's corners from its least one on, and that one again; a line's corners and its end
    spot = np.flatnonzero(corner)
    path = np.searchsorted(last, spot)
    px, py = x0[at[spot]], y0[at[spot]]
    begin = np.searchsorted(path, np.arange(len(paths)))
    count = np.diff(np.append(begin, len(path)))
    least = np.empty(len(paths), np.int64)
    order = np.lexsort((py, px, path))
    least[:] = order[begin]
    turn = np.where(closed[path], (np.arange(len(path)) - least[path]) % count[path], np.arange(len(path)))
    order = np.lexsort((turn, path))
    px, py = px[order], py[order]
    end = np.where(closed, 0, at[last])
    ex, ey = np.where(closed, px[begin], x1[end]), np.where(closed, py[begin], y1[end])
    close = begin + count
    flat = np.stack([np.insert(px, close, ex), np.insert(py, close, ey)], axis=1)
    want = np.where(twice[at[first]] & ~closed, (way[at[first]] + 3) % 4, -1)
    nothing = drop == _NOWHERE
    drop_x = ((drop + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
    columns = [
        pa.array(closed), pa.array(x0[at[first]]), pa.array(y0[at[first]]), pa.array(want, pa.int32(), mask=want < 0), pa.array(x1[at[last]]), pa.array(y1[at[last]]), pa.array(way[at[last]], pa.int32()),
        pa.array(area), pa.array(drop_x, mask=nothing), pa.array((drop - drop_x) >> 32, mask=nothing),
    ]
    label = pa.array(np.full(len(paths), group.column("label")[0].as_py()), pa.int32())
    names = ["label", "closed", "x0", "y0", "want", "x1", "y1", "way", "area", "drop_x", "drop_y", "points"]
    return pa.table([label, *columns, _sliced(flat, count + 1)], names)


ARC_PIECE = "a int, b int, closed boolean, x0 long, y0 long, open0 boolean, x1 long, y1 long, open1 boolean, points array<struct<x:double,y:double>>"


def arc_pieces(tile: int):
    """Pieces of the unit segments (a, b, x0, y0, x1, y1) of a pair in a tile.

    They run between points where other than two segments of the pair meet; where a tile's side is, a piece has an open
    end, as there may be more segments beyond it.
    """

    def run(group: pa.Table) -> pa.Table:
        x0, y0, x1, y1 = (group.column(c).to_numpy().astype(np.int64) for c in ("x0", "y0", "x1", "y1"))
        n = len(x0)
        x, y = np.concatenate([x0, x1]), np.concatenate([y0, y1])  # end i of segment i, end n + i
        side = (x % tile == 0) | (y % tile == 0)
        codes = _codes(x, y)
        order = np.argsort(codes, kind="stable")
        sorted_ = codes[order]
        degree = np.searchsorted(sorted_, codes, side="right") - np.searchsorted(sorted_, codes)
        pair = np.full(2 * n, -1)
        two = order[(degree[order] == 2) & ~side[order]]
        pair[two[0::2]], pair[two[1::2]] = two[1::2], two[0::2]
        # an end is left by its segment: a walk goes to the other end, and on to that one's pair
        other = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        following = pair[other].tolist()
        rows, lines, used = [], [], bytearray(n)
        for closed, starts in ((False, np.flatnonzero(pair < 0)), (True, np.arange(2 * n))):
            for i in starts.tolist():
                if used[i % n]:
                    continue
                path = [i]
                while i >= 0 and not used[i % n]:
                    used[i % n] = 1
                    path.append(other[i])
                    i = following[i]
                at = np.array(path)
                rows.append((closed, x[at[0]], y[at[0]], bool(side[at[0]]) and not closed, x[at[-1]], y[at[-1]], bool(side[at[-1]]) and not closed))
                line = np.stack([x[at], y[at]], axis=1)
                lines.append(settled(straight(line)) if closed else _corners(line))
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
        a, b = (pa.array([group.column(c)[0].as_py()] * len(rows), pa.int32()) for c in ("a", "b"))
        names = ["a", "b", "closed", "x0", "y0", "open0", "x1", "y1", "open1", "points"]
        return pa.table([a, b, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), lists(lines)], names)

    return run


def settled(line: np.ndarray) -> np.ndarray:
    """A line from its lesser end on; of a closed one, the first of its points stays and the lesser of its neighbours follows."""
    first, last = (line[1], line[-2]) if (line[0] == line[-1]).all() else (line[0], line[-1])
    return line if tuple(first) <= tuple(last) else line[::-1]
