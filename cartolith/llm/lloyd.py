"""Centroid clustering by plain Lloyd rounds, in whole numbers only.

A component x becomes floor(SCALE * x). The centroids, a table of k rows at most, are broadcast; tasks compute squared
differences to each centroid in NumPy and take the nearest, the lowest number among equals. A task sums its vectors by
centroid, and groupBy merges the sums of all tasks; a centroid becomes the floor of its vectors' means, an empty one
stays. All sums are exact: a task's sums are cut into digits of base 2^40, whose columns are added as longs, so their
order and the number of tasks don't matter. Vectors with components beyond 2^27 are computed with Python's integers.

Vectors that are null, of another length, or have null or non-finite components take no part. Rows that repeat are
vectors each. The first centroids are the k vectors with the least hashes of their ids; rows of one id go by their
components in turn, those of a null id come last. With fewer vectors than k there are as many centroids as vectors, and
no vectors give no rows. Distances and their sums that pass a long are given as its largest value. Each round reads
the vectors anew, so they had better be a table. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import small_batches, written

#: Components of a vector, and what a component is multiplied by.
WIDTH, SCALE = 64, 64
#: Up to this size of components, squared distances of 64 of them fit a long.
SAFE = 1 << 27
#: Bits of a digit of sums; so many tasks' digits may be added as longs: 2^(63 - DIGIT).
DIGIT = 40
LONGEST = (1 << 63) - 1


def kept(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    numbers = F.transform(F.col(embedding), lambda x: x.cast("double"))
    sound = (F.size(embedding) == width) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).alias("vec_id"), numbers.alias("embedding"))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of a matrix of doubles: longs where all are within SAFE, else Python's integers."""
    if not values.size or np.abs(values).max() < SAFE // SCALE:
        return np.floor(values * SCALE).astype(np.int64)

    def one(x: float) -> int:
        top, bottom = x.as_integer_ratio()
        return top * SCALE // bottom

    return np.array([[one(float(x)) for x in row] for row in values], dtype=object)


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lowest number of a nearest centroid, and the squared distance to it, for each row of points."""
    if points.dtype != object and max((abs(c) for row in centroids for c in row), default=0) < SAFE:
        table = np.array(centroids, dtype=np.int64)
        best, at = np.full(len(points), LONGEST), np.zeros(len(points), dtype=np.int64)
    else:
        points, table = points.astype(object), np.array(centroids, dtype=object)
        best, at = np.full(len(points), None, dtype=object), np.zeros(len(points), dtype=np.int64)
    for k, centroid in enumerate(table):
        d = ((points - centroid) ** 2).sum(axis=1)
        less = np.ones(len(points), dtype=bool) if k == 0 else (d < best).astype(bool)
        best[less], at[less] = d[less], k
    return at, best


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([np.empty(0), *column]).reshape(len(column), width)


def digits(values: list[int]) -> list[list[int]]:
    """Rows of digits of base 2^DIGIT, least first; the last ones have the signs."""
    out = []
    while True:
        if all(-(1 << DIGIT) <= v < 1 << DIGIT for v in values):
            return [*out, values]
        out.append([v & ((1 << DIGIT) - 1) for v in values])
        values = [v >> DIGIT for v in values]


def _sums(centroids, width: int):
    """For each centroid with vectors in a task: (cluster, place of the digits, n, digits of each component's sum)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = [0] * len(centroids.value)
        sums = [[0] * width for _ in n]
        for frame in frames:
            points = whole(_matrix(frame["embedding"], width))
            at, _ = nearest(points, centroids.value)
            for k in np.unique(at).tolist():
                mine = points[at == k]
                n[k] += len(mine)
                sums[k] = [a + int(b) for a, b in zip(sums[k], mine.sum(axis=0), strict=True)]
        rows = [(k, place, n[k] if place == 0 else 0, part) for k in range(len(n)) if n[k] for place, part in enumerate(digits(sums[k]))]
        yield pd.DataFrame(rows, columns=["cluster", "place", "n", "sums"])

    return run


def _assign(centroids, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, d = nearest(whole(_matrix(frame["embedding"], width)), centroids.value)
            d = np.array([min(LONGEST, int(x)) for x in d]) if d.dtype == object else d
            yield frame[["vec_id"]].assign(cluster=at, distance=d)

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k least hashes of `seed:vec_id`, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = vectors.select(name.alias("x_name"), "embedding").orderBy(F.col("x_name").asc_nulls_last(), "embedding").limit(k)
    return [[int(x) for x in whole(np.array([r.embedding]))[0]] for r in least.collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after one round."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(centroids)
    parts = vectors.select("embedding").mapInPandas(_sums(sent, width), "cluster int, place int, n bigint, sums array<bigint>")
    total = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
    sent.unpersist()
    out = [list(c) for c in centroids]
    for k in {r.cluster for r in total}:
        mine = [r for r in total if r.cluster == k]
        n = sum(r.n for r in mine)
        out[k] = [sum(r.sums[i] << (DIGIT * r.place) for r in mine) // n for i in range(width)]
    return out


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), and the final centroids."""
    spark = rows.sparkSession
    small_batches(spark)
    vectors = kept(rows, vec_id, embedding, width)
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, width)
    sent = spark.sparkContext.broadcast(centroids)
    named = vectors.withColumn("vec_id", F.col("vec_id").cast("string"))  # pandas has no long that can be null
    assigned = named.mapInPandas(_assign(sent, width), "vec_id string, cluster int, distance bigint")
    assigned = written(assigned.withColumn("vec_id", F.col("vec_id").cast(vectors.schema["vec_id"].dataType)), "clusters")
    sent.unpersist()

    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    every = min(LONGEST, sum(sums.values()))
    about = [(i, min(LONGEST, sums[i]), every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in sums]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def report(rows: DataFrame) -> DataFrame:
    return cluster(rows)[0]


def _oracle(k: int = 16, rounds: int = 3, width: int = WIDTH) -> str:
    """DuckDB SQL for report(): one assignment and one mean a round."""
    steps = [
        f"""x_kept AS MATERIALIZED (SELECT row_number() OVER () AS x_row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v,
            row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x_place
        FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"x_long AS MATERIALIZED (SELECT x_row, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM x_kept)",
        f"x_c0 AS MATERIALIZED (SELECT x_place - 1 AS cluster, unnest(v) AS c, generate_subscripts(v, 1) AS d FROM x_kept WHERE x_place <= {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"x_d{r} AS (SELECT x_row, cluster, sum((x - c) * (x - c)) AS distance FROM x_long JOIN x_c{r} USING (d) GROUP BY x_row, cluster)")
        steps.append(f"x_a{r} AS MATERIALIZED (SELECT x_row, cluster, distance FROM x_d{r} QUALIFY row_number() OVER (PARTITION BY x_row ORDER BY distance, cluster) = 1)")
        if r < rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"x_m{r} AS (SELECT cluster, d, {mean} AS c FROM x_long JOIN x_a{r} USING (x_row) GROUP BY cluster, d)")
            steps.append(f"x_c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c, d FROM x_c{r} o LEFT JOIN x_m{r} m USING (cluster, d))")
    return f"""WITH {", ".join(steps)},
    x_n AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM x_c{rounds} GROUP BY cluster)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM x_a{rounds} JOIN x_kept USING (x_row) JOIN x_n USING (cluster)"""


ORACLE = _oracle()
