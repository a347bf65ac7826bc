"""Nearest neighbours by inner product, over vectors quantised with a score-aware loss.

A vector is cut into pairs of components, each replaced by one of 16 codewords: four bits a pair. The loss weighs the
part of the error that is parallel to the vector more than the rest, for it is what changes large inner products; codes
are chosen by coordinate descent on that loss, codewords solve its normal equations. Codebooks are fitted on a bounded
random sample; all vectors are coded, and dealt into parts. A query's table of 16 products for each pair scores codes by
look-ups, two pairs at a time. A part's best are rescored with the original vectors in double precision, and only such
scores are compared between parts.

Queries are a stated set. They are a table too, which meets each part once: no task holds more than a part's codes and
vectors and TOGETHER queries, and neither goes through the driver.

Vectors that are null or zero, have null or non-finite components, or another length than most (ties: than the longest
of the commonest) take no part. Equal scores go to the smaller id; rows with the query's own id are no candidates, and
rows that repeat are candidates each. A vec_id asks once: of its vectors the least, by their components in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import written

SAMPLE = 20_000
#: Rows of a part, and parts whose results meet in one step.
PART, GROUPED = 1 << 16, 64
#: Inner products from this share of the norms on are the ones whose errors matter.
THRESHOLD = 0.2
#: Rows of a part that are rescored for each query, rows that are scored together, and queries.
RESCORED, ROWS, TOGETHER = 96, 8192, 256


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    numbers = F.transform(F.col(embedding), lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numbers, lambda x: x != 0), F.lit(False))
    good = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & sound).select(F.col(vec_id).cast("bigint").alias("vec_id"), numbers.alias("embedding"))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("embedding") == (sizes.d if sizes else 0))


@dataclass
class Codebook:
    """words: pairs by 16 codewords by components of a pair; eta: weight of parallel errors."""

    words: np.ndarray
    eta: float

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 8, pair: int = 2) -> Codebook:
        d = x.shape[1] + (-x.shape[1]) % (2 * pair)
        x = np.hstack([x, np.zeros((len(x), d - x.shape[1]))])
        eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        parts = x.reshape(len(x), d // pair, pair)
        rng = np.random.default_rng(0)
        words = parts[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy() + 1e-9 * rng.standard_normal((d // pair, 16, pair))
        book = cls(words, eta)
        codes = np.stack([((parts[:, s, None, :] - words[s]) ** 2).sum(axis=2).argmin(axis=1) for s in range(d // pair)], axis=1)
        unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
        for _ in range(rounds):
            codes = book._descend(parts, unit, codes, 1)
            along = book._along(parts, unit, codes)
            for s in range(d // pair):
                u, rest = unit[:, s], along.sum(axis=1) - along[:, s]
                is_code = (codes[:, s] == np.arange(16)[:, None]).astype(np.float64)
                n = is_code.sum(axis=1)
                lhs = n[:, None, None] * np.eye(pair) + (eta - 1) * (is_code @ (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)).reshape(16, pair, pair)
                rhs = is_code @ (parts[:, s] + (eta - 1) * u * (rest + (parts[:, s] * u).sum(axis=1))[:, None])
                words[s, n > 0] = np.linalg.solve(lhs[n > 0], rhs[n > 0][:, :, None])[:, :, 0]
                along[:, s] = ((parts[:, s] - words[s][codes[:, s]]) * u).sum(axis=1)
        return book

    def _along(self, parts: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each pair's error along the vector."""
        return np.stack([((parts[:, s] - self.words[s][codes[:, s]]) * unit[:, s]).sum(axis=1) for s in range(parts.shape[1])], axis=1)

    def _descend(self, parts: np.ndarray, unit: np.ndarray, codes: np.ndarray, rounds: int) -> np.ndarray:
        """Each pair's best code in turn, with the others as they are; the loss is written without what all codes share."""
        codes = codes.copy()
        along = self._along(parts, unit, codes)
        total = along.sum(axis=1)
        rows = np.arange(len(codes))
        for _ in range(rounds):
            for s in range(parts.shape[1]):
                p, u, w = parts[:, s], unit[:, s], self.words[s]
                mine, by_word = (p * u).sum(axis=1), u @ w.T
                parallel = (total - along[:, s] + mine)[:, None] - by_word
                loss = (w * w).sum(axis=1) - 2 * (p @ w.T) + (self.eta - 1) * parallel * parallel
                codes[:, s] = loss.argmin(axis=1)
                fresh = mine - by_word[rows, codes[:, s]]
                total += fresh - along[:, s]
                along[:, s] = fresh
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of vectors, two pairs a byte."""
        pairs, _, width = self.words.shape
        x = np.hstack([x, np.zeros((len(x), pairs * width - x.shape[1]))])
        parts = x.reshape(len(x), pairs, width)
        unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
        codes = np.stack([((w * w).sum(axis=1) - 2 * (parts[:, s] @ w.T)).argmin(axis=1) for s, w in enumerate(self.words)], axis=1)
        codes = self._descend(parts, unit, codes, 2)
        return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products by byte of code: bytes by 256 by queries."""
        pairs, _, width = self.words.shape
        q = np.hstack([q, np.zeros((len(q), pairs * width - q.shape[1]))]).reshape(len(q), pairs, width)
        each = np.einsum("scw,qsw->scq", self.words, q)
        return (each[0::2, :, None, :] + each[1::2, None, :, :]).reshape(pairs // 2, 256, len(q)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[Codebook | None, DataFrame, int]:
    """A codebook, the coded vectors in parts, written to the shared folder, and the number of parts.

    vectors: as from usable(). A part has PART rows at most, give or take, and is smaller where there are few rows, so
    that all cores have one.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    chosen = vectors.where(F.rand(11) < sample / total).limit(2 * sample) if total > sample else vectors
    found = chosen.toArrow()  # about `sample` rows, twice as many at most
    if not len(found):
        if total:
            raise RuntimeError(f"no row of {total} got into the sample")
        return None, vectors.withColumns({"code": F.lit(None).cast("binary"), "part": F.lit(0)}), 0
    book = Codebook.fit(_matrix(found.column("embedding").combine_chunks()))
    parts = -(-total // min(PART, max(ROWS, -(-total // spark.sparkContext.defaultParallelism))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                codes = book.encode(_matrix(part.column("embedding")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "code"])

    coded = vectors.mapInArrow(run, "vec_id bigint, embedding array<double>, code binary")
    return book, written(coded.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")), "codes"), parts


SCORED = "part int, query_id bigint, vec_id bigint, score double"


def search(book: Codebook, coded: DataFrame, parts: int, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest. queries: vec_id, embedding.

    A task gets whole parts, the codes of each before the queries, which stream by. The best of a part are k for each
    query; they meet in two steps, by groups of parts and then by query.
    """
    spark = coded.sparkSession
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.lit(None).cast("binary").alias("code"))
    rows = coded.select("part", F.lit(0).alias("kind"), "vec_id", "embedding", "code").unionByName(asked)
    dealt = rows.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            keys = batch.column("part").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                block, part = batch.slice(a, b - a), int(keys[a]) // 2
                if part != now:
                    now, held, ready = part, [], None
                vec, x = block.column("vec_id").to_numpy(), _matrix(block.column("embedding"))
                if keys[a] % 2 == 0:
                    code = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(vec), -1)
                    held.append((vec, x, code))
                elif held or ready:
                    ready = ready or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                    for at in range(0, len(vec), TOGETHER):
                        ids = vec[at : at + TOGETHER]
                        best, who = _scan(book, ids, x[at : at + TOGETHER], *ready, k)
                        row, col = np.nonzero(best > -np.inf)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), part, np.int32)), pa.array(ids[row]), pa.array(who[row, col]), pa.array(best[row, col])], ["part", "query_id", "vec_id", "score"])

    top = F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, k).alias("near")
    scored = dealt.mapInArrow(run, SCORED).select("part", "query_id", (-F.col("score")).alias("far"), "vec_id")
    if parts > GROUPED:
        some = scored.groupBy("query_id", F.floor(F.col("part") / GROUPED).alias("g")).agg(top)
        scored = some.select("query_id", F.explode("near").alias("n")).select("query_id", "n.far", "n.vec_id")
    near = scored.groupBy("query_id").agg(top)
    return near.select("query_id", F.posexplode("near").alias("at", "n")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score"))


def _scan(book: Codebook, ids: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of a part's k best for each query, -inf where there are fewer. Rows are in order of vec.

    The RESCORED rows of best scores by code, of all the part, are rescored with the vectors themselves.
    """
    tables = book.tables(q)
    few = min(RESCORED, len(vec))
    top, at = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
    own = np.searchsorted(vec, ids), np.searchsorted(vec, ids, "right")
    for a in range(0, len(vec), ROWS):
        b = min(len(vec), a + ROWS)
        score = np.zeros((b - a, len(ids)), np.float32)
        for byte in range(code.shape[1]):
            score += tables[byte][code[a:b, byte]]
        rank = np.ascontiguousarray(score.T).astype(np.float64) - np.arange(a, b) * 1e-12  # equal codes: smaller ids first
        for r in np.flatnonzero((own[0] < b) & (own[1] > a) & (own[0] < own[1])).tolist():
            rank[r, max(own[0][r], a) - a : min(own[1][r], b) - a] = -np.inf
        n = min(few, b - a)
        pick = np.argpartition(-rank, n - 1, axis=1)[:, :n] if n < b - a else np.broadcast_to(np.arange(b - a), rank.shape)
        top, at = np.hstack([top, np.take_along_axis(rank, pick, axis=1)]), np.hstack([at, pick + a])
        if top.shape[1] > few:
            best = np.argpartition(-top, few - 1, axis=1)[:, :few]
            top, at = np.take_along_axis(top, best, axis=1), np.take_along_axis(at, best, axis=1)
    exact = np.einsum("qrd,qd->qr", x[at], q)
    exact[top == -np.inf] = -np.inf
    names = vec[at]
    order = np.lexsort((names, -exact), axis=1)[:, :k]
    return np.take_along_axis(exact, order, axis=1), np.take_along_axis(names, order, axis=1)


def nearest(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of each vector whose vec_id is divisible by `every`, among all others."""
    book, coded, parts = index(usable(rows))
    if book is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(book, coded, parts, written(queries, "queries"), k)
