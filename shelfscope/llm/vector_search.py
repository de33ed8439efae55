"""Exact top-k search by inner product, pruned by segment statistics at several resolutions.

Vectors are whole numbers (see ``vectors``). Cut into segments, a vector has in each
segment of length L a mean m and a deviation s. The squared distance of two vectors is at
least the sum over segments of L((m-m')^2 + (s-s')^2), so their inner product, half of
what both squared norms exceed the distance by, is at most the sum of L(mm' + ss').
Starting with few long segments, then with shorter ones, pairs whose bound is below the
query's k-th best score so far go; what is left gets its exact score. Scores are exact at
every size, there is no cap on survivors.

On Spark: rows are dealt over blocks by a hash of id and vector (at most about
``BLOCK_ROWS`` rows each, so one id or one vector that holds a third of all rows spreads,
rows alike in both having been counted once before), and each block gets a copy of every
query. A task holds its block of rows and lets the queries stream through in tiles, so its
memory doesn't grow with the query set. Each block sends on the k best rows of each query,
and a ranking with a limit below its shuffle merges them. Nothing is broadcast and nothing
is collected but the number of rows.

Defined results: rows alike in id and vector count once; where an id has several
vectors, each is a candidate, and none of them is one for the others' queries; a null id
is a candidate that loses every tie and is never a query. Only vectors of the same length
meet. Unusable vectors take no part, so a query with one has no rows; a query with fewer
than k candidates gets all of them; an empty table gives an empty result. Columns of the
caller other than the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import small_batches, table
from shelfscope.llm.vectors import vector_rows, whole

#: Rows of a block at most (on average), and at least where there are tasks to fill.
BLOCK_ROWS, LEAST_ROWS = 65_536, 4_096
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16, 32)
#: Rows and queries of one tile.
TILE_ROWS, TILE_QUERIES = 4_096, 256
#: Share of a tile's pairs below which they are treated one by one.
SPARSE = 0.05

FOUND = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Each row's segment means and deviations, times the root of the segment's length, so
    that the product of two rows of them is the bound. Sums and squares are whole numbers,
    so a deviation is never below its true value by more than the last root's rounding."""
    ends = np.linspace(0, x.shape[1], segments + 1).astype(int)
    length = np.diff(ends)
    total = np.add.reduceat(x, ends[:-1], axis=1)
    spread = np.add.reduceat(x * x, ends[:-1], axis=1) * length - total * total
    return np.concatenate([total, np.sqrt(spread)], axis=1) / np.sqrt(np.tile(length, 2))


class Block:
    """The rows that one task searches."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, x: np.ndarray):
        self.ids, self.null, self.x = ids, null, x.astype(np.float64)
        self.levels = [s for s in LEVELS if s < x.shape[1]]
        self.stats = [statistics(x, s) for s in self.levels]
        self.norm = float(np.sqrt((self.x * self.x).sum(axis=1).max(initial=0)))

    def best(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, row's place, score) of the ``k`` best rows of each query."""
        stats = [statistics(q, s) for s in self.levels]
        q = q.astype(np.float64)
        slack = 1e-9 * self.norm * np.sqrt((q * q).sum(axis=1)) + 1e-6
        floor = np.full(len(q), -np.inf)
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for at in range(0, len(self.x), TILE_ROWS):
            tile = slice(at, at + TILE_ROWS)
            alive = (ids[:, None] != self.ids[None, tile]) | self.null[None, tile]
            if np.isfinite(floor).any():
                least = (floor - slack)[:, None]
                for a, b in zip(stats, self.stats, strict=True):
                    self._keep(alive, a, b[tile], least)
            i, j, score = self._scores(alive, q, self.x[tile], floor, k)
            held = self._merge(tuple(np.concatenate(p) for p in zip(held, (i, j + at, score), strict=True)), k)
            i, first, n = np.unique(held[0], return_index=True, return_counts=True)
            full = n == k
            floor[i[full]] = held[2][first[full] + k - 1]
        return held

    @staticmethod
    def _keep(alive: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> None:
        if alive.mean() > SPARSE:
            alive &= a @ b.T >= least
        else:
            i, j = np.nonzero(alive)
            alive[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= least[i, 0]

    @staticmethod
    def _scores(alive: np.ndarray, q: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int):
        """The surviving pairs that reach their query's floor, with exact scores."""
        if alive.mean() > SPARSE:
            s = np.where(alive, q @ x.T, -np.inf)
            if len(x) > k and not np.isfinite(floor).all():  # the tile's own k-th best is a floor, too
                floor = np.maximum(floor, np.partition(s, len(x) - k, axis=1)[:, len(x) - k])
            i, j = np.nonzero(alive & (s >= floor[:, None]))
            return i, j, s[i, j]
        i, j = np.nonzero(alive)
        s = np.einsum("ij,ij->i", q[i], x[j])
        good = s >= floor[i]
        return i[good], j[good], s[good]

    def _merge(self, found: tuple, k: int) -> tuple:
        i, j, score = found
        order = np.lexsort((self.ids[j], self.null[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < k], j[place < k], score[place < k]


def searcher(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block and length, a block's rows before its queries."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block = None, [], None
        for b in batches:
            group = list(zip(*(b.column(c).to_pylist() for c in ("block", "dim", "query")), strict=True))
            start = 0
            while start < len(group):
                end = start + 1
                while end < len(group) and group[end] == group[start]:
                    end += 1
                part, (number, dim, query) = b.slice(start, end - start), group[start]
                start = end
                if (number, dim) != at:
                    at, rows, block = (number, dim), [], None
                ids = part.column("vec_id")
                x = whole(part.column("vector"), dim) if dim else np.zeros((len(part), 0), np.int64)
                if not query:
                    rows.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), x))
                elif rows or block:
                    block = block or Block(*map(np.concatenate, zip(*rows, strict=True)))
                    rows = []
                    ids, marks = ids.to_numpy(), part.column("mark").to_numpy()
                    for f in range(0, len(x), TILE_QUERIES):
                        i, j, score = block.best(ids[f:f + TILE_QUERIES], x[f:f + TILE_QUERIES], k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[f + i]), pa.array(marks[f + i]), pa.array(block.ids[j], mask=block.null[j]),
                             pa.array(score.astype(np.int64))], schema=FOUND)
    return search


def top_k(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner product for
    each row of ``df`` for which ``queries``, a condition on ``vec_id``, holds."""
    spark = df.sparkSession
    v = vector_rows(df, vec_id=vec_id, vector=vector).distinct()
    n = v.count()
    blocks = max(-(-n // BLOCK_ROWS), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism), 1)
    v = v.select(F.size("vector").alias("dim"), "vec_id", F.xxhash64("vector").alias("mark"), "vector")
    rows = v.select(F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "*")
    asked = (v.where(queries & F.col("vec_id").isNotNull())
             .select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "*"))
    found = (rows.unionByName(asked).repartitionById(blocks, F.col("block"))
             .sortWithinPartitions("block", "dim", "query", "vec_id")
             .mapInArrow(searcher(k), "query_id long, mark long, vec_id long, score long"))
    w = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every row whose id is divisible by 50."""
    small_batches(spark)
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM v),
s AS (
  SELECT q.vec_id AS query_id, q.embedding AS asked, c.vec_id,
         CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END::BIGINT AS score
  FROM w q JOIN w c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
