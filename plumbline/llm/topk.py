"""Exact top-k inner products by no-random-access aggregation (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SCALE = 1024
TOP = 10
#: Queries divide by this number.
QUERY_STEP = 100
#: Vectors whose lists are read together, and queries that meet them at a time, about.
BLOCK = 1024
PORTION = 1024
#: Queries whose bounds are held together.
TOGETHER = 256
#: Share of a block that may be left when its final scores are resolved.
FEW = 0.05
#: The first bounds are taken when one in so many entries of the lists was read.
FIRST = 4

SCORES = "query_id long, vec_id long, score long"


class SortedLists:
    """One list per dimension, sorted by component, read from either end."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        order = np.argsort(-values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0).astype(np.float64)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(values))[:, None], axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, ...]:
        """What ``depth`` entries of every list, read from its upper and from its lower
        end, tell of every vector: its components over the list's other end and over
        the last entry read, zero where it was not met; and these two ends."""
        n, last = len(self.values), np.concatenate([self.sorted[-1], self.sorted[0]])
        reached = np.concatenate([self.sorted[depth - 1], self.sorted[n - depth]])
        met = np.concatenate([self.rank < depth, self.rank >= n - depth], axis=1)
        both = np.concatenate([self.values, self.values], axis=1)
        return np.where(met, both - last, 0.0), np.where(met, both - reached, 0.0), last, reached

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of the ``k`` best for each of ``queries``, but for
        the query's id in ``own``.

        Lists are read from the end that scores higher, in rounds that double the
        depth, for all queries together. A vector's score is bounded from below and
        above by what was read of it and by the ends of the lists that it was not yet
        met in. A query is done when few vectors can still be among the best; their
        final scores are then resolved. Ties go to the smaller id.
        """
        n, found = len(self.values), [[np.empty(0, np.int64)] * 3]
        # Positive components read a list from its upper end, negative ones from its lower.
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(np.float64)
        # Bounds of scores beyond 2**53 are rounded by less than this.
        slop = np.abs(signed) @ np.tile(np.abs(self.sorted[[0, -1]]).max(axis=0), 2) * 1e-12
        asked, depth = np.arange(len(queries)), max(1, n // FIRST) if n > k + 1 else n
        while len(asked):
            q, other = signed[asked], own[asked, None] != self.ids
            if n > k + 1:
                over_last, over_reached, last, reached = self.read(depth)
                lower = q @ over_last.T + (q @ last)[:, None]
                upper = q @ over_reached.T + (q @ reached)[:, None] if depth < n else lower
                kth = np.partition(np.where(other, lower, -np.inf), n - k, axis=1)[:, n - k]
                alive = upper >= (kth - 2 * slop[asked])[:, None]
            else:
                alive = np.ones((len(asked), n), bool)
            done = (alive.sum(axis=1) <= max(4 * k, FEW * n)) | (depth == n)
            number, at = np.nonzero(alive[done] & other[done])
            number = asked[done][number]
            score = np.einsum("ij,ij->i", self.values[at], queries[number])
            best = np.lexsort((self.ids[at], -score, number))
            place = np.arange(len(best)) - np.searchsorted(number[best], number[best])
            best = best[place < k]
            found.append([number[best], self.ids[at][best], score[best]])
            asked, depth = asked[~done], min(n, 2 * depth)
        return tuple(map(np.concatenate, zip(*found)))


def _searched(k: int):
    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64)] * 3]
        if vectors.num_rows and asked.num_rows:
            (ids, values), (own, queries) = _matrix(vectors), _matrix(asked)
            lists = SortedLists(ids, values)
            for low in range(0, len(own), TOGETHER):
                part = slice(low, low + TOGETHER)
                number, got, score = lists.top(queries[part], own[part], k)
                found.append([own[part][number], got, score])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    return run


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["vector"].combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return table["id"].to_numpy(), values.reshape(table.num_rows, -1)


def search(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP, query_step: int = QUERY_STEP
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id divides by
    ``query_step`` the ``k`` best of all other rows.

    Vectors that are NULL, empty or hold NULL or non-finite components, and rows
    without an id, take no part; vectors of different lengths do not meet. Rows
    that share an id are candidates each and asked once. An empty table gives an
    empty result. Other columns are not read.

    Queries and vectors are dealt into portions and blocks of bounded size by
    hash; every block meets every portion in a task of its own, and only the best
    of each meeting are shuffled on.
    """
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    valid = vectors.where(F.col(key).isNotNull() & (F.size(x) > 0) & sound)
    valid = valid.select(F.col(key).cast("long").alias("id"), whole.alias("vector"), F.size(x).alias("dims"))
    asked = valid.where(F.pmod("id", F.lit(query_step)) == 0).dropDuplicates(["id", "dims"])
    # Both counts come from the key column alone.
    rows, queries = vectors.agg(
        F.count(key), F.count(F.when(F.pmod(F.col(key), F.lit(query_step)) == 0, 1))
    ).first()
    blocks, portions = -(-rows // BLOCK) or 1, -(-queries // PORTION) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    portion = F.pmod(F.xxhash64("id"), F.lit(portions))
    left = valid.withColumn("block", block).withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
    right = asked.withColumn("portion", portion).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = ["block", "portion", "dims"]
    left = left.withColumns({c: F.col(c).cast("long") for c in meet})
    right = right.withColumns({c: F.col(c).cast("long") for c in meet})
    met = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(_searched(k), SCORES)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
