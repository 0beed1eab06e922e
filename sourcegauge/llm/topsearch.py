"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are put in an order of likeness and cut into ranges of ``BLOCK`` rows. A component of a query is a term; what it
can add to a score inside a block is at most its product with the block's largest (for a negative component, smallest)
value of that component, and the sum of these maxima bounds every score of the block. A query visits blocks from the highest bound
down and scores a block's rows through its forward index, the block's own vectors, until the next bound
falls below its k-th score; a block that could only reach that score is visited while it holds a smaller id.

Ranges of blocks form shards of at most about ``SHARD`` rows. A query first searches the shard it lies in, where
its likes are; the k-th score found there is its threshold in all shards from the start. Then every shard is kept in memory
by one task past which the queries stream. Only rows that reach a query's threshold leave a shard. No shard
depends on another; a lost one is computed again from written tables. Work is queries times shards, evenly dealt:
range borders include a row number, so equal vectors and equal ids are split as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import freeze
from .common import partitions
from .vectors import matrix, products, usable, whole

SCALE = 64
K = 20
#: Rows of a block, and of a shard at most (about: range borders come from samples).
BLOCK = 32
SHARD = 1 << 18
#: Vectors that put the others in order.
PIVOTS = 64
#: Queries handled at once, and blocks that a query visits before thresholds are renewed, at most.
QUERIES = 256
STEP = 64
#: Stands for a missing id or threshold: ids are compared after all others, thresholds lie below all scores.
NO_ID, NONE = 2**63 - 1, -(2**63)

_INDEXED = "shard int, block long, x_rid long, x_id long, x_query boolean, floor_score long, floor_id long, v array<int>"
_FOUND = "q_rid long, q_id long, x_id long, score long"


class Shard:
    """Blocks of consecutive rows with their term maxima and minima."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, rids: np.ndarray, size: int):
        self.v, self.ids, self.rids = v, ids, rids
        self.first = np.arange(0, len(v), size)
        self.end = np.append(self.first[1:], len(v))
        self.high = np.maximum.reduceat(v, self.first, axis=0)
        self.low = np.minimum.reduceat(v, self.first, axis=0)
        self.least = np.minimum.reduceat(ids, self.first)
        self.visited = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Summed term maxima of each block for each query."""
        return products(np.maximum(q, 0), self.high) + products(np.minimum(q, 0), self.low)

    def search(self, q: np.ndarray, rids: np.ndarray, k: int, score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row, rank) of the best k rows of each query that are not worse than its threshold (score, id)."""
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        score, least = score.copy(), least.copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        active, at, step = np.arange(len(q)), 0, 4
        while len(active) and at < len(self.first):
            blocks = order[active, at : at + step]
            reach = bounds[active[:, None], blocks]
            need = (reach > score[active, None]) | (reach == score[active, None]) & (self.least[blocks] <= least[active, None])
            which, column = np.nonzero(need)
            found = [best[:3]]
            if len(which):
                who, what = active[which], blocks[which, column]
                by = np.argsort(what, kind="stable")
                cuts = np.flatnonzero(np.diff(what[by])) + 1
                for part in np.split(by, cuts):
                    b, asked = what[part[0]], who[part]
                    a, z = self.first[b], self.end[b]
                    got = products(q[asked], self.v[a:z])
                    good = (got > score[asked, None]) | (got == score[asked, None]) & (self.ids[a:z] <= least[asked, None])
                    good &= rids[asked, None] != self.rids[a:z]
                    i, j = np.nonzero(good)
                    found.append((asked[i], got[i, j], a + j))
                self.visited += len(which)
            best = self._best(found, k)
            # The k-th of a query is its new threshold.
            last = best[3] == k - 1
            score[best[0][last]], least[best[0][last]] = best[1][last], self.ids[best[2][last]]
            at, step = at + step, min(2 * step, STEP)
            if at < len(self.first):
                active = active[bounds[active, order[active, at]] >= score[active]]
        return best

    def _best(self, found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        who, score, row = (np.concatenate([f[i] for f in found]) for i in range(3))
        by = np.lexsort((self.rids[row], self.ids[row], -score, who))
        who, score, row = who[by], score[by], row[by]
        begins = np.append(True, who[1:] != who[:-1])[: len(who)]
        rank = np.arange(len(who)) - np.maximum.accumulate(np.where(begins, np.arange(len(who)), 0))
        kept = rank < k
        return who[kept], score[kept], row[kept], rank[kept]


def _order(pivots: list[list[int]]):
    """Adds the two pivots most like a vector as its place in the order of likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.zeros((len(pivots), max(map(len, pivots), default=0)), np.int64)
        for i, x in enumerate(pivots):
            p[i, : len(x)] = x
        norms = np.sqrt((p.astype(float) ** 2).sum(axis=1)) + 1e-9
        for batch in batches:
            near = np.argsort(-products(matrix(batch.column("v")), p) / norms, axis=1, kind="stable")[:, :2]
            place = near[:, 0] * len(pivots) + near[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int32())], [*batch.schema.names, "place"])

    return run


def _index(k: int, block: int):
    """Turns a range of rows into a shard and gives its own queries their thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        number = TaskContext.get().partitionId()
        v, ids, rids, asked = matrix(rows["v"]), rows["x_id"].to_numpy(), rows["x_rid"].to_numpy(), rows["x_query"].to_numpy()
        shard = Shard(v, ids, rids, block)
        score, least = np.full(len(v), NONE), np.full(len(v), NO_ID)
        queries = np.flatnonzero(asked)
        for i in range(0, len(queries), QUERIES):
            part = queries[i : i + QUERIES]
            who, got, row, rank = shard.search(v[part], rids[part], k, score[part], least[part])
            last = rank == k - 1
            score[part[who[last]]], least[part[who[last]]] = got[last], ids[row[last]]
        table = pa.table([
            pa.array(np.full(len(v), number), pa.int32()), pa.array(np.arange(len(v)) // block), rows["x_rid"], rows["x_id"], rows["x_query"],
            pa.array(score), pa.array(least), rows["v"]], names=[c.split(" ")[0] for c in _INDEXED.split(", ")])
        yield from table.to_batches(10_000)

    return run


def _search(k: int, block: int):
    """Rows of a shard come first, in block order, then the queries one batch after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, number = None, None
        for batch in batches:
            of, query = batch.column("shard").to_numpy(), batch.column("as_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (query[1:] != query[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(of)]):
                rows = batch.slice(a, z - a)
                if not z > a:
                    continue
                if not query[a]:
                    if of[a] != number:
                        held, number = [], of[a]
                    held, shard = [*held, rows], None
                    continue
                if of[a] != number:  # a shard without rows
                    continue
                if shard is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    shard, held = Shard(matrix(t["v"]), t["x_id"].to_numpy(), t["x_rid"].to_numpy(), block), []
                for i in range(0, rows.num_rows, QUERIES):
                    part = rows.slice(i, QUERIES)
                    rids = part.column("x_rid").to_numpy()
                    who, got, row, _ = shard.search(matrix(part.column("v")), rids, k, part.column("floor_score").to_numpy(), part.column("floor_id").to_numpy())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rids[who]), pa.array(part.column("x_id").to_numpy()[who]), pa.array(shard.ids[row]), pa.array(got)],
                        [c.split(" ")[0] for c in _FOUND.split(", ")])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding, any others) that ``is_query``, the k rows of highest score.

    A score is the inner product of floor(scale * x) over all components; components that the shorter vector lacks count as zero.
    Candidates are all rows but the query's own, so rows that repeat an id are candidates and queries of their own. Ties go
    to the smaller vec_id, null ids (and the largest long, which stands for them) last, and to the row read first. With fewer than k candidates
    all are returned. Vectors that are null or hold nulls, NaN or infinities take no part; an empty one scores 0. Components are held within
    ±2**27. A null ``is_query`` counts as false. Other columns are not read unless by ``is_query``. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    taken = vectors.where(usable()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("x_id"), F.coalesce(is_query, F.lit(False)).alias("x_query"), whole("embedding", scale).alias("v"))
    pivots = [r.v for r in taken.select("v", F.xxhash64("x_id").alias("h")).orderBy("h", "v").limit(PIVOTS).collect()]
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = taken.mapInArrow(_order(pivots), "x_id long, x_query boolean, v array<int>, place int")
    prepared = freeze(placed.withColumn("x_rid", F.monotonically_increasing_id()), "search-rows")
    n = max(partitions(spark), -(-prepared.count() // shard))
    ranged = prepared.repartitionByRange(n, "place", "x_rid").sortWithinPartitions("place", "x_rid")
    indexed = freeze(ranged.mapInArrow(_index(k, block), _INDEXED), "search-shards")

    shards = indexed.agg(F.max("shard")).first()[0] + 1
    rows = indexed.withColumn("as_query", F.lit(False))
    # Every query goes to every shard: the stated query set against all rows.
    queries = indexed.where("x_query").drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("as_query", F.lit(True))
    tiles = rows.unionByName(queries).repartitionById(shards, "shard").sortWithinPartitions("shard", "as_query", "block", "x_rid")
    found = tiles.mapInArrow(_search(k, block), _FOUND)
    best = W.partitionBy("q_rid").orderBy(F.col("score").desc(), "x_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.nullif("q_id", F.lit(NO_ID)).alias("query_id"), "rank", F.nullif("x_id", F.lit(NO_ID)).alias("vec_id"), "score")
