"""Compression of vectors into codes: each part of a vector becomes the index of the nearest entry of that part's codebook.

Entries are learned from the distinct parts, each with the number of its occurrences. Sorted parts are the leaves of a lexicographic
trie whose levels are the dimensions. A node carries the distances, summed over the dimensions so far, between its prefix and
all entries; its children add one dimension each, so parts with a common prefix share the sums along it. The trie is traversed depth
first down to subtrees of at most ``LEAVES`` leaves, and inside these one level at a time, which bounds memory by one
distance vector for each level above and each node of a subtree's level. Leaves take the argmin, and add their part times its number to their entry.

Distinct parts are found by one shuffle, counted before it, so copies of a vector cost nothing; they are written in sorted order
and each round reads contiguous runs. Tasks give one row of sums for each entry and batch; one row for each entry comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .common import partitions
from .vectors import lists_of, matrix, usable, whole

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LONGEST = 2**63 - 1
#: Leaves of a subtree that is expanded at once.
LEAVES = 256


class Trie:
    """The trie over the distinct rows of sorted parts, as flags of where prefixes change; nothing is built beyond that."""

    def __init__(self, parts: np.ndarray):
        changed = np.ones(parts.shape, bool)
        changed[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
        own = changed[:, -1]
        self.leaf = np.cumsum(own) - 1
        #: starts[i, d]: distinct row i begins a new prefix of d + 1 values.
        self.parts, self.starts = parts[own], changed[own]
        self.depth = parts.shape[1]
        #: Distance vectors computed so far.
        self.steps = 0

    def leaves(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of each row; of equally near entries the first."""
        n, columns = len(self.parts), np.ascontiguousarray(entries.T)
        nearest, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # Rows a to z agree in d values; ``summed`` has the distances over all but the last of these.
        stack = [(0, n, 0, np.zeros(len(entries), np.int64))] if n else []
        while stack:
            a, z, d, summed = stack.pop()
            if d:
                summed = summed + (columns[d - 1] - self.parts[a, d - 1]) ** 2
                self.steps += 1
            begins = a + np.flatnonzero(self.starts[a:z, d])
            begins = np.append(begins[begins > a], z)
            # Large children are entered; small ones that lie side by side are finished together.
            first = last = a
            for end in map(int, begins):
                if end - first > LEAVES and last > first:
                    self._finish(first, last, d, summed, columns, nearest, distance)
                    first = last
                if end - first > LEAVES:
                    stack.append((first, end, d + 1, summed))
                    first = end
                last = end
            if last > first:
                self._finish(first, last, d, summed, columns, nearest, distance)
        return nearest[self.leaf], distance[self.leaf]

    def _finish(self, a: int, z: int, d: int, summed: np.ndarray, columns: np.ndarray, nearest: np.ndarray, distance: np.ndarray) -> None:
        """The leaves of rows a to z, which agree in d values whose distances are in ``summed``, one level at a time."""
        nodes, of = summed[None], np.zeros(z - a, np.int64)
        for level in range(d, self.depth):
            new = self.starts[a:z, level].copy()
            new[0] = True
            first = np.flatnonzero(new)
            nodes = nodes[of[first]] + (columns[level] - self.parts[a + first, level][:, None]) ** 2
            of = np.cumsum(new) - 1
            self.steps += len(first)
        nearest[a:z] = nodes.argmin(axis=1)
        distance[a:z] = np.take_along_axis(nodes, nearest[a:z, None], axis=1)[:, 0]


def _sorted_rows(x: np.ndarray) -> np.ndarray:
    return np.lexsort(x.T[::-1])


def _sums(books: list[list[list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [np.array(b, np.int64) for b in books]
        for batch in batches:
            where, n, x = batch.column("at").to_numpy(), batch.column("n").to_numpy(), matrix(batch.column("part"))
            for at in np.unique(where):
                mine = where == at
                part, count = x[mine], n[mine]
                nearest, _ = Trie(part).leaves(entries[at])
                by = np.argsort(nearest, kind="stable")
                used, first = np.unique(nearest[by], return_index=True)
                sums = np.add.reduceat((part * count[:, None])[by], first, axis=0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), at), pa.int32()), pa.array(used, pa.int32()), pa.array(np.add.reduceat(count[by], first)),
                    lists_of(sums, pa.int64())], ["at", "entry", "n", "sums"])

    return run


def _encode(books: list[list[list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [np.array(b, np.int64) for b in books]
        width = entries[0].shape[1]
        for batch in batches:
            x = matrix(batch.column("v"))
            if not len(x):
                continue
            codes, error = np.zeros((len(x), len(entries)), np.int64), np.zeros(len(x), np.int64)
            for at, book in enumerate(entries):
                part = x[:, at * width : (at + 1) * width]
                by = _sorted_rows(part)
                codes[by, at], distance = Trie(part[by]).leaves(book)
                error[by] += distance
            named = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(named, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each kept row of ``vectors`` (vec_id, embedding, label, any others).

    Vectors that are null or empty or hold nulls, NaN or infinities are dropped. So are, as they cannot be cut alike, those whose length ``parts`` does not divide or is
    not that of the smallest kept vec_id. A vector counts as floor(scale * x), held within ±2**27, in ``parts`` equal consecutive parts. A
    codebook starts as that part of the ``entries`` (at most 256) smallest vec_ids; equal ids go by their components, null ids come last, and of fewer rows
    all are entries. Each round assigns parts to the nearest entry (squared distance, ties to the lower index) and moves
    each entry to the floor of its parts' mean; unused ones stay. ``code`` has two hexadecimal digits a part, ``error`` the squared
    distances summed, ``label_error`` the error summed over equal labels, null labels together; above the largest long it is given as that.
    Repeated rows count each time. Other columns are not read. A table without kept rows gives an empty result.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError(f"a code has two hexadecimal digits a part: {entries} entries do not fit")
    cut = F.size("embedding") % parts == 0
    kept = vectors.where(usable() & (F.size("embedding") > 0) & cut).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole("embedding", scale).alias("v"))
    kept = freeze(kept, "code-rows")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    length = len(first[0].v)
    kept = kept.where(F.size("v") == length)
    width = length // parts
    start = [r.v for r in kept.select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    books = [[list(v[at * width : (at + 1) * width]) for v in start] for at in range(parts)]

    each = kept.select(F.explode(F.array(*[
        F.struct(F.lit(at).alias("at"), F.slice("v", at * width + 1, width).alias("part")) for at in range(parts)])).alias("p")).select("p.at", "p.part")
    distinct = each.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n"))
    distinct = freeze(distinct.repartitionByRange(partitions(spark), "at", "part").sortWithinPartitions("at", "part"), "code-parts")
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books), "at int, entry int, n long, sums array<long>").groupBy("at", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)])
        for r in sums.collect():  # one row for each entry
            books[r.at][r.entry] = [r[f"s{d}"] // r.n for d in range(width)]

    coded = freeze(kept.mapInArrow(_encode(books), f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = freeze(coded.groupBy(F.col("label").alias("same_label")).agg(total.alias("label_error")), "code-labels")
    name = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["same_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
