"""Search, clustering and codes of vectors against plain loops over hostile rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcegauge.llm import clustering, codes, topsearch, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, v array<int>, x_id long, shard int, cluster int, part string, n long"


def _rows(width):
    rng = random.Random(width)
    near = [[rng.gauss(0, 0.15) for _ in range(width)] for _ in range(6)]
    out = [(i, [x + rng.gauss(0, 0.03) for x in near[i % 6]], i % 4) for i in range(150)]
    same = [round(rng.gauss(0, 0.2), 2) for _ in range(width)]
    out += [(200 + i, same, 7) for i in range(60)]  # a third of all rows
    out += [(300 + i, [rng.choice((-0.5, 0.0, 0.25)) for _ in range(width)], None) for i in range(20)]  # ties
    out += [out[20], out[20], (20, out[3][1], 1), (None, out[0][1], 2), (None, out[0][1], None)]
    out += [(400, [0.0] * width, 1), (420, [1e6] * width, 1), (440, [-3e30, 3e30] + [0.0] * (width - 2), None)]
    bad = [None, [], [0.1] * (width + 4), [0.2] * 3, [math.nan] + [0.0] * (width - 1), [math.inf] * width, [None] + [0.0] * (width - 1)]
    return out + [(500 + 20 * i, v, 1) for i, v in enumerate(bad)]


@pytest.fixture(scope="module")
def rows():
    return _rows(64)


def frame(spark, rows):
    return spark.createDataFrame([(*r, [1], 5, 0, 1, "x", 1) for r in rows], SCHEMA).repartition(4)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [max(-vectors.BOUND, min(vectors.BOUND, math.floor(scale * x))) for x in v]


def last(x):
    return (x is None, x or 0)


def _top(rows, k, every=20):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if good(v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted(((sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(kept) if a != b), key=lambda s: (-s[0], last(s[1])))
            out += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, shard", [(32, 1 << 18), (3, 16)])
def test_search(spark, rows, block, shard):
    df = frame(spark, rows)
    got = sorted((tuple(r) for r in topsearch.search(df, F.col("vec_id") % 20 == 0, block=block, shard=shard).collect()), key=repr)
    assert got == _top(rows, 20)


def test_search_of_few(spark, rows):
    few = rows[:3] + rows[-7:]
    got = sorted((tuple(r) for r in topsearch.search(frame(spark, few), F.col("vec_id") % 20 == 0).collect()), key=repr)
    assert got == _top(few, 20) and {r[1] for r in got} == {1, 2, 3, 4, 5}
    empty = frame(spark, rows).where(F.lit(False))
    assert topsearch.search(empty, F.lit(True)).count() == 0
    assert topsearch.search(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_blocks_are_pruned():
    """Blocks whose bound is below the k-th score are not scored; results are those of a full scan."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (50, 16))
    v = np.floor(np.repeat(centres, 64, axis=0) + rng.normal(0, 2, (3200, 16))).astype(np.int64)
    ids = np.arange(len(v))
    shard = topsearch.Shard(v, ids, ids, 32)
    q = v[::100]
    who, score, row, rank = shard.search(q, ids[::100], 20, np.full(len(q), topsearch.NONE), np.full(len(q), topsearch.NO_ID))
    all_scores = q @ v.T
    all_scores[np.arange(len(q)), ids[::100]] = -(10**9)
    for i in range(len(q)):
        assert list(row[who == i]) == list(np.lexsort((ids, -all_scores[i]))[:20])
    assert shard.visited < 0.2 * len(q) * len(shard.first)
    assert (shard.bounds(q) >= np.maximum.reduceat(q @ v.T, shard.first, axis=1)).all()


def _clusters(rows, k=16, rounds=3):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if good(v) and len(v) == 64]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in hashed[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for _, c, _, v in found if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found, own = assign(), defaultdict(int)
    for _, c, d, _ in found:
        own[c] += d
    cap = 2**63 - 1
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, min(cap, own[c]), min(cap, sum(own.values())), names[c]) for i, c, d, _ in found), key=repr)


def test_clusters(spark, rows):
    assert sorted((tuple(r) for r in clustering.cluster(frame(spark, rows)).collect()), key=repr) == _clusters(rows)
    few = rows[:5] + rows[-7:]
    assert sorted((tuple(r) for r in clustering.cluster(frame(spark, few)).collect()), key=repr) == _clusters(few)
    assert clustering.cluster(frame(spark, rows[-7:])).count() == 0 and clustering.cluster(frame(spark, rows).where(F.lit(False))).count() == 0


def test_tournament():
    """k - 1 sign tests give the nearest centroid; equal distances the smaller number, also among equal centroids."""
    rng = np.random.default_rng(1)
    c, x = rng.integers(-2, 3, (16, 3)), rng.integers(-3, 4, (3000, 3))
    field = clustering.Bisectors(c.tolist())
    d = ((x[:, None] - c) ** 2).sum(axis=2)
    won = field.winners(x)
    assert (won == d.argmin(axis=1)).all() and (field.distances(x, won) == d.min(axis=1)).all()


def _codes(rows, n=4, k=256, rounds=4):
    cut = [(i, whole(v, 1024), l) for i, v, l in rows if good(v) and v and len(v) % n == 0]
    cut.sort(key=lambda r: (last(r[0]), r[1]))
    kept = [r for r in cut if len(r[1]) == len(cut[0][1])] if cut else []
    width = len(kept[0][1]) // n if kept else 0
    parts = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), n, width)
    books = parts[:k].transpose(1, 0, 2).tolist()

    def assign():
        d = np.stack([((parts[:, p, None] - np.array(books[p])) ** 2).sum(axis=2) for p in range(n)], axis=1)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(n):
            for e in range(len(books[p])):
                own = parts[code[:, p] == e, p]
                if len(own):
                    books[p][e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code, d = assign()
    error, of = d.sum(axis=1), defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        of[label] += int(e)
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, bytes(c.tolist()).hex(), int(e), min(2**63 - 1, of[label]), name) for (i, _, label), c, e in zip(kept, code, error)), key=repr)


@pytest.mark.parametrize("entries", [256, 9])
def test_codes(spark, rows, entries):
    got = codes.compress(frame(spark, rows), entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _codes(rows, k=entries)
    assert got.dtypes[:3] == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint")]


def test_codes_of_few(spark, rows):
    few = rows[:3] + rows[-7:]
    assert sorted((tuple(r) for r in codes.compress(frame(spark, few)).collect()), key=repr) == _codes(few)
    assert codes.compress(frame(spark, rows).where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        codes.compress(frame(spark, few), entries=257)


@pytest.mark.parametrize("values, n", [(3, 4000), (1000, 700), (1, 10)])
def test_trie(values, n, monkeypatch):
    """Distances shared along prefixes are those computed part by part, and fewer are computed where prefixes are shared."""
    rng = np.random.default_rng(values)
    parts = rng.integers(0, values, (n, 6))
    parts = parts[np.lexsort(parts.T[::-1])]
    entries = rng.integers(-1, values + 1, (40, 6))
    for leaves in (256, 5, 1):
        monkeypatch.setattr(codes, "LEAVES", leaves)
        trie = codes.Trie(parts)
        nearest, distance = trie.leaves(entries)
        d = ((parts[:, None] - entries) ** 2).sum(axis=2)
        assert (nearest == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        distinct = len(np.unique(parts, axis=0))
        assert trie.steps <= distinct * 6 and (values > 3 or trie.steps < distinct * 6 / 2 or distinct == 1)
