"""Removal of passages that repeat word for word, within a document or between documents.

Fixed-block anchors: every window of ``window`` words holds exactly one whole block of ``(window + 1) // 2``
words that starts at a multiple of that length in its document. These non-overlapping blocks are the index.
All rolling windows of the block's length, of all documents, probe it. A block found at a second place is
an anchor; around anchors alone the ``window``-word sequences are hashed whole (128 bits) and compared, so
that a repeat extends as far as its words agree and no further. Unions of equal windows are maximal repeats.

Documents are dealt to ``chunks`` by key, once; Spark reuses that exchange. What a chunk asks goes, packed, to
``buckets`` by hash, at most two copies of a hash for each chunk, and the answers return to the chunk (for windows as one bit each). So a
passage shared by a third of all documents weighs as many entries as there are chunks, no pair of documents is
ever formed, and no more than one chunk or one bucket is held at a time. Their numbers follow the measured bytes of all texts, so that a
chunk stays as large at any size of the input; there are no fewer than spark.sql.shuffle.partitions asks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import keyed, partitions

WINDOW = 35
#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 64 << 20
#: Bits of an anchor hash that travel beside its bucket. A chance hit only makes a window be compared in vain.
_ANCHOR_BYTES = 5
_LOW = np.uint64((1 << 8 * _ANCHOR_BYTES) - 1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper half of the hash; monotonic in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cut(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes."""
    return np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1, dtype=np.uint64))


def _short(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_ANCHOR_BYTES]).tobytes()


def _long(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, _ANCHOR_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_ANCHOR_BYTES] = raw
    return out.view("<u8").ravel()


def _at_most_twice(h: np.ndarray) -> np.ndarray:
    u, n = np.unique(h, return_counts=True)
    return np.sort(np.concatenate([u, u[n > 1]]))


def _member(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each x occurs in the sorted array."""
    if not len(found):
        return np.zeros(len(x), bool)
    return found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x


def _member2(a: np.ndarray, b: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each pair (a, b) occurs in the rows of ``found``, sorted by first and second."""
    out = np.zeros(len(a), bool)
    at = np.searchsorted(found[:, 0], a)
    while (open_ := (at < len(found)) & ~out).any():
        same = open_.copy()
        same[open_] = found[at[open_], 0] == a[open_]
        if not same.any():
            break
        out[same] = found[at[same], 1] == b[same]
        at = np.where(same, at + 1, len(found))
    return out


def _long_enough(w: hashing.Words, window: int) -> np.ndarray:
    """For each word, whether its text has a window at all."""
    return np.repeat(w.counts >= window, w.counts)


def _blocks(w: hashing.Words, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and anchor hashes of the whole blocks."""
    start = w.window_starts(block)
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)
    start = start[(place[start] % block == 0) & _long_enough(w, window)[start]]
    return start, w.window_hashes(start, start + block)


def _ask_anchors(window: int, buckets: int):
    block = (window + 1) // 2

    def ask(chunk: pa.Table) -> pa.Table:
        rolling, index = [], []
        for _, data, offsets in hashing.slices(chunk):
            w = hashing.words(data, offsets)
            start = w.window_starts(block)
            start = start[_long_enough(w, window)[start]]
            rolling.append(_at_most_twice(w.window_hashes(start, start + block)))
            index.append(_blocks(w, block, window)[1])
        rolling = _at_most_twice(np.concatenate(rolling or [np.zeros(0, np.uint64)]))
        index = np.unique(np.concatenate(index or [np.zeros(0, np.uint64)]))
        a, b = _cut(rolling, buckets), _cut(index, buckets)
        used = np.flatnonzero(np.diff(a))
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), chunk["chunk"][0].as_py() if chunk.num_rows else 0), pa.int32()),
            "rolling": pa.array([_short(rolling[a[i] : a[i + 1]]) for i in used], pa.binary()),
            "index": pa.array([_short(index[b[i] : b[i + 1]]) for i in used], pa.binary()),
        })

    return ask


def _answer_anchors(bucket: pa.Table) -> pa.Table:
    """Of each chunk's blocks, those whose words occur at two places at least."""
    u, n = np.unique(np.concatenate([_long(x.as_py()) for x in bucket["rolling"]]), return_counts=True)
    twice = u[n > 1]
    top = np.uint64(bucket["bucket"][0].as_py()) << np.uint64(8 * _ANCHOR_BYTES)
    out = [(c.as_py(), (x[_member(x, twice)] | top)) for c, x in zip(bucket["chunk"], map(lambda v: _long(v.as_py()), bucket["index"]))]
    out = [(c, x) for c, x in out if len(x)]
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "found": pa.array([x.tobytes() for _, x in out], pa.binary())})


def _near_anchors(w: hashing.Words, found: np.ndarray, window: int, buckets: int) -> np.ndarray:
    """First words of the windows whose block is an anchor."""
    block = (window + 1) // 2
    start, h = _blocks(w, block, window)
    key = (_bucket(h, buckets) << np.uint64(8 * _ANCHOR_BYTES)) | (h & _LOW)
    anchor = np.zeros(len(w.hash) + 1, bool)
    anchor[start] = _member(key, found)
    wide = w.window_starts(window)
    place = wide - np.repeat(w.first[:-1], w.counts)[wide]
    return wide[anchor[wide + (-place) % block]]


def _both(w: hashing.Words, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return w.window_hashes(start, start + window), w.window_hashes(start, start + window, second=True)


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return np.stack([a[first], b[first]], 1) if len(a) else np.zeros((0, 2), np.uint64), np.diff(np.append(first, len(a)))


def _asked_windows(chunk: pa.Table, answers: pa.Table, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk asks about windows, the same each time: distinct hash pairs in order, how often each occurs, bounds of buckets."""
    found = [np.frombuffer(x.as_py(), np.uint64) for b, x in zip(answers["bucket"], answers["found"]) if b.as_py() < 0]
    found, a, b = np.sort(np.concatenate(found or [np.zeros(0, np.uint64)])), [], []
    if len(found):
        for _, data, offsets in hashing.slices(chunk):
            w = hashing.words(data, offsets)
            for x, y in zip((a, b), _both(w, _near_anchors(w, found, window, buckets), window)):
                x.append(y)
    none = [np.zeros(0, np.uint64)]
    pairs, n = _sorted_pairs(np.concatenate(a or none), np.concatenate(b or none))
    return pairs, n, _cut(pairs[:, 0], buckets)


def _ask_windows(window: int, buckets: int):
    def ask(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        pairs, n, cuts = _asked_windows(chunk, answers, window, buckets)
        used = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), chunk["chunk"][0].as_py() if chunk.num_rows else 0), pa.int32()),
            "pairs": pa.array([pairs[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()),
            "many": pa.array([np.packbits(n[cuts[i] : cuts[i + 1]] > 1).tobytes() for i in used], pa.binary()),
        })

    return ask


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _answer_windows(bucket: pa.Table) -> pa.Table:
    """For each of a chunk's windows, one bit: whether its words start at two places at least."""
    asked = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in bucket["pairs"]]
    many = [_bits(x.as_py(), len(y)) for x, y in zip(bucket["many"], asked)]
    everything = np.concatenate([*asked, *(x[m] for x, m in zip(asked, many))])
    pairs, n = _sorted_pairs(everything[:, 0], everything[:, 1])
    twice = pairs[n > 1]
    out = [(b.as_py(), c.as_py(), _member2(x[:, 0], x[:, 1], twice)) for b, c, x in zip(bucket["bucket"], bucket["chunk"], asked)]
    out = [x for x in out if x[2].any()]
    return pa.table({"bucket": pa.array([b for b, _, _ in out], pa.int32()), "chunk": pa.array([c for _, c, _ in out], pa.int32()),
                     "found": pa.array([np.packbits(x).tobytes() for _, _, x in out], pa.binary())})


def _remove(window: int, buckets: int):
    def remove(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        pairs, _, cuts = _asked_windows(chunk, answers, window, buckets)
        repeated = np.zeros(len(pairs), bool)
        for b, x in zip(answers["bucket"].to_pylist(), answers["found"]):
            if b >= 0:
                repeated[cuts[b] : cuts[b + 1]] = _bits(x.as_py(), cuts[b + 1] - cuts[b])
        found = pairs[repeated]
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
        for rows, data, offsets in hashing.slices(chunk):
            w = hashing.words(data, offsets)
            gone = np.zeros(len(w.hash) + 1, np.int64)
            if len(found):
                start = w.window_starts(window)
                start = start[_member2(*_both(w, start, window), found)]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
                spelled = data[offsets[i] : offsets[i + 1]].tobytes().split()
                lost = gone[a:b]
                spans = []
                if n := int(lost.sum()):
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
                    spans = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edges[::2], edges[1::2])]
                    spelled = [x for x, no in zip(spelled, lost.tolist()) if not no]
                out["n_words"].append(int(b - a))
                out["n_removed"].append(n)
                out["kept_text"].append(b" ".join(spelled).decode())
                out["removed"].append(spans)
            out["doc_id"] += rows.column("doc_id").to_pylist()
        return pa.table(out, schema=_RESULT)

    return remove


_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(_SPAN))])


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) for each row of ``docs`` (doc_id, text, any others).

    Removed is each word covered by a window of ``window`` words that also starts anywhere else, in the same
    document or another; ``removed`` lists the spans by first and last word. Kept words are joined by one blank.
    A null or empty text has no words. Rows that are equal are different places: their windows repeat. Ids may
    be null or repeat. Other columns are not read. An empty table gives an empty result.
    """
    n = partitions(docs.sparkSession)
    rows = keyed(docs)
    text_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    needed = -(-text_bytes // chunk_bytes)
    chunks, buckets = max(2 * n, needed), max(n, needed)
    dealt = rows.select(F.pmod(F.xxhash64("k1", "k2"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")
    by_chunk = dealt.groupBy("chunk")
    asked = by_chunk.applyInArrow(_ask_anchors(window, buckets), "bucket int, chunk int, rolling binary, index binary")
    anchors = asked.groupBy("bucket").applyInArrow(_answer_anchors, "chunk int, found binary").select(F.lit(-1).alias("bucket"), "chunk", "found")
    asked = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_ask_windows(window, buckets), "bucket int, chunk int, pairs binary, many binary")
    repeats = asked.groupBy("bucket").applyInArrow(_answer_windows, "bucket int, chunk int, found binary")
    return by_chunk.cogroup(anchors.unionAll(repeats).groupBy("chunk")).applyInArrow(
        _remove(window, buckets), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first:int,last:int>>")
