"""Toxicity by a linear classifier that is kept from judging by the group a text names.

Features are words and stretches of 4 to 6 bytes inside words, A-Z folded, present or absent in a text; those that tell the
labels apart best are kept. Labelled texts that name a group are also shown with the name swapped for others of its kind; the loss
adds ``penalty`` times the squared change of the score, so that names of groups do not count as toxic by themselves.

Fitting reads a bounded sample: about ``sample_rows`` labelled documents, chosen by a hash of their id, whole. Scoring reads
every document. Only the sample's few kept features come to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from . import hashing
from .common import held_out, text_of

SAMPLE_ROWS = 12_000
FEATURES = 1024
GRAMS = (4, 5, 6)
PENALTY = 1.0
RIDGE = 2e-3
STEPS = 300
#: Labelled texts in which a feature must occur.
LEAST_TEXTS = 5

# Names of groups; within a line any may stand for any other.
IDENTITIES = (
    "women men girls boys mothers fathers",
    "woman man girl boy mother father",
    "muslim christian jewish hindu buddhist atheist catholic",
    "muslims christians jews hindus buddhists atheists catholics",
    "black white asian latino african european american arab",
    "gay lesbian bisexual transgender straight queer",
    "immigrant refugee foreigner migrant",
    "immigrants refugees foreigners migrants",
    "disabled blind deaf autistic",
    "frauen männer mädchen jungen",
    "muslime christen juden",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos",
)
_OTHERS = {w: [x for x in line.split() if x != w] for line in IDENTITIES for w in line.split()}
_IDENTITY = re.compile(r"\b(?:" + "|".join(sorted(_OTHERS, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str, turn: int = 0) -> str | None:
    """The text with each group's name swapped for another of its kind, or None if it names no group."""
    out, n = _IDENTITY.subn(lambda m: _OTHERS[m[0].lower()][turn % len(_OTHERS[m[0].lower()])], text)
    return out if n else None


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature) of words, then of stretches of each size; a feature is a hash."""
    w = hashing.words(data, offsets, inside=hashing.LETTER, fold=hashing.LOWER)
    of, size = w.texts(), w.end - w.start
    yield of, w.hash
    window = hashing.byte_window_hasher(hashing.LOWER[data])
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        at = np.repeat(w.start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        yield np.repeat(of, count), hashing.mix(window(at, at + n) ^ np.uint64(n << 32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that have a feature, slice by slice."""
    for batch in batches:
        for rows, data, offsets in hashing.slices(batch, limit=4 << 20):
            toxic = rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for of, h in features(data, offsets):
                order = np.lexsort((of, h))
                of, h = of[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                of, h = of[new], h[new]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
                n = np.diff(np.append(first, len(h)))
                bad = np.add.reduceat(toxic[of].astype(np.int64), first) if len(h) else first
                # What one text alone has can be in LEAST_TEXTS texts only over other slices; it is counted there too.
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(bad)], ["feature", "n", "bad"])


def _present(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """Numbers of the chosen features (sorted hashes) that each text has."""
    pairs = []
    for of, h in features(data, offsets):
        at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
        hit = chosen[at] == h
        pairs.append(of[hit].astype(np.int64) * len(chosen) + at[hit])
    pairs = np.unique(np.concatenate(pairs))
    of = pairs // len(chosen)
    return np.split(pairs % len(chosen), np.searchsorted(of, np.arange(1, len(offsets) - 1)))


def _represent(chosen: np.ndarray) -> Callable:
    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in hashing.slices(batch):
                has = _present(data, offsets, chosen)
                # Which other name a text gets depends on the text alone, not on where its row lies.
                texts = [swapped(x or "", turn=zlib.crc32((x or "").encode())) for x in rows.column("text").to_pylist()]
                named = [i for i, x in enumerate(texts) if x is not None]
                other: list = [None] * len(has)
                for _, d, o in hashing.slices(pa.RecordBatch.from_arrays([pa.array([texts[i] for i in named], pa.string())], ["text"]), limit=1 << 40):
                    for i, x in zip(named, _present(d, o, chosen)):
                        other[i] = x
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column("toxic"), pa.array(has, kind), pa.array(other, kind)], ["toxic", "has", "other"])

    return represent


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def fit(x: np.ndarray, y: np.ndarray, changed: np.ndarray, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam. ``changed``: per counterfactual pair, the features of one text minus those of the other."""
    w, b = np.zeros(x.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        g = x.T @ (p - y) / len(y) + ridge * w
        if len(changed):
            g += 2 * penalty * (changed.T @ (changed @ w)) / len(changed)
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, penalty: float = PENALTY) -> Model:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) without held-out rows. A label that is null counts for nothing;
    of several labels of one id any positive counts. Without both classes the model scores everything 0."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Two scalars decide the share; each class is sampled alike.
    n = marked.count()
    lot = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = marked.where(lot < min(1.0, sample_rows / max(1, n)))
    # The sample is bounded by sample_rows, so its ids go to the documents.
    rows = freeze(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id").select("text", "toxic"), "toxicity-sample")
    total, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    if not 0 < bad < total:
        return nothing
    counts = rows.mapInArrow(_count, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    share = bad / total
    # Standard deviations by which the feature's share of toxic texts lies off the share among all.
    off = (F.col("bad") - F.col("n") * share) / F.sqrt((F.col("n") + 1) * share * (1 - share))
    top = counts.where(F.col("n") >= LEAST_TEXTS).select("feature", F.abs(off).alias("off")).orderBy(F.desc("off"), "feature").limit(n_features)
    chosen = np.sort(top.toArrow()["feature"].to_numpy().view(np.uint64))
    if not len(chosen):
        return nothing
    got = rows.mapInArrow(_represent(chosen), "toxic int, has array<int>, other array<int>").toArrow()

    def dense(column: str) -> np.ndarray:
        lists = got[column].combine_chunks()
        out = np.zeros((len(lists), len(chosen)), np.float32)
        sizes = np.array([len(v) if v is not None else 0 for v in lists.to_pylist()])
        out[np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy()] = 1
        return out

    x, y = dense("has"), got["toxic"].to_numpy().astype(np.float64)
    other, named = dense("other"), np.array([v is not None for v in got["other"].to_pylist()], bool)
    # The order in which rows arrive must not matter: rows in order of all their features.
    order = np.lexsort((y, named, *np.packbits(other.astype(bool), axis=1).T, *np.packbits(x.astype(bool), axis=1).T))
    x, y, other, named = x[order], y[order], other[order], named[order]
    w, b = fit(x, y, x[named] - other[named], penalty)
    return Model(chosen, w, b)


def scorer(model: Model) -> Callable:
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            out = []
            for _, data, offsets in hashing.slices(pa.RecordBatch.from_arrays([column], ["text"])):
                if not len(model.features):
                    out.append(np.zeros(len(offsets) - 1))
                    continue
                z = np.array([model.weights[has].sum() for has in _present(data, offsets, model.features)]) + model.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.array(np.concatenate(out or [np.zeros(0)]))

    return score


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1). Null and empty texts have no feature and get the score of that. Each row by itself; ids may be
    null or repeat; a column of that name is replaced."""
    return docs.withColumn("toxicity", F.arrow_udf(scorer(model), "double")(text_of()))
