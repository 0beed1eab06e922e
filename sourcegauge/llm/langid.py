"""Language identification by unigram models over the pieces of one public vocabulary, all segmentations summed.

A text's words are runs of letters, A-Z folded, opened by the vocabulary's word mark. A language's model gives each piece a
probability; a word's probability is the sum over all ways to cut it into pieces, by the forward recursion. Models are fitted by
expectation maximisation: expected piece counts over all segmentations of the training words. Single bytes always are pieces,
so every word has a segmentation.

Recursions run over the distinct words of a slice of texts at once, by word length, in numpy; in scoring, words of slices before are
remembered within a bound. A word longer than ``LONGEST`` bytes (scripts without blanks) goes byte by byte, in time proportional to
its length, and is not cut either.

Fitting reads a bounded sample: about ``per_language`` whole documents of each language, chosen by a hash of their id. The
models are one vector for each language; scoring reads every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze
from . import hashing
from .common import free_names, held_out, text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words up to so many bytes are worked on together, longer ones one by one. Both ways give the same sums.
LONGEST = 32
#: Bytes of a long word whose pieces are looked up together, and positions after which its sums are scaled.
STRETCH, SCALED = 4096, 16
PER_LANGUAGE = 1500
#: Bytes of text whose distinct words are worked on together; arrays of a worker grow with them.
SLICE = 1 << 20
#: Numbers that a worker keeps of the words it has scored, so that slices may be small and common words are scored once.
KEPT = 1 << 20
ROUNDS = 3
#: Added to every expected count.
SMOOTH = 0.05
_LETTER = re.compile(r"[^\W\d_]")


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of letters in the vocabulary's order, folded to lower A-Z and without repeats, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, None] = {bytes([b]): None for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            raw = model.id_to_piece(i).encode().translate(bytes(hashing.LOWER))
            body = raw.removeprefix(MARK.encode())
            if all(hashing.LETTER[b] for b in body):
                out[raw] = None
    return list(out)


class Lookup:
    """Finds pieces by the hash of their bytes: an id, or ``none`` for what only begins a piece, or -1.

    Open hash tables in numpy that also hold all beginnings of pieces, so that a search stops where no piece goes on.
    """

    BITS = 19

    def __init__(self, pieces: list[bytes]):
        mark = MARK.encode()
        self.none, self.mark = len(pieces), pieces.index(mark)
        #: Longest piece in bytes, the mark not counted.
        self.widest = max(len(p.removeprefix(mark)) for p in pieces)
        self.inner = self._table({p: i for i, p in enumerate(pieces) if not p.startswith(mark)})
        self.first = self._table({p[len(mark) :]: i for i, p in enumerate(pieces) if p.startswith(mark) and len(p) > len(mark)})

    @staticmethod
    def hash_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hashing.mix(hashing.byte_windows(data, start, end) ^ (end - start).astype(np.uint64))

    def _table(self, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        ids = {p[:n]: self.none for p in ids for n in range(1, len(p))} | ids
        end = np.cumsum([len(p) for p in ids])
        h = self.hash_of(np.frombuffer(b"".join(ids), np.uint8), np.concatenate([[0], end[:-1]]), end)
        keys, values = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1)
        for key, value in zip(h.tolist(), ids.values()):
            slot = key >> (64 - self.BITS)
            while values[slot] >= 0:
                slot = (slot + 1) % len(keys)
            keys[slot], values[slot] = key, value
        return keys, values

    def find(self, table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        keys, values = table
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = values[slot]
        todo = np.flatnonzero((out >= 0) & (keys[slot] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(keys)
            out[todo] = values[slot[todo]]
            todo = todo[(out[todo] >= 0) & (keys[slot[todo]] != h[todo])]
        return out


@dataclass
class Lengthwise:
    """Distinct words of one length and their pieces: for (begin, size), which of the words have a piece there, and its id."""

    words: np.ndarray
    length: int
    inner: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    first: dict[int, tuple[np.ndarray, np.ndarray]]


def cut_words(data: np.ndarray, offsets: np.ndarray) -> hashing.Words:
    """Whole letter runs."""
    return hashing.words(data, offsets, inside=hashing.LETTER, fold=hashing.LOWER)


def finder(data: np.ndarray, lookup: Lookup) -> Callable:
    """Function of (table, places, most bytes, end) that yields (size, which places, piece ids); hashes come from one prefix sum."""
    window = hashing.byte_window_hasher(hashing.LOWER[data])

    def pieces(table: tuple, at: np.ndarray, most: int, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        open_ = np.arange(len(at))
        for n in range(1, most + 1):
            if end is not None:
                open_ = open_[at[open_] + n <= end]
            ids = lookup.find(table, hashing.mix(window(at[open_], at[open_] + n) ^ np.uint64(n)))
            whole = (ids >= 0) & (ids < lookup.none)
            if whole.any():
                yield n, open_[whole], ids[whole]
            open_ = open_[ids >= 0]
            if not len(open_):
                return

    return pieces


def lattices(start: np.ndarray, end: np.ndarray, lookup: Lookup, pieces: Callable) -> Iterator[Lengthwise]:
    """The pieces of the given words of at most LONGEST bytes, length by length."""
    size = end - start
    for length in np.unique(size[size <= LONGEST]):
        which = np.flatnonzero(size == length)
        at = start[which]
        inner = {(i, n): (w, ids) for i in range(length) for n, w, ids in pieces(lookup.inner, at + i, min(lookup.widest, length - i))}
        first = {n: (w, ids) for n, w, ids in pieces(lookup.first, at, min(lookup.widest, length))}
        yield Lengthwise(which, int(length), inner, first)


class LongWord:
    """One word of any length. Its pieces are looked up stretch by stretch, so they are never held whole."""

    def __init__(self, start: int, end: int, lookup: Lookup, pieces: Callable):
        self.start, self.end, self.lookup, self.pieces = int(start), int(end), lookup, pieces
        self.opening = [(n, ids[0]) for n, _, ids in pieces(lookup.first, np.array([start]), lookup.widest, end)]

    def _stretch(self, a: int, b: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Pieces that begin in a to b: where those of each place begin, sizes, ids. Single bytes are pieces, so each place has some."""
        got = list(self.pieces(self.lookup.inner, np.arange(a, b), self.lookup.widest, self.end))
        w, ids = (np.concatenate([x[i] for x in got]) for i in (1, 2))
        by = np.argsort(w, kind="stable")
        sizes = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
        return np.searchsorted(w[by], np.arange(b - a + 1)).tolist(), sizes[by], ids[by]

    def forward(self, p: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Logarithm of the word's probability, per language. ``kept`` gets (sums, their logarithmic scale) of every place."""
        reach = self.lookup.widest + 1
        carried, log = np.zeros((reach, p.shape[1])), np.zeros(p.shape[1])
        carried[0] = p[self.lookup.mark]
        for n, piece in self.opening:
            carried[n] += p[piece]
        for a in range(self.start, self.end, STRETCH):
            b = min(a + STRETCH, self.end)
            cut, sizes, ids = self._stretch(a, b)
            alpha = np.concatenate([carried, np.zeros((b - a, p.shape[1]))])
            for i in range(b - a):
                if i % SCALED == 0:
                    near = alpha[i : i + reach]
                    top = near.max(axis=0)
                    near /= top
                    log = log + np.log(top)
                if kept is not None:
                    kept.append((alpha[i], log))
                x, y = cut[i], cut[i + 1]
                alpha[i + sizes[x:y]] += alpha[i] * p[ids[x:y]]
            carried = alpha[b - a :]
        return log + np.log(carried[0])

    def expected(self, q: np.ndarray, weight: float) -> np.ndarray:
        """Expected counts of all pieces, for one language."""
        kept: list = []
        whole = self.forward(q[:, None], kept)[0]
        reach, out, log = self.lookup.widest + 1, np.zeros(len(q)), 0.0
        carried = np.zeros(reach)
        carried[0] = 1.0
        for a in reversed(range(self.start, self.end, STRETCH)):
            b = min(a + STRETCH, self.end)
            cut, sizes, ids = self._stretch(a, b)
            beta = np.concatenate([np.zeros(b - a), carried])
            for i in reversed(range(b - a)):
                x, y = cut[i], cut[i + 1]
                ways = q[ids[x:y]] * beta[i + sizes[x:y]]
                beta[i] = ways.sum()
                alpha, scale = kept[a - self.start + i]
                out[ids[x:y]] += weight * alpha[0] * ways * np.exp(scale[0] + log - whole)
                if i % SCALED == 0:
                    near = beta[i : i + reach]
                    top = near.max()
                    near /= top
                    log += np.log(top)
            carried = beta[:reach]
        share = weight * np.exp(log - whole)
        for n, piece in self.opening:
            out[piece] += share * q[piece] * carried[n]
        out[self.lookup.mark] += share * q[self.lookup.mark] * carried[0]
        return out


def forward(x: Lengthwise, p: np.ndarray, mark: int) -> list[np.ndarray]:
    """alpha[j]: probability of the first j bytes, summed over segmentations, per word and language. p: (pieces, languages)."""
    alpha = [np.zeros((len(x.words), p.shape[1])) for _ in range(x.length + 1)]
    alpha[0][:] = p[mark]
    for n, (w, ids) in x.first.items():
        alpha[n][w] += p[ids]
    for (i, n), (w, ids) in x.inner.items():
        alpha[i + n][w] += alpha[i][w] * p[ids]
    return alpha


def expected(x: Lengthwise, q: np.ndarray, mark: int, weight: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces in words weighted by ``weight``, for one language."""
    alpha = [a[:, 0] for a in forward(x, q[:, None], mark)]
    beta = [np.zeros(len(x.words)) for _ in range(x.length)] + [np.ones(len(x.words))]
    for (i, n), (w, ids) in reversed(x.inner.items()):
        beta[i][w] += q[ids] * beta[i + n][w]
    share = weight / np.maximum(alpha[x.length], 1e-300)
    out = np.zeros(len(q))
    for n, (w, ids) in x.first.items():
        np.add.at(out, ids, share[w] * q[ids] * beta[n][w])
    out[mark] += (share * q[mark] * beta[0]).sum()
    for (i, n), (w, ids) in x.inner.items():
        np.add.at(out, ids, share[w] * alpha[i][w] * q[ids] * beta[i + n][w])
    return out


@dataclass
class Model:
    """Piece probabilities: one column for each language."""

    languages: list[str]
    pieces: list[bytes]
    p: np.ndarray


def _expect(model: Model) -> Callable:
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, number = Lookup(model.pieces), {x: i for i, x in enumerate(model.languages)}
        for batch in batches:
            for rows, data, offsets in hashing.slices(batch, limit=SLICE):
                w, pieces = cut_words(data, offsets), finder(data, lookup)
                of = np.array([number[x] for x in rows.column("lang").to_pylist()])[w.texts()]
                for k in np.unique(of):
                    mine = np.flatnonzero(of == k)
                    _, at, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
                    at, total = mine[at], np.zeros(len(model.pieces))
                    for x in lattices(w.start[at], w.end[at], lookup, pieces):
                        total += expected(x, model.p[:, k], lookup.mark, n[x.words].astype(float))
                    for i in np.flatnonzero(w.end[at] - w.start[at] > LONGEST):
                        total += LongWord(w.start[at[i]], w.end[at[i]], lookup, pieces).expected(model.p[:, k], float(n[i]))
                    some = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(total[some])], ["k", "piece", "n"])

    return expect


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of about ``per_language`` training documents of each language, or of all where there are fewer."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # One count for each language: the labels are few, and texts are not shuffled by them.
    counts = dict(known.groupBy("lang").count().collect())
    if not counts:
        return known.select("lang", "text")
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, per_language / n)])[F.col("lang")]
    lot = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return known.where(lot < share).select("lang", "text")


def train(docs: DataFrame, vocabulary: str = VOCABULARY, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Models of all languages of ``docs`` (doc_id, text, lang), without held-out rows. Nothing to learn from gives no language."""
    rows = freeze(sample(docs, per_language), "language-sample")
    languages = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    pieces = read_pieces(vocabulary)
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds if languages else 0):
        counts = rows.mapInArrow(_expect(Model(languages, pieces, p)), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        # Languages times pieces of the vocabulary at most.
        got = counts.toArrow()
        n = np.full((len(pieces), len(languages)), SMOOTH)
        n[got["piece"].to_numpy(), got["k"].to_numpy()] += np.round(got["n"].to_numpy(), 6)
        p = n / n.sum(axis=0)
    return Model(languages, pieces, p)


class WordScores:
    """Logarithms of words' probabilities, per language. The last words scored are remembered by their hashes, ``KEPT`` numbers at most."""

    def __init__(self, model: Model):
        self.lookup, self.p, self.most = Lookup(model.pieces), model.p, KEPT // (1 + model.p.shape[1])
        self._keep(np.zeros(0, np.uint64), np.zeros((0, model.p.shape[1])))

    def _keep(self, known: np.ndarray, logs: np.ndarray) -> None:
        self.known, self.logs = known[: self.most], logs[: self.most]

    def of(self, w: hashing.Words) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words' logarithms, and which of them each word of ``w`` is."""
        h, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, h)
        old = np.zeros(len(h), bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == h[inside]
        logs = np.empty((len(h), self.p.shape[1]))
        logs[old] = self.logs[place[old]]
        logs[~old] = self._score(w, at[~old])
        if len(self.known) + (~old).sum() <= self.most:
            self._keep(np.insert(self.known, place[~old], h[~old]), np.insert(self.logs, place[~old], logs[~old], axis=0))
        else:
            self._keep(h, logs)
        return logs, back

    def _score(self, w: hashing.Words, at: np.ndarray) -> np.ndarray:
        data, start, end = _copied(w.data, w.start[at], w.end[at])
        logs, pieces = np.empty((len(at), self.p.shape[1])), finder(data, self.lookup)
        for x in lattices(start, end, self.lookup, pieces):
            logs[x.words] = np.log(np.maximum(forward(x, self.p, self.lookup.mark)[-1], 1e-300))
        for i in np.flatnonzero(end - start > LONGEST):
            logs[i] = LongWord(start[i], end[i], self.lookup, pieces).forward(self.p)
        return logs


def _copied(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Only the bytes of the given words, one after the other, and where the words now begin and end."""
    size = end - start
    to = np.cumsum(size)
    return data[np.arange(size.sum()) + np.repeat(start - to + size, size)], to - size, to


def predict(model: Model) -> Callable:
    """A function of text columns that gives (lang, score): the likeliest language and its posterior, languages alike before."""

    shape = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordScores(model)
        for column in texts:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for rows, data, offsets in hashing.slices(pa.RecordBatch.from_arrays([column], ["text"]), limit=SLICE):
                w = cut_words(data, offsets)
                total = np.zeros((len(offsets) - 1, max(1, len(model.languages))))
                if model.languages and len(w.hash):
                    logs, back = words.of(w)
                    for k in range(len(model.languages)):
                        total[:, k] = np.bincount(w.texts(), logs[back, k], len(total))
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                lettered = [n > 0 and (bool(a) or bool(_LETTER.search(t))) for n, a, t in zip(w.counts, _ascii(w, data), rows.column("text").fill_null("").to_pylist())]
                ok = [x and bool(model.languages) for x in lettered]
                langs += [model.languages[b] if x else "und" for b, x in zip(best, ok)]
                scores.append(np.where(ok, odds.max(axis=1) / odds.sum(axis=1), 0.0))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], fields=list(shape))

    return score


def _ascii(w: hashing.Words, data: np.ndarray) -> np.ndarray:
    """Whether a text has a word that begins with an ASCII letter."""
    out = np.zeros(len(w.first) - 1, bool)
    out[w.texts()[data[w.start] < 128]] = True
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and lang_score. A null text, or one without a letter, is ``und`` with score 0; so is every text of a model
    without languages. Each row by itself: ids may be null or repeat. Columns of these two names are replaced."""
    kept = docs.drop("lang_pred", "lang_score")
    (name,) = free_names(kept, "x_guess")
    udf = F.arrow_udf(predict(model), "struct<lang:string,score:double>")
    guess = kept.withColumn(name, udf(text_of()))
    return guess.select(*kept.columns, F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("lang_score"))
