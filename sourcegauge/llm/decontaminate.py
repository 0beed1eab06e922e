"""Benchmark items in documents, re-parameterised ones included, by template canonicalisation.

Texts become sequences of tokens in two views. In the typed one numbers, units after numbers and capitalised names are
placeholders, all else is its lower-case word; in the folded one names are lower-case words too, so that a copy in another case is
seen. Windows of ``WINDOW`` tokens of both views are hashed and joined with the windows of the benchmark; each document is then
laid beside the items that it shares a window with. A match fixes where an item would lie in the document; along such an
alignment each slot value of the item must always meet the same value in the document, so a question with other numbers counts
and text of a like shape alone does not. Where words are added or missing the alignment goes on at a shift near by, in order; it also
goes on with windows of ``SHORT`` tokens. A document holds an item if consistent windows of both views cover ``COVERED`` of the
words and numbers that the item's windows of one view can cover.

Before the join, windows of documents that no item has are left out by a list of the benchmark's hashes, if the benchmark has at
most ``LISTED`` windows (16 MB); beyond, all windows go to the join. The result is the same.

A window that very many items have, such as a common instruction, lays all of these beside each document that holds it, as any of them may be
covered with that window as its only whole one. They are laid beside it ``BESIDE`` at a time, in rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import freeze
from . import hashing
from .common import NO_ID, keyed, text_of

WINDOW = 8
#: Plain words that a window must have; the rest may be placeholders.
PLAIN = 4
COVERED = 0.8
#: Words by which runs of windows of one alignment may be off each other.
DRIFT = 4
#: Shorter windows, and their least plain words, that go on with an alignment that whole windows have begun.
SHORT, SHORT_PLAIN = 4, 2
LISTED = 2_000_000
#: Items that are laid beside a document in one row, at most.
BESIDE = 64

# Units that follow a number.
UNITS = ("mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ml cl l liter liters litre "
         "litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars "
         "euro euros cent cents usd eur gbp w kw mw j kj cal kcal v a hz khz mhz ghz kb mb gb tb degree degrees c f k mph kmh").split()

# Titles whose full stop does not end a sentence.
TITLES = "mr mrs ms mx dr prof rev hon st sr jr capt col gen lt sgt".split()

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_NUMBER, _UNIT, _NAME, _WHOLE = (np.uint64(x) for x in (0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547, 0x9C15F73E62A76AE2))


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in raw])
    return np.sort(hashing.words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], end]), hashing.ALNUM, hashing.LOWER).hash)


_UNIT_HASHES, _TITLE_HASHES = _hash_words(UNITS), _hash_words(TITLES)


def _folds() -> np.ndarray:
    """Lower case of the characters of two and three bytes, where it has as many bytes."""
    out = np.arange(0x10000)
    for c in range(0x80, 0x10000):
        if len(x := chr(c).lower()) == 1 and (ord(x) >= 0x800) == (c >= 0x800) and ord(x) >= 0x80:
            out[c] = ord(x)
    return out


_FOLDS = _folds()


def fold_case(data: np.ndarray) -> np.ndarray:
    """UTF-8 in lower case but for A-Z; each character keeps its number of bytes. A sharp s becomes ss, as in capitals."""
    lead = np.flatnonzero(data >= 0xC3)
    if not len(lead):
        return data
    out = data.copy()
    two, three = lead[data[lead] < 0xE0], lead[(data[lead] >= 0xE0) & (data[lead] < 0xF0)]
    c = _FOLDS[(data[two] & 0x1F).astype(np.int64) << 6 | data[two + 1] & 0x3F]
    sharp = c == 0xDF
    out[two], out[two + 1] = np.where(sharp, 0x73, 0xC0 | c >> 6), np.where(sharp, 0x73, 0x80 | c & 0x3F)
    c = _FOLDS[(data[three] & 0x0F).astype(np.int64) << 12 | (data[three + 1] & 0x3F).astype(np.int64) << 6 | data[three + 2] & 0x3F]
    out[three], out[three + 1], out[three + 2] = 0xE0 | c >> 12, 0x80 | c >> 6 & 0x3F, 0x80 | c & 0x3F
    return out


@dataclass
class Tokens:
    """Canonical tokens of some texts; ``slot`` is the hash of what a placeholder stands for, 0 for plain words. ``at`` counts the words and
    numbers before each token, and before the end."""

    first: np.ndarray
    hash: np.ndarray
    slot: np.ndarray
    at: np.ndarray

    def sequence(self) -> hashing.Words:
        return hashing.Words(np.zeros(0, np.uint8), self.slot, self.slot, self.first, self.hash)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, Tokens]:
    """The typed and the folded view."""
    folded = fold_case(data)
    letters, digits = (hashing.words(folded, offsets, inside, hashing.LOWER) for inside in (hashing.LETTER, _DIGIT))
    start = np.concatenate([letters.start, digits.start])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.concatenate([letters.end, digits.end])[order]
    word = np.concatenate([letters.hash, digits.hash])[order]
    number = np.concatenate([np.zeros(len(letters.start), bool), np.ones(len(digits.start), bool)])[order]
    if not len(start):
        return (Tokens(np.zeros(len(offsets), np.int64), word, word, np.zeros(1, np.int64)),) * 2
    head = data[start]
    # Capitals of ASCII, and of Latin-1 in UTF-8.
    second = data[np.minimum(start + 1, len(data) - 1)]
    name = ~number & (((head >= 0x41) & (head <= 0x5A)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E)))
    begins = np.zeros(len(start), bool)
    first = np.searchsorted(start, offsets)
    begins[first[:-1][first[:-1] < len(start)]] = True
    gap = data[np.maximum(start - 1, 0)]
    near = ~begins & (np.append(1, start[1:] - end[:-1]) == 1)
    before_number, before_name = np.append(False, number[:-1]), np.append(False, name[:-1])
    # "1,234.5", "7:30" and "1/2" are one number, "New York", "Ann-Marie" and "Dr. Smith" one name.
    one_number = near & number & before_number & np.isin(gap, (0x2E, 0x2C, 0x3A, 0x2F))
    titled = ~begins & np.append(False, np.isin(word[:-1], _TITLE_HASHES)) & (np.append(1, start[1:] - end[:-1]) == 2) & (gap == 0x20)
    titled &= data[np.maximum(start - 2, 0)] == 0x2E
    one_name = name & before_name & (near & np.isin(gap, (0x20, 0x2D, 0x27)) | titled)
    unit = ~number & ~begins & before_number & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, word), len(_UNIT_HASHES) - 1)] == word)
    name &= ~unit
    each = np.flatnonzero(~one_number)

    def view(heads: np.ndarray, name: np.ndarray) -> Tokens:
        # What a placeholder stands for: its words in order.
        turn = np.arange(len(word)) - np.repeat(heads, np.diff(np.append(heads, len(word))))
        slot = np.bitwise_xor.reduceat(hashing.mix(word + turn.astype(np.uint64)), heads) | np.uint64(1)
        out = np.where(number[heads], _NUMBER, np.where(unit[heads], _UNIT, np.where(name[heads], _NAME, word[heads])))
        plain = ~(number | unit | name)[heads]
        at = np.append(np.searchsorted(each, heads), len(each))
        return Tokens(np.searchsorted(start[heads], offsets), out, np.where(plain, np.uint64(0), slot), at)

    return view(np.flatnonzero(~(one_number | one_name)), name), view(each, np.zeros(len(name), bool))


def _windows(t: Tokens, size: int, plain: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of windows with enough plain words."""
    w = t.sequence()
    start = w.window_starts(size)
    words = np.concatenate([[0], np.cumsum(t.slot == 0)])
    start = start[words[start + size] - words[start] >= plain]
    return start, w.window_hashes(start, start + size)


def _whole_hashes(t: Tokens, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of whole items: of values instead of placeholders, where these must agree for want of plain words."""
    w, words = t.sequence(), np.concatenate([[0], np.cumsum(t.slot == 0)])
    values = hashing.Words(w.data, w.start, w.end, w.first, np.where(t.slot == 0, t.hash, t.slot))
    return np.where(words[end] - words[start] >= PLAIN, w.window_hashes(start, end), values.window_hashes(start, end)) ^ _WHOLE


def _item_windows(t: Tokens) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(size, whole, first tokens, hashes) of all windows of each item; an item without any is one window as a whole, a kind of its own."""
    start, h = _windows(t, WINDOW, PLAIN)
    has = np.zeros(len(t.first) - 1, bool)
    has[np.searchsorted(t.first, start, "right") - 1] = True
    parts = [(WINDOW, False, start, h)]
    for i in np.flatnonzero(~has & (np.diff(t.first) > 0)):
        a, b = t.first[i : i + 1], t.first[i + 1 : i + 2]
        parts.append((int(b[0] - a[0]), True, a, _whole_hashes(t, a, b)))
    return parts


def _document_windows(t: Tokens, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    # Whole items are shorter than a window, or too full of placeholders, whatever their size.
    start, h = _windows(t, size, 0 if whole else PLAIN)
    return start, _whole_hashes(t, start, start + size) if whole else h


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in hashing.slices(batch):
            for t in canonical(data, offsets):
                for size, whole, start, h in _item_windows(t):
                    of = np.searchsorted(t.first, start, "right") - 1
                    yield pa.RecordBatch.from_arrays([rows.column("x").take(pa.array(of)), pa.array(h.view(np.int64)), pa.array(np.full(len(start), size), pa.int32()),
                                                      pa.array(np.full(len(start), whole))], ["x", "h", "size", "whole"])


def _probe(listed: np.ndarray | None, kinds: list[tuple[int, bool]]) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in hashing.slices(batch):
                for t in canonical(data, offsets):
                    for size, whole in kinds:
                        start, h = _document_windows(t, size, whole)
                        if listed is not None:
                            hit = listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h if len(listed) else np.zeros(len(h), bool)
                            start, h = start[hit], h[hit]
                        of = np.searchsorted(t.first, start, "right") - 1
                        order = np.lexsort((h, of))
                        of, h = of[order], h[order]
                        new = np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))[: len(h)]
                        yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(of[new])) for c in ("k1", "k2")), pa.array(h[new].view(np.int64))], ["k1", "k2", "h"])

    return find


class Run:
    """Windows of an item that follow each other along one shift of a view; bounds in words and numbers of item and document."""

    __slots__ = ("i0", "i1", "d0", "d1", "view", "shift", "windows", "seed")

    def __init__(self, view: int, shift: int):
        self.view, self.shift, self.windows, self.seed = view, shift, [], False


def _meet(item: tuple[Tokens, Tokens], doc: tuple[Tokens, Tokens]) -> list[list[Run]]:
    """For each item of a slice, its runs in one document."""
    runs: list[list[Run]] = [[] for _ in range(len(item[0].first) - 1)]
    for view, (t, d) in enumerate(zip(item, doc)):
        parts: list[tuple[np.ndarray, ...]] = []
        of_kind: dict[tuple[int, bool, bool], tuple[np.ndarray, np.ndarray]] = {}
        for size, whole, start, h, seed in [*((*x, True) for x in _item_windows(t)), (SHORT, False, *_windows(t, SHORT, SHORT_PLAIN), False)]:
            kind = size, whole, seed
            if kind not in of_kind:
                place, g = _document_windows(d, size, whole) if seed else _windows(d, size, SHORT_PLAIN)
                order = np.argsort(g, kind="stable")
                of_kind[kind] = place[order], g[order]
            place, g = of_kind[kind]
            low, n = np.searchsorted(g, h), np.searchsorted(g, h, "right") - np.searchsorted(g, h)
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            parts.append((np.repeat(start, n), place[at], np.full(len(at), size), np.full(len(at), seed)))
        i, p, size, seed = (np.concatenate([x[k] for x in parts]) for k in range(4))
        of = np.searchsorted(t.first, i, "right") - 1
        order = np.lexsort((-size, i, p - i, of))
        run = None
        for o, a, b, n, begins in zip(*(x[order].tolist() for x in (of, i, p, size, seed))):
            if run is None or run_of != o or run.shift != b - a or a > end:
                run, run_of, end = Run(view, b - a), o, a
                runs[o].append(run)
            run.windows.append((a, b, n, SHORT_PLAIN if not begins else PLAIN))
            run.seed |= begins
            end = max(end, a + n)
        for mine in runs:
            for r in mine:
                if r.view == view:
                    last = max(a + n for a, _, n, _ in r.windows)
                    r.i0, r.i1 = int(t.at[r.windows[0][0]]), int(t.at[last])
                    r.d0, r.d1 = int(d.at[r.windows[0][1]]), int(d.at[last + r.shift])
    return runs


def _fit(r: Run, taken: list[Run]) -> bool:
    """Whether a run lies in the order of the taken ones, ``DRIFT`` off its neighbours at most."""
    left = right = None
    for q in taken:
        if q.i1 <= r.i0 or r.i1 <= q.i0:
            a, b = (q, r) if q.i1 <= r.i0 else (r, q)
            if not (a.d0 < b.d0 and a.d1 < b.d1):
                return False
            if a is q:
                left = q if left is None or q.i1 > left.i1 else left
            else:
                right = q if right is None or q.i0 < right.i0 else right
        elif q.d1 <= r.d0 or r.d1 <= q.d0 or min(abs((q.d0 - q.i0) - (r.d0 - r.i0)), abs((q.d1 - q.i1) - (r.d1 - r.i1))) > DRIFT:
            return False
    return all(abs((b.d0 - a.d1) - (b.i0 - a.i1)) <= DRIFT for a, b in ((left, r), (r, right)) if a and b)


def _judge(runs: list[Run], reach: list[set[int]], at: list[list[int]], of_item: list[list[int]], of_doc: list[list[int]]) -> tuple[int, int, int]:
    """(tokens, covered tokens, changed slot values) of one item in one document, for the alignment that covers most of the item."""
    order = sorted(runs, key=lambda r: (r.i0 - r.i1, r.d0, r.view))
    span = max(r.i1 for r in runs) - min(r.i0 for r in runs) + 16
    best = (-1.0, max(map(len, reach)), 0, 0)
    for anchor in (r for r in order if r.seed):
        near = [r for r in order if r is not anchor and r.d0 <= anchor.d1 + 2 * span and r.d1 >= anchor.d0 - 2 * span]
        meets: dict[int, int] = {}
        covered: set[int] = set()
        taken: list[Run] = []
        more = [anchor]
        while more:
            for r in more:
                some = False
                for a, b, n, plain in r.windows:
                    pairs = [(x, y) for x, y in zip(of_item[r.view][a : a + n], of_doc[r.view][b : b + n]) if x]
                    new = dict(pairs)
                    # A template of hardly any words matches too much: there the values must agree.
                    loose = n - len(pairs) >= plain
                    if all(new[x] == y and meets.get(x, y) == y and (loose or x == y) for x, y in pairs):
                        meets |= new
                        covered.update(range(at[r.view][a], at[r.view][a + n]))
                        some = True
                if some:
                    taken.append(r)
            near = [r for r in near if r not in more]
            more = next(([r] for r in near if taken and _fit(r, taken)), [])
        for x in reach:
            if x and (share := len(covered & x) / len(x)) > best[0]:
                best = share, len(x), len(covered & x), sum(a != b for a, b in meets.items())
        if best[0] == 1:
            break
    return best[1:]


_FOUND = "k1 long, k2 long, doc_id long, item_id long, n_tokens long, n_covered long, n_changed long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document beside the items that it shares windows with."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            (_, data, offsets), = hashing.slices(row)
            doc = canonical(data, offsets)
            of_doc = [t.slot.tolist() for t in doc]
            items = row.column("items").flatten()
            out: list[tuple] = []
            for part, data, offsets in hashing.slices(pa.RecordBatch.from_arrays([items.field("item_id"), items.field("item_text")], ["item_id", "text"])):
                item = canonical(data, offsets)
                at, of_item = [t.at.tolist() for t in item], [t.slot.tolist() for t in item]
                reach: list[list[set[int]]] = [[set(), set()] for _ in range(part.num_rows)]
                for view, t in enumerate(item):
                    for size, _, start, _ in _item_windows(t):
                        for o, a in zip((np.searchsorted(t.first, start, "right") - 1).tolist(), start.tolist()):
                            reach[o][view].update(range(at[view][a], at[view][a + size]))
                for o, runs in enumerate(_meet(item, doc)):
                    if runs:
                        out.append((part.column("item_id")[o].as_py(), *_judge(runs, reach[o], at, of_item, of_doc)))
            yield pa.RecordBatch.from_arrays([
                *(row.column(c).take(pa.array(np.zeros(len(out), np.int64))) for c in ("k1", "k2", "doc_id")),
                *(pa.array([x[j] for x in out], pa.int64()) for j in range(4))], ["k1", "k2", "doc_id", "item_id", "n_tokens", "n_covered", "n_changed"])


def find_items(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, listed: int = LISTED) -> DataFrame:
    """(k1, k2, doc_id, item_id, n_tokens, n_covered, n_changed, coverage): documents that hold benchmark items; k1, k2 as in ``keyed``.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). Null and empty texts hold nothing and are held by nothing. Equal documents
    give one row for each item; of an item_id that is null or repeats, the text that is covered best counts. n_changed counts slot
    values that differ. Other columns are not read. An empty table on either side gives an empty result.
    """
    rows = keyed(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    items = items.withColumn("x", F.xxhash64(F.coalesce("item_id", F.lit(NO_ID)), "text"))
    windows = freeze(items.mapInArrow(_index, "x long, h long, size int, whole boolean").distinct(), "benchmark-windows")
    n, kinds = windows.agg(F.count(F.lit(1)), F.collect_set(F.struct("size", "whole"))).first()
    hashes = np.unique(windows.select("h").distinct().toArrow()["h"].to_numpy().view(np.uint64)) if n <= listed else None
    hits = rows.mapInArrow(_probe(hashes, sorted(tuple(x) for x in kinds)), "k1 long, k2 long, h long")
    pairs = hits.join(windows.select("x", "h").distinct(), "h").select("k1", "k2", "x").distinct()
    # A document's pairs are numbers only; texts of items are gathered in rows of bounded size.
    dealt = pairs.withColumn("part", F.floor((F.row_number().over(W.partitionBy("k1", "k2").orderBy("x")) - 1) / BESIDE))
    beside = dealt.join(items.withColumnRenamed("text", "item_text"), "x").groupBy("k1", "k2", "part").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    judged = rows.join(freeze(beside, "benchmark-candidates"), ["k1", "k2"]).select("k1", "k2", "doc_id", "text", "items").mapInArrow(_compare, _FOUND)
    judged = judged.withColumn("coverage", F.col("n_covered") / F.col("n_tokens")).where(F.col("coverage") >= covered)
    best = F.max(F.struct("coverage", (-F.col("n_changed")).alias("less"), "doc_id", "n_tokens", "n_covered", "n_changed")).alias("x")
    return judged.groupBy("k1", "k2", "item_id").agg(best).select(
        "k1", "k2", "x.doc_id", "item_id", "x.n_tokens", "x.n_covered", "x.n_changed", "x.coverage")
