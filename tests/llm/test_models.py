"""Language identification and toxicity: held-out accuracy, exact recursions, edge cases."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcegauge.llm import langid, toxicity
from sourcegauge.llm.common import held_out

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def named(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, langid.train(docs, per_language=60, rounds=2)


def test_languages_held_out(named):
    docs, model = named
    right, n = langid.identify(docs, model).where(held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_language_of_odd_texts(named, docs, nothing):
    got = langid.identify(docs, named[1])
    assert got.count() == docs.count() and got.where("lang_score < 0 OR lang_score > 1").count() == 0
    assert {(r.lang_pred, r.lang_score) for r in got.where("text IS NULL OR trim(text) = ''").collect()} == {("und", 0.0)}
    spark = docs.sparkSession
    odd = spark.createDataFrame([(1, "12 34 !!"), (2, "…«»"), (3, "日本語" * 200), (4, "x" * 4000)], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(odd, named[1]).orderBy("doc_id").collect()] == [True, True, False, False]
    assert langid.identify(nothing, named[1]).count() == 0
    none = langid.train(nothing)
    assert none.languages == [] and langid.identify(docs, none).where("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [x.encode() for x in ("▁", "ab", "bc", "abc", "▁a", "▁ab", "▁abca", "ca")]
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 2))
    lookup, value = langid.Lookup(pieces), {x: p[i] for i, x in enumerate(pieces)}
    data = np.frombuffer(b"abcab a ca", np.uint8)
    w = langid.cut_words(data, np.array([0, len(data)]))
    got = {}
    for x in langid.lattices(w.start, w.end, lookup, langid.finder(data, lookup)):
        for k, a in zip(x.words, langid.forward(x, p, lookup.mark)[-1]):
            got[bytes(data[w.start[k] : w.end[k]])] = a
    for word, a in got.items():
        whole, total = "▁".encode() + word, np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(word)):  # the mark may stay joined to the first piece
            at = [0] + [3 + i for i, c in enumerate(cuts) if c] + [len(whole)]
            parts = [whole[x:y] for x, y in zip(at, at[1:])]
            if all(q in value for q in parts):
                total += np.prod([value[q] for q in parts], axis=0)
        assert np.allclose(a, total), word


def test_expected_counts():
    pieces = [bytes([b]) for b in range(256)] + [x.encode() for x in ("▁", "ab", "▁a")]
    lookup, q = langid.Lookup(pieces), np.full(259, 0.1)
    data = np.frombuffer(b"ab", np.uint8)
    (x,) = langid.lattices(np.array([0]), np.array([2]), lookup, langid.finder(data, lookup))
    got = langid.expected(x, q, lookup.mark, np.array([3.0]))
    # ▁ a b (0.001), ▁ ab (0.01), ▁a b (0.01)
    share = 3 / 0.021
    assert np.allclose([got[pieces.index(y)] for y in (b"a", b"b", b"ab", "▁a".encode(), "▁".encode())],
                       [0.001 * share, 0.011 * share, 0.01 * share, 0.01 * share, 0.011 * share])


def test_long_words_are_not_cut():
    """Byte by byte and length by length give the same sums and expected counts; words of any length keep all segmentations."""
    pieces = [bytes([b]) for b in range(256)] + [x.encode() for x in ("▁", "ab", "bc", "abc", "▁a", "▁ab", "▁abca", "ca", "abcabcabcabc")]
    rng = np.random.default_rng(2)
    p, lookup = rng.random((len(pieces), 2)) / 50, langid.Lookup(pieces)
    for size in (1, 2, 5, 17, 32):
        data = np.frombuffer((b"abcabcab" * 9)[:size] + b"abc", np.uint8)  # what follows the word must not count
        find = langid.finder(data, lookup)
        (x,) = langid.lattices(np.array([0]), np.array([size]), lookup, find)
        word = langid.LongWord(0, size, lookup, find)
        assert np.allclose(word.forward(p), np.log(langid.forward(x, p, lookup.mark)[-1][0]))
        assert np.allclose(word.expected(p[:, 0], 3.0), langid.expected(x, p[:, 0], lookup.mark, np.array([3.0])))
    # A plain recursion over a word of two stretches, in logarithms.
    long = (b"abcab" * 2000)[: 2 * langid.STRETCH + 7]
    data = np.frombuffer(long, np.uint8)
    value, mark = {x: np.log(p[i, 0]) for i, x in enumerate(pieces)}, "▁".encode()
    plain = [value[mark]] + [-np.inf] * len(long)
    for j in range(1, len(long) + 1):
        ways = [plain[j - n] + value[long[j - n : j]] for n in range(1, min(j, 12) + 1) if long[j - n : j] in value]
        if j <= 12 and mark + long[:j] in value:
            ways.append(value[mark + long[:j]])
        plain[j] = np.logaddexp.reduce(ways)
    word = langid.LongWord(0, len(long), lookup, langid.finder(data, lookup))
    assert np.isclose(word.forward(p)[0], plain[-1], rtol=1e-9)
    got = word.expected(p[:, 0], 1.0)
    assert np.isclose(sum(n * len(x.removeprefix(mark)) for n, x in zip(got, pieces)), len(long))


def _model():
    pieces = [bytes([b]) for b in range(256)] + [x.encode() for x in ("▁", "ab", "bc", "abc", "▁a", "▁ab", "ca")]
    p = np.random.default_rng(3).random((len(pieces), 3))
    return langid.Model(["x", "y", "z"], pieces, p / p.sum(axis=0))


def _scored(model, texts, rows=100):
    batches = (pa.array(texts[i : i + rows], pa.string()) for i in range(0, len(texts), rows))
    return [(x["lang"], x["score"]) for out in langid.predict(model)(batches) for x in out.to_pylist()]


def test_remembered_words_score_alike(monkeypatch):
    """However few words are kept and however small slices are, short words, long ones and texts without words score the same."""
    rng = np.random.default_rng(4)
    some = ["".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(300)] + ["abc" * 40, "é" * 300]
    texts = [None, "", "12 …", *[" ".join(rng.choice(some, rng.integers(1, 12))) for _ in range(400)], "", None]
    alone = [x for t in texts for x in _scored(_model(), [t])]
    for kept, limit in ((langid.KEPT, langid.SLICE), (langid.KEPT, 300), (400, 300), (40, 1000), (0, 300)):
        monkeypatch.setattr(langid, "KEPT", kept)
        monkeypatch.setattr(langid, "SLICE", limit)
        assert _scored(_model(), texts) == alone
    assert {x for x, _ in alone} == {"und", "x", "y", "z"}


def test_scoring_holds_little():
    """A worker's memory for scoring does not follow the size of its batches."""
    rng = np.random.default_rng(5)
    some = np.array(["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(5000)])
    texts = [" ".join(rng.choice(some, 1000)) for _ in range(1000)]  # 7 MB
    tracemalloc.start()
    try:
        _scored(_model(), texts, 1000)
        assert tracemalloc.get_traced_memory()[1] < 120 << 20
    finally:
        tracemalloc.stop()


def test_toxicity_held_out(spark, docs, nothing):
    documents, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    got = toxicity.score_toxicity(documents, model).join(labels, "doc_id").where(held_out())
    right = got.agg(F.avg(((F.col("toxicity") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.95
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == docs.count() and scored.where("toxicity IS NULL OR toxicity < 0 OR toxicity > 1").count() == 0
    assert toxicity.score_toxicity(nothing, model).count() == 0
    empty = toxicity.train(nothing, labels)
    assert len(empty.weights) == 0 and toxicity.score_toxicity(docs, empty).where("toxicity >= 0.5").count() == 0


def test_penalty_takes_weight_from_groups():
    rng = np.random.default_rng(2)
    bad, group = rng.random(400) < 0.3, rng.random(400) < 0.5
    group |= bad & (rng.random(400) < 0.8)  # toxic texts name the group more often
    x = np.stack([bad * (rng.random(400) < 0.7), group, rng.random(400) < 0.5], 1).astype(np.float32)
    changed = np.tile(np.array([[0, 1, 0]], np.float32), (50, 1))
    free, _ = toxicity.fit(x, bad.astype(float), changed[:0])
    held, _ = toxicity.fit(x, bad.astype(float), changed, penalty=5.0)
    assert free[1] > 0.5 and abs(held[1]) < 0.2 and held[0] > 1


GROUPS = "christian jewish hindu buddhist".split()
PLAIN = "the neighbour bakes bread walks home reads books plays music paints houses grows apples sings songs builds boats cleans rooms writes letters".split()


def _sentences(n, rng, named):
    """(text, toxic): rude words in three of five toxic texts; ``named``: share of toxic and of other texts that name one certain group."""
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.4
        words = list(rng.choice(PLAIN, 9))
        if toxic and rng.random() < 0.6:
            words += list(rng.choice(["rotten", "filthy", "stupid", "worthless"], 2))
        if rng.random() < named[toxic]:
            words.insert(3, "muslim")
        elif rng.random() < 0.1:
            words.insert(3, rng.choice(GROUPS))
        out.append((" ".join(map(str, words)), int(toxic)))
    return out


def test_penalty_on_labelled_sentences(spark):
    """Group names go with toxic labels in what is learned from; the penalty lowers false positives on neutral mentions of the group."""
    rng = np.random.default_rng(7)
    rows = [(i, *x) for i, x in enumerate(_sentences(900, rng, {True: 0.8, False: 0.15}))]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    # Labels may repeat, be null, and belong to no document.
    labels = labels.unionByName(labels.where("doc_id < 50")).unionByName(spark.createDataFrame([(3, None), (10**6, 1), (None, 1)], labels.schema))
    free, held = (toxicity.train(docs, labels, penalty=p) for p in (0.0, 2.0))
    again = toxicity.train(docs.repartition(5), labels.repartition(3), penalty=2.0)
    assert (again.features == held.features).all() and np.array_equal(again.weights, held.weights) and again.bias == held.bias

    neutral = spark.createDataFrame([(i, " ".join(map(str, [*rng.choice(PLAIN, 3), "muslim", *rng.choice(PLAIN, 6)]))) for i in range(200)], "doc_id long, text string")
    balanced = spark.createDataFrame([(i, *x) for i, x in enumerate(_sentences(400, rng, {True: 0.3, False: 0.3}))], "doc_id long, text string, toxic int")

    def wrong(model):
        return toxicity.score_toxicity(neutral, model).where("toxicity >= 0.5").count() / 200

    def right(model):
        return toxicity.score_toxicity(balanced, model).where("(toxicity >= 0.5) = (toxic = 1)").count() / 400

    assert wrong(free) > 0.5 and wrong(held) < 0.1
    assert right(held) >= right(free) and right(held) > 0.75


def test_swaps():
    assert toxicity.swapped("Nothing here") is None
    assert toxicity.swapped("The Women spoke") == "The men spoke"


def test_pieces_of_any_width():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    pieces, mark = langid.read_pieces(), langid.MARK.encode()
    letters = {model.id_to_piece(i) for i in range(model.get_piece_size()) if model.id_to_piece(i).removeprefix(langid.MARK).isalpha()}
    folded = {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x).encode() for x in letters}
    assert folded <= set(pieces)
    longest = max((p for p in pieces if p.startswith(mark)), key=len).removeprefix(mark)
    data = np.frombuffer(longest, np.uint8)
    lookup = langid.Lookup(pieces)
    word = langid.LongWord(0, len(data), lookup, langid.finder(data, lookup))
    assert len(longest) > 12 and len(longest) in dict(word.opening)
