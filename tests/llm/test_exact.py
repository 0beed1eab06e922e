"""Repeated passages, near duplicates and line quality against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from sourcegauge.llm import neardup, quality, substrings

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_repeats(docs, nothing):
    rows = [(r.doc_id, SPLIT.findall(r.text or "")) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    wanted = []
    for doc_id, w in rows:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        wanted.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substrings.remove_repeats(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(wanted, key=key)
    assert all(sum(s.last - s.first + 1 for s in r.removed) == r.n_removed for r in got)
    assert sum(r.n_removed > 0 for r in got) > 8
    assert substrings.remove_repeats(nothing).count() == 0
    # Small chunks of the same texts, more of them than shuffle partitions ask for.
    again = substrings.remove_repeats(docs, chunk_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def _components(rows):
    """Links by comparing all sets; the smallest id of each component."""
    sets = []
    for _, text in rows:
        w = SPLIT.findall(lower(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                group[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)].append(doc_id)
    return [(doc_id, len(s), min(ids[root(i)], default=None) if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def test_near_duplicates(docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = neardup.near_duplicates(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    wanted = _components(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(wanted, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert neardup.near_duplicates(nothing).count() == 0


def _variants(seed, n, length, changes):
    """Copies of one text with some words changed, and copies of these: similarities around the threshold, few alike, many near."""
    rng = random.Random(seed)
    base, out = [f"b{i}" for i in range(length)], []
    for i in range(n):
        w = list(rng.choice(out) if out and rng.random() < 0.1 else base)
        for j in rng.sample(range(len(w)), rng.choice(changes)):
            w[j] = f"x{rng.randrange(40)}" if rng.random() < 0.3 else f"x{i}y{j}"
        out.append(w[: length - rng.choice((0, 0, 0, 3, 10))])
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("few, keys, length, changes", [
    (16, 500, 150, (2, 3, 3, 4)), (0, 500, 150, (0, 1, 2, 5, 8)), (0, 0, 150, (0, 1, 2, 5, 8)), (0, 500, 40, (1, 1, 2))])
def test_groups_around_the_threshold(spark, monkeypatch, few, keys, length, changes):
    """Long lists are compared by differences; whichever way the pairs are found, the components are those of all pairs."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "KEYS", keys)
    texts = _variants(length + len(changes), 160, length, changes)
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:20], *_variants(5, 30, 90, (2, 3))])] + [(3, texts[3])] * 3
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(_components(rows))


def test_no_group_is_paired_all_with_all(spark, monkeypatch):
    """Texts a little less alike than the threshold asks for: some pairs for each, not a part of all pairs."""
    seen, verified = [], neardup._verified

    def counted(pairs, *tables):
        seen.append(pairs.distinct().count())
        return verified(pairs, *tables)

    monkeypatch.setattr(neardup, "_verified", counted)
    rng = random.Random(1)
    rows = []
    for i in range(300):
        w = [f"b{k}" for k in range(300)]
        for k in rng.sample(range(300), 4):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(_components(rows))
    assert sum(seen) <= 20 * len(rows)


def test_exact_needs_no_sketches(spark, docs, monkeypatch):
    """Where a sketch filter that asks for too much loses links, the exact way has them all."""
    monkeypatch.setattr(neardup, "SHARED", 40)
    rows = [(1000 + i, t) for i, t in enumerate(_variants(9, 60, 150, (0, 2, 4, 6)))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = sorted(map(str, _components([(r.doc_id, r.text) for r in table.collect()])))
    found = {e: sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in neardup.near_duplicates(table, exact=e).collect()) for e in (False, True)}
    assert found[True] == wanted != found[False]


def test_near_duplicates_of_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == set(_components(rows))


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60) if i % 20 != 19] + [("z", "n005"), ("n041", "n041")]
    got = dict(neardup.components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert got == {**{f"n{i:03d}": f"n{i // 20 * 20:03d}" for i in range(60)}, "z": "n000"}


def test_later_links_join_labels(spark, monkeypatch):
    """After the first links only labels are walked, and no further pairs pass by sketches."""
    labels = spark.createDataFrame([("b", "a"), ("d", "c"), ("e", "c")], "node string, label string")
    links = spark.createDataFrame([("c", "a"), ("z", "c"), ("y", "x")], "u string, v string")
    assert sorted(map(tuple, neardup._merged(labels, links).collect())) == [("b", "a"), ("c", "a"), ("d", "a"), ("e", "a"), ("y", "x"), ("z", "a")]
    names, freeze = [], neardup.freeze
    monkeypatch.setattr(neardup, "freeze", lambda df, name: (names.append(name), freeze(df, name))[1])
    rows = list(enumerate(_variants(3, 40, 60, (0, 1, 2))))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(_components(rows))
    assert names.count("likely") == 1


def test_quality(docs, nothing):
    for r, text in [(r, r.w) for r in quality.measure(docs).join(docs.selectExpr("doc_id", "text w").distinct(), "doc_id").where("doc_id <> 3").collect()]:
        text = text or ""
        w, lines = SPLIT.findall(text), [x for x in text.split("\n") if SPLIT.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed), r.doc_id
        assert not (failed and r.kept)
    assert quality.measure(nothing).count() == 0


def test_lines(spark):
    good = "The committee met on Monday and agreed on the plan that had been put before it in the spring of that year."
    bad = ["Home | News | Sports | Contact", "Sign in", "WIN!! BIG!! NOW!! TODAY!!", "$$$ *** ### |||", "All rights reserved."]
    rows = [(1, "\n".join([good] * 1 + [good.replace("plan", f"plan {i}") for i in range(4)] + bad)), (2, "\n".join([*bad * 20, good]))]
    got = {r.doc_id: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_bad_lines == len(bad) and got[1].clean_text.count("\n") == 4
    assert got[2].n_bad_lines == 20 * len(bad) and got[2].kept is False

