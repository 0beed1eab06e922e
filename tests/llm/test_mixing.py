"""Targets and seeded samples against a plain version; the registered queries and the pipeline."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from checks.compare import database, rows_of
from sourcegauge.llm import mixing
from sourcegauge.llm.oracle import ORACLES

from tests.llm.test_exact import _components


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (whole - sum(most * sizes[s] for s in full)) / max(1, sum(w[s] for s in free))
        more = {s for s in free if level * w[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * w[s] for s in order}
        full |= more


def test_mix(docs, nothing):
    got = mixing.mix(docs).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken == r.size * r.copies <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    wanted = _targets(sizes)
    assert len(got) == docs.count() and {r.source for r in got} == set(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(nothing).count() == 0 and mixing.mix(docs.select("doc_id", "source", "text").where("text IS NULL")).first().taken == 0


@pytest.mark.parametrize("bucket", [4000, 7])
def test_ties(spark, monkeypatch, bucket):
    """Rows without ids, equal rows and a hot source meet their targets within half a document; all columns come through."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    schema = "doc_id long, source string, text string, rest int, whole string, x_source string, x_place int, x_end int, x_row string, begins int, n long, m int, copies string"
    more = (7, "mine", "mine", 1, 2, "r", 3, 4, 5, "gone")
    words = " ".join(f"w{i}" for i in range(11))
    rows = [(None, "a", f"{words} {i}" if i % 2 else words, *more) for i in range(1000)]
    rows += [(1, "b", "five words are in here", *more)] * 1000 + [(5, "c", "same id but other text " * (i % 9), *more) for i in range(300)]
    rows += [(i, "d", words * (1 + i % 5), *more) for i in range(500)] + [(9, None, None, *more)] * 50 + [(i, "e", "", *more) for i in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, schema).repartition(6)).collect()
    assert len(got) == len(rows)
    size, taken, wanted, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert (r.rest, r.whole, r.x_source, r.x_place, r.x_end, r.x_row, r.begins, r.n, r.m) == more[:9] and r.taken == r.size * r.copies <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        wanted[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    assert wanted == pytest.approx(_targets(size)) and sum(wanted.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1e-6 for s in size), (taken, wanted)


@pytest.mark.parametrize("n, share", [(1, 1.5), (7, 1.5), (40, 1.9), (40, 2.5), (5, 0.0)])
def test_levels(spark, n, share):
    sizes = {f"s{i:02d}": (i * 37) % 11 * 10 ** (i % 4) for i in range(n)}
    got = mixing.targets(spark.createDataFrame([("0" + s, 1, z) for s, z in sizes.items()], "x_source string, n_docs long, source_size long"), share=share)
    wanted = _targets(sizes, share=min(share, 2.0))
    assert {r.x_source[1:]: r.target for r in got.collect()} == pytest.approx(wanted)


def test_small_buckets(docs, monkeypatch):
    whole = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET", 2)
    assert sorted(map(str, mixing.mix(docs).collect())) == whole


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, tables, name):
    df, con = __spark_entry__.queries()[name](spark, tables), database(tables)
    con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in con.description], con.fetchall())


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, nothing, tables, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, tables)
    last = stage == corpus_pipeline.STAGES[-1][0]
    assert set(docs.columns) <= set(out.columns) if last else out.columns == docs.columns
    assert out.count() > 0 and run(spark, nothing, tables).count() == 0


def test_pipeline(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert 0 < out.select("doc_id").distinct().count() <= 200 and out.where("text LIKE '%@%.example.com%'").count() == 0


def test_pipeline_against_plain_stages(spark, tables):
    """Stages 2 to 5 by plain loops, from what the language stage keeps."""
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    left = {r.doc_id: r for r in corpus_pipeline.language_id(spark, documents, tables).collect()}
    ids = sorted(left)
    kept = [i for i, _, component in _components([(i, left[i].text) for i in ids]) if i == component]
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept = [i for i in kept if not any(x in flat(left[i].text) for x in items)]
    assert 0 < len(kept) < len(ids)

    out = corpus_pipeline.run(spark, tables).collect()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(email.search(r.text) for r in out) and all(r.n_chars == len(r.text) for r in out)
    masked = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, documents.where(documents.doc_id.isin(kept)), tables).collect()}
    sizes = defaultdict(int)
    for i in kept:
        sizes[left[i].source] += len(re.findall(r"[^\x20\x09-\x0D]+", masked[i]))
    wanted, taken, largest = _targets(sizes), defaultdict(int), defaultdict(int)
    copies = defaultdict(list)
    for r in out:
        assert r.text == masked[r.doc_id]
        taken[r.source] += r.size
        copies[r.doc_id].append(r.copy)
    for i in kept:
        largest[left[i].source] = max(largest[left[i].source], len(masked[i].split()))
    assert set(copies) <= set(kept) and all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in copies.values())
    assert all(abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1 for s in sizes)
