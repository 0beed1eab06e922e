from __future__ import annotations

import csv
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from helpers import source, sources
from sourcegauge.operators import decisions
from sourcegauge.operators.classify import classify
from sourcegauge.sinks.export import write_csv
from sourcegauge.sinks.history import HistoryStore
from sourcegauge.sinks.runs import RunStore
from test_classify import golden_sources


def test_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    classified = classify(golden_sources(spark))
    for i in range(12):
        store.write(classified.where(F.col("ord") < i), "2024-01-01", "2024-01-31", "f.csv", run_id=f"{i:03d}", created_at=dt.datetime(2024, 2, 1, i))
    latest = store.latest().collect()
    assert [r.run_id for r in latest] == [f"{i:03d}" for i in range(11, 1, -1)]
    assert (latest[0].total_records, latest[0].promote_count, latest[0].correct_count, latest[0].pause_count) == (10, 3, 7, 0)
    store.write(classified, run_id="011", created_at=dt.datetime(2024, 2, 1, 11))  # the same run again
    assert store.runs().count() == 12 and store.results().where("run_id = '011'").count() == 10
    both = store.run_with_results("003")
    assert both.count() == 3 and {r.run_total_records for r in both.collect()} == {3}
    row = both.where("sub_id = 'SUB001'").first()
    assert (row.current_tier, row.current_tier_label, row.recommended_tier, row.total_leads, row.total_clicks) == (None, "Premium", "Premium", 800, 0)
    plan = store.results().where("run_id = '003'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert len(store.write(classified)) == 32
    with pytest.raises(ValueError):
        store.write(classified, dimension="overall")


def test_decisions_and_history(spark, tmp_path):
    classified = classify(golden_sources(spark))
    made = decisions.decisions_from(classified, notes=F.lit("see CALL"), taken_by=F.lit(""), created_at=F.lit(dt.datetime(2024, 1, 5, 23, 59, 59)))
    rows = {r.sub_id: r for r in made.collect()}
    assert (rows["SUB002"].action_taken, rows["SUB002"].action_label, rows["SUB002"].previous_state, rows["SUB002"].new_state) == (
        "promote", "Promoted to Premium", "Standard", "Premium")
    assert (rows["SUB001"].action_taken, rows["SUB001"].new_state, rows["SUB001"].taken_by, rows["SUB001"].media_type) == ("correct", "Premium", None, None)
    reviewed = decisions.decisions_from(classified, action_taken=F.lit("review")).first()
    assert (reviewed.action_label, reviewed.new_state) == ("Reviewed", "Premium")
    store = HistoryStore(spark, str(tmp_path / "history"))
    store.append(made)
    other = made.limit(3).withColumns({"created_at": F.lit(dt.datetime(2024, 1, 6)), "action_label": F.lit(""), "vertical": F.lit(None).cast("string"),
                                       "notes": F.lit(None).cast("string"), "total_revenue": F.lit(None).cast("double"), "taken_by": F.lit("Ana")})
    store.append(other.withColumn("sub_id", F.when(F.col("sub_id") == "SUB001", F.lit("")).otherwise(F.col("sub_id"))))
    history = store.read()
    assert history.count() == 12
    new = decisions.latest_decisions(history, limit=2).collect()
    assert all(r.created_at == dt.datetime(2024, 1, 6) and r.vertical == "" and r.action_label == r.action_taken for r in new)
    assert decisions.latest_decisions(history, "SUB001").count() == 1
    assert decisions.search_history(history, date_to=dt.date(2024, 1, 5)).count() == 10
    assert decisions.search_history(history, date_from=dt.date(2024, 1, 6)).count() == 2
    assert decisions.search_history(history, text="call").count() == 10
    assert decisions.search_history(history, text="sub00", person="Ana").count() == 2
    assert [r.total_revenue for r in decisions.sorted_history(history, "total_revenue", "asc").collect()][:2] == [None, None]
    assert {k: [r[0] for r in v.collect()] for k, v in decisions.filter_options(history).items()} == {
        "vertical": ["Auto", "Health", "Home", "Life", "Medicare"], "traffic_type": ["Full O&O", "Non O&O", "Partial O&O"], "media_type": [], "taken_by": ["Ana"]}


def test_export(spark, tmp_path):
    rows = [source(0, "a", description='say "x", y', total_calls=30, call_revenue=1.005, total_revenue=5, lead_volume=1, lead_revenue=1 / 3),
            source(1, "b", total_revenue=7, total_calls=2.5)]
    path = str(tmp_path / "out")
    write_csv(classify(sources(spark, rows)), path)
    lines = []
    for part in sorted(glob.glob(path + "/*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            lines += list(csv.DictReader(f))
    assert [r["Sub ID"] for r in lines] == ["b", "a"] and len(lines[0]) == 34
    a = lines[1]
    assert (a["Description"], a["Call Volume"], a["Call Revenue"], a["RPLead"], a["RPClick"], a["Is Unmapped"]) == ('say "x", y', "30", "1.00", "0.3333", "", "Yes")
    assert lines[0]["Call Volume"] == "2.5"
    for dimension in ("source_name", "media_type", "overall"):
        write_csv(classify(sources(spark, rows)), str(tmp_path / dimension), dimension)


def test_a_failed_write_leaves_the_old_run(spark, tmp_path, monkeypatch):
    """Whatever step fails, readers see the old run whole; two writers of one run do not mix."""
    store = RunStore(spark, str(tmp_path))
    classified = classify(golden_sources(spark))
    assert store.runs().count() == 0 and store.results().count() == 0
    store.write(classified.where("ord < 4"), run_id="r", file_name="old")

    def broken(*args):
        raise OSError("lost")

    for name in ("run_header", "publish"):
        with monkeypatch.context() as m:
            m.setattr(f"sourcegauge.sinks.runs.{name}", broken)
            with pytest.raises(OSError):
                store.write(classified, run_id="r", file_name="new")
        assert store.results().count() == 4 and [(r.file_name, r.total_records) for r in store.runs().collect()] == [("old", 4)]
    first, second = RunStore(spark, str(tmp_path)), RunStore(spark, str(tmp_path))
    monkeypatch.setattr(first, "_manifests", store._manifests)
    first.write(classified.where("ord < 6"), run_id="r", file_name="a")
    second.write(classified.where("ord < 7"), run_id="r", file_name="b")
    assert store.results().count() == 7 and store.run_with_results("r").where("run_file_name = 'b'").count() == 7
    assert store.vacuum() == 7 and store.vacuum() == 0  # old, a: both tables; of the failed writes two results and one header
    assert store.results().count() == 7 and store.runs().count() == 1


def test_a_batch_is_appended_once(spark, tmp_path, monkeypatch):
    """Appended again after success or after a failure at any step, each decision of a batch is there once; equal decisions stay two."""
    made = decisions.decisions_from(classify(golden_sources(spark)), created_at=F.lit(dt.datetime(2024, 1, 5)))
    made = made.withColumn("created_at", F.when(F.col("sub_id") > "SUB004", F.timestamp_add("DAY", F.lit(1), "created_at")).when(F.col("sub_id") > "SUB001", F.col("created_at")))
    made = made.unionAll(made.where("sub_id <= 'SUB002'"))
    store = HistoryStore(spark, str(tmp_path / "h"))
    assert store.append(made, "b1") and not store.append(made, "b1") and store.read().count() == 12
    with monkeypatch.context() as m:  # rows are written, the batch is not marked complete
        real = HistoryStore._write
        m.setattr(HistoryStore, "_write", lambda self, rows, mode: (real(self, rows.where("sub_id < 'SUB008'"), mode), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            store.append(made, "b2")
    assert store.read().count() == 12 + 9
    assert store.append(made.repartition(3), "b2") and store.read().count() == 24
    assert sorted(store.read().groupBy("sub_id").count().collect()) == [(f"SUB{i:03d}", 4 if i <= 2 else 2) for i in range(1, 11)]
    assert store.append(made) and store.append(made) and store.read().count() == 48
    with pytest.raises(ValueError):
        store.append(made, "a/b")


def test_compaction(spark, tmp_path):
    made = decisions.decisions_from(classify(golden_sources(spark)), created_at=F.lit(dt.datetime(2024, 1, 5)))
    store = HistoryStore(spark, str(tmp_path / "h"))
    assert store.compact() == 0
    for i in range(6):
        store.append(made.withColumn("created_at", F.lit(dt.datetime(2024, 1, 5 + i % 3 // 2))), f"b{i}")
    before = sorted(map(str, store.read().collect()))
    assert store.compact(before=dt.date(2024, 1, 1)) == 0 and store.compact(most=2) == 1
    assert len(glob.glob(str(tmp_path / "h/created_day=2024-01-05/*.parquet"))) == 1 and sorted(map(str, store.read().collect())) == before
    assert not store.append(made, "b1") and store.read().count() == 60


def test_text_index(spark, tmp_path):
    """A search opens fewer files than there are days and finds what a plain search finds."""
    store = HistoryStore(spark, str(tmp_path / "a store"))
    assert store.index_texts() == 0 and store.read(text="abc").count() == 0
    made = decisions.decisions_from(classify(golden_sources(spark)), created_at=F.lit(dt.datetime(2024, 1, 1))).limit(5)
    notes = {3: "See the CALL of März", 7: "a call, again", 8: "ab", 9: "x" * 200_000 + "needle 😀 end"}
    day = F.floor(F.col("id") / 5)
    rows = spark.range(60).withColumns({
        "sub_id": F.format_string("S%03d", "id"), "notes": F.element_at(F.create_map(*[F.lit(x) for n in notes.items() for x in n]), day.cast("int")),
        "created_at": F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(days=day.cast("int"))})
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit("correct" if c == "action_taken" else None).cast(made.schema[c].dataType).alias(c) for c in made.columns])
    store.append(rows)
    assert store.index_texts() == 12 and store.index_texts() == 0

    def search(text):
        plain = sorted(map(str, decisions.search_history(store.read(), text=text).collect()))
        assert sorted(map(str, decisions.search_history(store.read(text=text), text=text).collect())) == plain
        return len(plain), len(store.read(text=text).inputFiles())

    assert search("call") == (10, 2) and search("MÄRZ") == (5, 1) and search("s017") == (1, 1)
    assert search("needle 😀 end") == (5, 1) and search("x" * 1000) == (5, 1)
    assert search("not there") == (0, 0) and search("ab") == (5, 12)  # too short to rule out a file
    store.append(rows.where("id = 15").withColumn("notes", F.lit("new call")))  # not indexed yet: read
    assert search("call") == (11, 3) and search("not there") == (0, 1)
    assert store.index_texts() == 1 and search("not there") == (0, 0)
    assert store.compact(most=1) == 1 and search("call") == (11, 2) and store.index_texts() == 1 and search("call") == (11, 2)


def test_failed_index_counts_for_nothing(spark, tmp_path, monkeypatch):
    store = HistoryStore(spark, str(tmp_path / "h"))
    store.append(decisions.decisions_from(classify(golden_sources(spark)), created_at=F.lit(dt.datetime(2024, 1, 5))))
    with monkeypatch.context() as m:  # rows are written, the note of them is not
        m.setattr("sourcegauge.sinks.textindex.publish", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.index_texts()
    assert store.texts.indexed() == set() and decisions.search_history(store.read(text="sub00"), text="sub00").count() == 9
    assert store.index_texts() > 0 and decisions.search_history(store.read(text="sub00"), text="sub00").count() == 9
