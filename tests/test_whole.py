"""Nothing is cut: every line is a fact, every member is listed; stores and frozen tables behave."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from helpers import record, records, source, sources
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from sourcegauge import session
from sourcegauge.operators import scenarios
from sourcegauge.operators.decisions import search_history
from sourcegauge.operators.rollup import rollup
from sourcegauge.operators.views import locate, page_count, page_of
from sourcegauge.plans.pipelines import Analysis
from sourcegauge.session import freeze, frozen_until_done, shared_folder
from sourcegauge.sinks.history import HistoryStore
from sourcegauge.sinks.listing import StoredView
from sourcegauge.sinks.runs import RunStore
from sourcegauge.sources.star import StarTables
from sourcegauge.sources.upload import auto_map, guess_separator, header_names, parse_rows, read_csv, rows_of_report


def test_every_line_is_a_fact(spark, tables):
    star = StarTables(spark, tables)
    assert star.facts().count() == star.link_facts().count() == star.table("lineitem").count()


def test_members_are_whole(spark):
    rows = [record(i, action="keep_standard", call=0.09, lead=0.055, revenue=100 + i) for i in range(30)]
    a = Analysis(records(spark, rows))
    listed = dict(scenarios.scenario_members(a.insights).groupBy("scenario_no").count().collect())
    assert listed == {r.scenario_no: r.affected_count for r in a.scenarios.collect()}
    assert scenarios.scenario_members(a.insights, sample=3).where("scenario_no = 4").count() == min(3, listed.get(4, 0))


def test_order_of_a_report_is_a_key(spark):
    texts = ", ".join(f"'' AS {c}" for c in ("channel", "placement", "description", "source_name", "media_type", "campaign_type"))
    numbers = ", ".join(f"1 AS {c}" for c in ("call_volume", "paid_calls", "calls_over_threshold", "call_revenue", "total_leads_dialed", "leads_transferred",
                                              "lead_revenue", "click_volume", "click_revenue", "redirect_volume", "redirect_revenue", "total_calls", "lead_volume"))
    report = spark.sql(f"SELECT sub_id, 'Medicare' AS vertical, fact_vertical, 'Full O&O' AS traffic_type, '' AS internal_channel, {texts}, {numbers}, revenue AS total_revenue "
                       "FROM VALUES ('A', 'Medicare', 10), ('A', 'Health', 10), ('B', 'Life', 20) AS t(sub_id, fact_vertical, revenue)")
    rows = rows_of_report(report).orderBy("ord").collect()
    assert [r.sub_id for r in rows] == ["B", "A", "A"] and len({r.ord for r in rows}) == 3


def test_headers(spark, tmp_path):
    assert [guess_separator(h) for h in ("a;b;c,d", "a,b", "a\tb", "a|b", "alone")] == [";", ",", "\t", "|", ","]
    assert header_names("Channel,channel,,Media Type", ",") == ["Channel", "_c1", "_c2", "Media Type"]
    path = tmp_path / "up.csv"
    path.write_text("Sub ID;Vertical;vertical;Traffic Type;Channel;channel;Revenue\nS1;Health;x;Full O&O;a;b;7\n")
    raw = read_csv(spark, str(path))
    row = parse_rows(raw, auto_map(raw.columns)).first()
    assert (row.sub_id, row.vertical, row.traffic_type, row.total_revenue) == ("S1", "Health", "Full O&O", 7.0)
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no data"):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_odd_run_ids(spark, tmp_path):
    for run_id in ("q%41", "a/b", "../x"):
        with pytest.raises(ValueError, match="run id"):
            RunStore(spark, str(tmp_path)).write(records(spark, [record(1)]), run_id=run_id)


def test_days_of_a_store(spark, tmp_path, tables):
    store = HistoryStore(spark, f"{tmp_path}/h")
    assert store.read().count() == 0
    store.append(StarTables(spark, tables).decisions())
    found = search_history(store.read(), date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 7))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(created_day" in plan
    assert 0 < found.count() == store.read().where("created_at >= DATE'2024-01-05' AND created_at < DATE'2024-01-08'").count()


def test_frozen_tables_have_an_owner(spark):
    folder = f"{shared_folder(spark).removeprefix('file:')}/frozen"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with frozen_until_done(spark):
        assert freeze(spark.range(5), "owned").count() == 5
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_file_folder_of_a_cluster(spark, monkeypatch):
    """On a cluster a file: folder is taken if rows written all over the cluster are found there again, else refused."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_shared", {}, raising=False)
    folder = shared_folder(spark)
    assert freeze(spark.range(5), "on-a-cluster").count() == 5 and not [x for x in os.listdir(folder.removeprefix("file:")) if x.startswith("shared-")]

    # As it is where each machine has the folder for its own: only the rows of tasks beside the driver are there after the write.
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: write(self._df.where("id < 1").write, path))
    assert shared_folder(spark) == folder  # found to be shared, not tried again
    monkeypatch.setattr(session, "_shared", {})
    with pytest.raises(RuntimeError, match="a folder of one machine"):
        shared_folder(spark)


def test_rollup_sums_without_copies(spark):
    rows = sources(spark, [source(1, "a", placement="p"), source(2, "b", placement="q")])
    plan = rollup(rows, "placement")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert not [line for line in plan.split("\n") if "SortAggregate" in line and "sum(" in line]


def test_deep_pages(spark):
    view = records(spark, [record(i, revenue=i % 7) for i in range(60)])
    for number in (1, 3, 8):
        near = [r.ord for r in page_of(view, number, 8).collect()]
        assert sorted(near) == sorted(r.ord for r in page_of(view, number, 8, deep=True).collect())
    assert tuple(page_count(view, 8).first()) == (60, 8)


@pytest.mark.parametrize("direction", ["desc", "asc", None])
def test_stored_view(spark, tmp_path, direction):
    """Pages and places of a stored view are those of the view, out of one or two files."""
    # Revenues repeat, some are missing; sources repeat, and one has no name.
    view = records(spark, [record(i, f"S{i * 7 % 90:03d}", revenue=i % 7) for i in range(120)]).withColumns({
        "total_revenue": F.when(F.col("ord") % 11 != 0, F.col("total_revenue")), "sub_id": F.nullif("sub_id", F.lit("S007")),
        "position": F.lit("mine"), "row": F.lit("mine")})
    stored = StoredView.write(view.repartition(5), str(tmp_path / "a view"), direction, rows_per_file=10)
    assert tuple(stored.count(8).first()) == (120, 15) == tuple(page_count(view, 8).first())
    for number in (1, 2, 9, 15, 16, 40_001):
        got = stored.page(number, 8)
        assert got.collect() == page_of(view, number, 8, direction).collect() and got.columns == view.columns
        assert len(got.inputFiles()) <= 2
    for wanted in (["S014"], ["S021", "S083", "absent"], []):
        got = stored.locate(wanted, 8)
        assert sorted(got.collect()) == sorted(locate(view, wanted, 8, direction).collect())
        assert len(got.inputFiles()) <= len(wanted)
    every = sorted(stored.locate(view, 8).collect())
    assert every == sorted(locate(view, view.where("sub_id IS NOT NULL"), 8, direction).collect()) and len(every) == 89


def test_stored_view_of_nothing(spark, tmp_path):
    stored = StoredView.write(records(spark, []), str(tmp_path / "v"))
    assert tuple(stored.count().first()) == (0, 0) and stored.page(1).count() == 0 and stored.locate(["S001"]).count() == 0
    with pytest.raises(FileNotFoundError):  # a view whose writing failed is not read
        StoredView(spark, str(tmp_path / "w")).page(1)


def test_light_insights_do_not_sort(spark, tables):
    from sourcegauge.plans.registered import REGISTERED

    for name in ("anomalies", "portfolio_health", "what_if_members"):
        plan = REGISTERED[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan, name
