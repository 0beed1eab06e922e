from __future__ import annotations

import pytest

from sourcegauge.operators.rollup import Dimension
from sourcegauge.plans.pipelines import classify_csv
from sourcegauge.sources.upload import auto_map, check_mapping, parse_rows, read_csv, require_rows

CSV = '''Sub ID,TrafficType,vertical_name,Internal Channel,Placement,ad_source,call_volume,Calls_Over_Threshold,lead_volume,Transfers,revenue,Total_Revenue
A1,Full O&O,Health,Premium,"two
lines","He said ""hi""",1000,140,1000,90,"1,500",12abc
A2,Full O&O,Health,,p,,1000 calls,x,,,$5,9

,Full O&O,Health,,p,,1,1,1,1,1,1
A3,,Health,,p,,1,1,1,1,1,1
A4,Full O&O,,,p,,1,1,1,1,1,1
A1,Full O&O,Health,Standard,q,,10,1,10,1,1,1
'''


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "upload.csv"
    path.write_text(CSV)
    return str(path)


def test_auto_map_takes_the_first_header():
    mapping = auto_map(["x", "Sub ID", "subid", "Total  Revenue", "revenue", "TrafficType"])
    assert mapping == {"subid": "Sub ID", "total_revenue": "Total  Revenue", "traffic_type": "TrafficType"}
    with pytest.raises(ValueError, match="vertical"):
        check_mapping(mapping)


def test_parse_rows(spark, csv_file):
    rows = parse_rows(read_csv(spark, csv_file)).orderBy("ord").collect()
    assert [r.sub_id for r in rows] == ["A1", "A2", "A1"]
    first, second, _ = rows
    assert first.placement == "two\nlines" and first.source_name == 'He said "hi"'
    assert first.total_revenue == 1.0  # 'revenue' stands before 'Total_Revenue'
    assert (second.internal_channel, second.total_calls, second.calls_over_threshold, second.total_revenue) == (None, 1000, 0, 0)
    assert second.source_name == "" and second.lead_volume == 0 and second.paid_calls == 0


def test_file_order_survives_many_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("subid,vertical,traffic_type\n" + "".join(f"S{i:06d},Health,Full O&O\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_csv(spark, str(path), multi_line=False)
        assert raw.rdd.getNumPartitions() > 5
        ids = [r.sub_id for r in parse_rows(raw).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ids == sorted(ids) and len(ids) == 20000


def test_empty_upload_is_refused(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("subid,vertical,traffic_type\n")
    with pytest.raises(ValueError):
        require_rows(read_csv(spark, str(path)))


def test_classify_csv(spark, csv_file):
    rows = {(r.sub_id, r.internal_channel): r for r in classify_csv(spark, csv_file).collect()}
    assert rows[("A1", "Premium")].action == "keep_premium"
    assert rows[("A1", "Standard")].action == "insufficient_volume"
    overall = classify_csv(spark, csv_file, Dimension.OVERALL).collect()
    assert sorted(r.sub_id for r in overall) == ["Health - Full O&O Premium", "Health - Full O&O Standard"]
