"""Transaction facts and source dimension shaped from a star schema of order lines.

One SQL text per table, valid in Spark and in other engines, so that both sides of a
comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Every order line is a fact. Some suppliers' lines are redirects, which makes them sources of low volume.
_FACTS = """
SELECT 'SUB' || lpad(CAST(s.s_suppkey AS VARCHAR(20)), 5, '0') AS sub_id,
       CASE s.s_nationkey % 5 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Health' WHEN 2 THEN 'Life'
            WHEN 3 THEN 'Auto' ELSE 'Home' END AS vertical,
       l.l_orderkey AS session_id,
       CAST(l.l_shipdate AS DATE) AS date_platform,
       CASE WHEN l.kind <= 2 THEN 'Lead' WHEN l.kind <= 5 THEN 'Call'
            WHEN l.kind = 6 THEN 'Click' ELSE 'Redirect' END AS transaction_type,
       CASE WHEN l.kind BETWEEN 3 AND 5
            THEN CASE WHEN l.l_partkey % 48 = 0 THEN 'Outbound' ELSE 'Inbound' END END AS call_category,
       CASE WHEN l.kind BETWEEN 3 AND 5 THEN 1 ELSE 0 END AS call_transfers,
       CASE WHEN l.kind BETWEEN 3 AND 5 AND l.l_returnflag <> 'R' THEN 1 ELSE 0 END AS paid_calls,
       CASE WHEN l.kind BETWEEN 3 AND 5
            THEN l.l_quantity * (20 + (s.s_suppkey * 37) % 45) END AS call_duration,
       CASE WHEN l.kind = 6 THEN 1 + l.l_partkey % 3 ELSE 0 END AS clicks,
       {detail_columns}
       floor(l.l_extendedprice * (1 - l.l_discount) / 10 + 0.5e0) * 1e0 AS revenue
FROM (SELECT *, CASE WHEN l_suppkey % 10 = 9 AND l_orderkey % 12 <> 0 THEN 7
                     WHEN l_suppkey % 10 = 8 AND l_linenumber <= 2 AND l_orderkey % 2 = 0 THEN 7
                     ELSE l_linenumber END AS kind
      FROM {{lineitem}}) l
JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey
{detail_joins}
"""
FACTS_SQL = _FACTS.format(
    detail_columns="o.o_custkey AS user_id, p.p_brand AS placement, o.o_orderpriority AS channel,",
    detail_joins="LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey LEFT JOIN {part} p ON l.l_partkey = p.p_partkey",
)
# The same rows without the columns that need orders and part.
LINK_FACTS_SQL = _FACTS.format(detail_columns="", detail_joins="")

_SNAPSHOT_SQL = """
SELECT 'SUB' || lpad(CAST(s_suppkey AS VARCHAR(20)), 5, '0') AS subid,
       {tier} AS tier,
       'Source ' || CAST(s_suppkey AS VARCHAR(20)) AS description,
       CASE s_suppkey % 2 WHEN 0 THEN 'Digital' ELSE 'TV' END AS channel,
       CASE s_suppkey % 3 WHEN 0 THEN 'Full O&O' WHEN 1 THEN 'Partial O&O' ELSE 'Non O&O' END AS traffic_type,
       CASE s_nationkey % 5 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Health' WHEN 2 THEN 'Life'
            WHEN 3 THEN 'Auto' ELSE 'Home' END AS vertical_name,
       CASE s_suppkey % 7 WHEN 0 THEN 'Google' WHEN 1 THEN 'Bing' WHEN 2 THEN 'Facebook'
            WHEN 3 THEN 'Direct' WHEN 4 THEN 'Affiliate' WHEN 5 THEN '' ELSE 'Email' END AS source_name,
       CASE s_suppkey % 4 WHEN 0 THEN 'Search' WHEN 1 THEN 'Social' WHEN 2 THEN 'Display'
            ELSE 'Native' END AS media_type_name,
       CASE s_suppkey % 3 WHEN 0 THEN 'Acquisition' WHEN 1 THEN 'Branding' ELSE 'Retention' END AS campaign_type,
       CAST('{day}' AS DATE) AS snapshot_date
FROM {{supplier}}
"""
DIMENSION_SQL = (
    _SNAPSHOT_SQL.format(
        tier="CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 1 THEN 2 END", day="2001-11-05"
    )
    + " UNION ALL "
    + _SNAPSHOT_SQL.format(tier="CASE s_suppkey % 2 WHEN 0 THEN 2 ELSE 1 END", day="2001-10-05")
)

# Decisions as they might come out of an event log.
HISTORY_SQL = """
SELECT 'SUB' || lpad(CAST(user_id % 40 AS VARCHAR(20)), 5, '0') AS sub_id,
       CASE user_id % 5 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Health' WHEN 2 THEN 'Life'
            WHEN 3 THEN 'Auto' ELSE NULL END AS vertical,
       CASE user_id % 3 WHEN 0 THEN 'Full O&O' WHEN 1 THEN 'Partial O&O' ELSE 'Non O&O' END AS traffic_type,
       CASE user_id % 4 WHEN 0 THEN 'Search' WHEN 1 THEN 'Social' WHEN 2 THEN '' END AS media_type,
       CASE event_type WHEN 'view' THEN 'correct' WHEN 'click' THEN 'promote' WHEN 'purchase' THEN 'demote'
            WHEN 'error' THEN 'pause' ELSE 'below' END AS action_taken,
       CASE event_type WHEN 'view' THEN 'Maintained Current' WHEN 'click' THEN 'Promoted to Premium'
            WHEN 'error' THEN 'PAUSED' END AS action_label,
       CASE event_id % 2 WHEN 0 THEN 'Premium' ELSE 'Standard' END AS previous_state,
       CASE event_type WHEN 'click' THEN 'Premium' WHEN 'purchase' THEN 'Standard' WHEN 'error' THEN 'PAUSED' END AS new_state,
       'both' AS metric_mode,
       CAST(NULL AS DOUBLE) AS call_quality,
       CAST(NULL AS DOUBLE) AS lead_quality,
       CASE event_id % 9 WHEN 0 THEN NULL ELSE value END AS total_revenue,
       CASE event_id % 3 WHEN 0 THEN props END AS notes,
       CASE event_id % 4 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Ben' WHEN 2 THEN 'Chi' END AS taken_by,
       ts AS created_at,
       event_id
FROM {events}
"""


class StarTables:
    """The adapter over one folder of tables; each table is opened once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    def _sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.table(n) for n in names})

    def facts(self) -> DataFrame:
        """Transaction facts with all columns."""
        return self._sql(FACTS_SQL, "lineitem", "supplier", "orders", "part")

    def link_facts(self) -> DataFrame:
        """The same rows without placement and channel."""
        return self._sql(LINK_FACTS_SQL, "lineitem", "supplier")

    def dimension(self) -> DataFrame:
        """Source dimension in two snapshots."""
        return self._sql(DIMENSION_SQL, "supplier")

    def decisions(self) -> DataFrame:
        """Decision records made from the event log."""
        return self._sql(HISTORY_SQL, "events").withColumn("created_at", F.col("created_at").cast("timestamp"))
