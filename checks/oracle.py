"""SQL counterparts of the registered queries.

Written as one row-wise SQL program over common table expressions, apart from the Spark
code: the session link is the plain many-to-many join, percentiles and medians are plain
window and aggregate functions, decisions one CASE. Only the SQL that shapes the star
schema into facts and sources is shared, since it is input, not operator.
"""

from __future__ import annotations

from sourcegauge.sources.star import DIMENSION_SQL, FACTS_SQL, HISTORY_SQL

NAMES = {t: t for t in ("lineitem", "supplier", "orders", "part", "events")}


# ---- text helpers -----------------------------------------------------------------------

def fixed(x: str, d: int) -> str:
    """Fixed decimals, exact halves away from zero."""
    half = f"abs(({x}) * {2 ** (d + 1)}e0) % 2 = 1"
    nudge = f"0.05e-{d}" if d else "0.05e0"
    return f"(CASE WHEN {half} THEN printf('%.{d}f', ({x}) + sign({x}) * {nudge}) ELSE printf('%.{d}f', ({x})) END)"


def pct(x: str, d: int) -> str:
    return f"({fixed(f'({x}) * 100e0', d)} || '%')"


def grouped(x: str) -> str:
    """Thousands separators, up to three decimals."""
    text = fixed(x, 3)
    whole = f"split_part({text}, '.', 1)"
    separated = f"regexp_replace(reverse(regexp_replace(reverse({whole}), '(\\d{{3}})', '\\1,', 'g')), '^(-?),', '\\1')"
    return f"({separated} || regexp_replace('.' || split_part({text}, '.', 2), '\\.?0+$', ''))"


def plain(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5e0) AS BIGINT)"


def joined(*items: str, sep: str = "; ") -> str:
    return f"concat_ws('{sep}', {', '.join(items)})"


def inset(column: str, *values: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


# ---- shared steps -----------------------------------------------------------------------

KNOWN = "vertical IN ('Medicare', 'Health', 'Life', 'Auto', 'Home') AND sub_id IS NOT NULL AND sub_id <> '' AND lower(sub_id) <> 'unknown'"
LONG_CALL = ("(({v} = 'Medicare' AND {d} >= 2700) OR ({v} = 'Life' AND {d} >= 2100) "
             "OR ({v} IN ('Health', 'Auto', 'Home') AND {d} >= 1200))")
LIMITS = {
    ("Medicare", "Full O&O"): (.09, .06, .05, .10, .015, .008, .007, .02),
    ("Medicare", "Partial O&O"): (None, .07, .06, .08, None, .008, .007, .01),
    ("Medicare", "Non O&O"): (None, .04, .03, .07, None, .005, .004, .01),
    ("Health", "Full O&O"): (.14, .07, .06, .15, .09, .05, .04, .09),
    ("Health", "Partial O&O"): (.12, .05, .04, .14, .07, .03, .02, .07),
    ("Health", "Non O&O"): (None, .04, .03, .06, None, .02, .01, .03),
    ("Life", "Full O&O"): (.10, .06, .05, .12, .015, .0075, .007, .02),
    ("Life", "Partial O&O"): (.09, .05, .04, .10, .015, .0075, .007, .02),
    ("Life", "Non O&O"): (None, .05, .03, .08, None, .005, .004, .01),
    ("Auto", "Full O&O"): (.25, .20, .19, .26, .025, .015, .014, .03),
    ("Auto", "Partial O&O"): (None, .15, .14, .16, None, .01, .009, .02),
    ("Auto", "Non O&O"): (None, .10, .09, .11, None, .008, .007, .01),
    ("Home", "Full O&O"): (.25, .20, .19, .26, .025, .015, .014, .03),
    ("Home", "Partial O&O"): (None, .10, .09, .11, None, .01, .009, .01),
    ("Home", "Non O&O"): (None, .10, .09, .10, None, .008, .007, .01),
}


def limits_cte() -> str:
    def lit(v: float | None) -> str:
        return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({v!r} AS DOUBLE)"

    rows = ", ".join(f"('{v}', '{t}', {'true' if n[0] is not None else 'false'}, {', '.join(lit(x) for x in n)})"
                     for (v, t), n in LIMITS.items())
    return f"limits(vertical, traffic_type, has_premium, cp, cs, cx, ct, lp, ls, lx, lt) AS (VALUES {rows})"


def facts_cte() -> str:
    return f"facts AS ({FACTS_SQL.format(**NAMES)}), dimension AS ({DIMENSION_SQL.format(**NAMES)})"


def window_cte(start: str | None = None, end: str | None = None, name: str = "win") -> str:
    dates = f" AND date_platform BETWEEN DATE '{start}' AND DATE '{end}'" if start else ""
    return f"{name} AS (SELECT * FROM facts WHERE {KNOWN}{dates})"


def _when(kind: str, value: str) -> str:
    return f"sum(CASE WHEN transaction_type = '{kind}' THEN {value} ELSE 0 END)"


def report_ctes(win: str = "win", tag: str = "") -> str:
    over = LONG_CALL.format(v="vertical", d="call_duration")
    link_over = LONG_CALL.format(v="l.vertical", d="c.call_duration")

    def rate(a: str, b: str, d: int) -> str:
        # Rounds the exact quotient of whole numbers, halves away from zero. round() of a
        # double quotient can miss a half (1002321 / 200 is 5011.60499... in binary).
        whole = f"((CAST({a} AS HUGEINT) * {2 * 10 ** d} + {b}) // (2 * {b}))"
        return f"CASE WHEN {b} <> 0 THEN CAST({whole} AS DOUBLE) / {10 ** d}e0 END"

    return f"""
direct{tag} AS (
  SELECT sub_id, vertical,
         first(placement ORDER BY revenue DESC NULLS LAST, placement DESC) AS top_placement,
         first(channel ORDER BY revenue DESC NULLS LAST, channel DESC) AS top_channel,
         CAST({_when('Call', 'call_transfers')} AS BIGINT) AS direct_calls,
         CAST({_when('Call', 'paid_calls')} AS BIGINT) AS direct_paid_calls,
         CAST(sum(CASE WHEN transaction_type = 'Call' AND {over} THEN call_transfers ELSE 0 END) AS BIGINT) AS direct_calls_over_threshold,
         CAST({_when('Lead', '1')} AS BIGINT) AS total_leads,
         CAST({_when('Lead', 'coalesce(revenue, 0)')} AS DOUBLE) AS lead_revenue,
         CAST({_when('Click', 'coalesce(clicks, 0)')} AS BIGINT) AS total_clicks,
         CAST({_when('Click', 'coalesce(revenue, 0)')} AS DOUBLE) AS click_revenue,
         CAST({_when('Call', 'coalesce(revenue, 0)')} AS DOUBLE) AS call_revenue,
         CAST({_when('Redirect', '1')} AS BIGINT) AS redirect_volume,
         CAST({_when('Redirect', 'coalesce(revenue, 0)')} AS DOUBLE) AS redirect_revenue,
         CAST(sum(coalesce(revenue, 0)) AS DOUBLE) AS total_revenue
  FROM {win} GROUP BY sub_id, vertical),
outbound{tag} AS (
  SELECT l.sub_id, l.vertical,
         CAST(count(DISTINCT l.session_id) AS BIGINT) AS lead_count,
         CAST(sum(coalesce(c.call_transfers, 0)) AS BIGINT) AS outbound_transfers,
         CAST(sum(coalesce(c.paid_calls, 0)) AS BIGINT) AS outbound_paid_calls,
         CAST(sum(CASE WHEN {link_over} THEN c.call_transfers ELSE 0 END) AS BIGINT) AS outbound_calls_over_threshold
  FROM (SELECT * FROM {win} WHERE transaction_type = 'Lead' AND session_id IS NOT NULL) l
  LEFT JOIN (SELECT * FROM {win} WHERE transaction_type = 'Call' AND call_category = 'Outbound') c ON l.session_id = c.session_id
  GROUP BY l.sub_id, l.vertical),
report{tag} AS (
  SELECT coalesce(s.subid, d.sub_id) AS sub_id,
         CASE s.tier WHEN 1 THEN 'Premium' WHEN 2 THEN 'Standard' ELSE '' END AS internal_channel,
         coalesce(s.traffic_type, 'Unknown') AS traffic_type,
         coalesce(s.vertical_name, d.vertical) AS vertical,
         d.direct_calls AS total_calls, d.direct_paid_calls AS paid_calls,
         {rate('d.direct_paid_calls', 'd.direct_calls', 4)} AS qr_rate,
         d.direct_calls_over_threshold AS calls_over_threshold,
         {rate('d.direct_calls_over_threshold', 'd.direct_paid_calls', 4)} AS call_quality_rate_paid,
         d.total_leads AS total_leads_dialed,
         coalesce(o.outbound_transfers, 0) AS leads_transferred,
         {rate('o.outbound_transfers', 'd.total_leads', 4)} AS lead_transfer_rate,
         d.top_placement AS placement, d.top_channel AS channel, s.description, s.source_name,
         s.media_type_name AS media_type, s.campaign_type,
         d.total_leads AS lead_volume, d.direct_calls AS call_volume, d.total_clicks AS click_volume, d.redirect_volume,
         round(d.lead_revenue, 2) AS lead_revenue, round(d.call_revenue, 2) AS call_revenue,
         round(d.click_revenue, 2) AS click_revenue, round(d.redirect_revenue, 2) AS redirect_revenue,
         {rate('d.lead_revenue', 'd.total_leads', 2)} AS rp_lead,
         {rate('d.call_revenue', 'd.direct_paid_calls', 2)} AS rp_qcall,
         {rate('d.click_revenue', 'd.total_clicks', 2)} AS rp_click,
         {rate('d.redirect_revenue', 'd.redirect_volume', 2)} AS rp_redirect,
         round(d.total_revenue, 2) AS total_revenue
  FROM direct{tag} d
  LEFT JOIN (SELECT * FROM dimension WHERE snapshot_date = (SELECT max(snapshot_date) FROM dimension)) s ON d.sub_id = s.subid
  LEFT JOIN outbound{tag} o ON d.sub_id = o.sub_id AND d.vertical = o.vertical)"""


MEASURES = ("total_calls", "paid_calls", "calls_over_threshold", "call_revenue", "lead_volume", "leads_transferred", "lead_revenue",
            "click_volume", "click_revenue", "redirect_volume", "redirect_revenue", "total_revenue")
TEXTS = ("channel", "placement", "description", "source_name", "media_type", "campaign_type")


def rows_cte(tag: str = "") -> str:
    numbers = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in MEASURES)
    texts = ", ".join(f"coalesce({t}, '') AS {t}" for t in TEXTS)
    return (f"src{tag} AS (SELECT sub_id, vertical, traffic_type, nullif(internal_channel, '') AS internal_channel, {texts}, {numbers}, "
            f"row_number() OVER (ORDER BY total_revenue DESC, sub_id, vertical) AS ord FROM report{tag})")


def classified_ctes(src: str = "src", tag: str = "", limits: str = "limits", calls: int = 50, leads: int = 100) -> str:
    def tier(rate: str, k: str) -> str:
        return (f"CASE WHEN {rate} IS NULL OR {k}s IS NULL THEN 'Unknown' WHEN {k}p IS NOT NULL AND {rate} >= {k}p THEN 'Premium' "
                f"WHEN {rate} >= {k}s THEN 'Standard' WHEN {rate} <= {k}x THEN 'Pause' ELSE 'Standard' END")

    def num(on: str, tier_col: str, name: str) -> str:
        return f"CAST({on} AND {tier_col} = '{name}' AS INT)"

    summary = joined(f"CASE WHEN call_on THEN 'Call: ' || {pct('call_quality_rate', 2)} || ' (' || call_tier || ')' END",
                     f"CASE WHEN lead_on THEN 'Lead: ' || {pct('lead_transfer_rate', 2)} || ' (' || lead_tier || ')' END", sep=", ")
    low = (f"CASE WHEN call_quality_rate IS NULL AND lead_transfer_rate IS NULL THEN 'No data' ELSE "
           + joined(f"CASE WHEN call_quality_rate IS NOT NULL AND NOT call_on THEN 'Call: ' || {plain('total_calls')} || '/{calls}' END",
                    f"CASE WHEN lead_transfer_rate IS NOT NULL AND NOT lead_on THEN 'Lead: ' || {plain('lead_volume')} || '/{leads}' END", sep=", ")
           + " END")
    return f"""
c1{tag} AS (
  SELECT s.*, l.has_premium, l.cp, l.cs, l.cx, l.ct, l.lp, l.ls, l.lx, l.lt,
         CASE WHEN lower(trim(internal_channel)) = 'premium' THEN 'Premium' ELSE 'Standard' END AS current_classification,
         internal_channel IS NULL OR internal_channel IN ('', 'null', 'undefined') AS is_unmapped,
         CASE WHEN total_calls > 0 THEN calls_over_threshold / total_calls END AS call_quality_rate,
         CASE WHEN lead_volume > 0 THEN leads_transferred / lead_volume END AS lead_transfer_rate,
         CASE WHEN lead_volume > 0 THEN lead_revenue / lead_volume END AS rp_lead,
         CASE WHEN paid_calls > 0 THEN call_revenue / paid_calls END AS rp_qcall,
         CASE WHEN click_volume > 0 THEN click_revenue / click_volume END AS rp_click,
         CASE WHEN redirect_volume > 0 THEN redirect_revenue / redirect_volume END AS rp_redirect
  FROM {src} s LEFT JOIN {limits} l ON s.vertical = l.vertical AND s.traffic_type = l.traffic_type),
c2{tag} AS (
  SELECT *, {tier('call_quality_rate', 'c')} AS call_tier, {tier('lead_transfer_rate', 'l')} AS lead_tier,
         call_quality_rate IS NOT NULL AND total_calls >= {calls} AS call_on,
         lead_transfer_rate IS NOT NULL AND lead_volume >= {leads} AS lead_on FROM c1{tag}),
c3{tag} AS (
  SELECT *, CAST(call_on AS INT) + CAST(lead_on AS INT) AS n,
         {num('call_on', 'call_tier', 'Premium')} + {num('lead_on', 'lead_tier', 'Premium')} AS p,
         {num('call_on', 'call_tier', 'Pause')} + {num('lead_on', 'lead_tier', 'Pause')} AS x,
         {summary} AS summary, {low} AS low_text FROM c2{tag}),
c4{tag} AS (
  SELECT *, CASE
    WHEN n = 0 THEN 'insufficient_volume'
    WHEN NOT coalesce(has_premium, false) THEN CASE WHEN x = n THEN 'pause_immediate' WHEN x > 0 THEN 'warning_14_day' ELSE 'no_premium_available' END
    WHEN current_classification = 'Premium' THEN CASE WHEN x > 0 THEN 'demote_with_warning' WHEN p = n THEN 'keep_premium'
         WHEN p > 0 THEN 'keep_premium_watch' ELSE 'demote_to_standard' END
    WHEN x = n THEN 'pause_immediate' WHEN x > 0 THEN 'warning_14_day' WHEN p = n THEN 'upgrade_to_premium'
    WHEN p > 0 THEN 'keep_standard_close' ELSE 'keep_standard' END AS action FROM c3{tag}),
cls{tag} AS (
  SELECT *,
    CASE action WHEN 'keep_premium' THEN '✓ Premium' WHEN 'keep_premium_watch' THEN '⚠️ Premium (Watch)'
      WHEN 'demote_to_standard' THEN '↓ Demote to Standard' WHEN 'demote_with_warning' THEN '↓ Demote + 14d Warning'
      WHEN 'upgrade_to_premium' THEN '↑ Upgrade to Premium' WHEN 'keep_standard_close' THEN 'Standard (Almost Premium)'
      WHEN 'keep_standard' THEN '✓ Standard' WHEN 'warning_14_day' THEN '⚠️ 14-Day Warning' WHEN 'pause_immediate' THEN '🛑 PAUSE TODAY'
      WHEN 'insufficient_volume' THEN '📊 Low Volume' WHEN 'no_premium_available' THEN '✓ Standard (Max)' END AS action_label,
    CASE WHEN n = 0 THEN current_classification WHEN action = 'pause_immediate' THEN 'PAUSE'
      WHEN action IN ('keep_premium', 'keep_premium_watch', 'upgrade_to_premium') THEN 'Premium' ELSE 'Standard' END AS recommended_classification,
    n = 0 AS has_insufficient_volume,
    CASE WHEN n = 0 THEN 'Insufficient volume: ' || low_text END AS insufficient_volume_reason,
    CASE action
      WHEN 'insufficient_volume' THEN 'Insufficient volume: ' || low_text
      WHEN 'no_premium_available' THEN 'Meeting Standard targets (Premium not available for ' || traffic_type || '). ' || summary
      WHEN 'pause_immediate' THEN CASE WHEN coalesce(has_premium, false) THEN 'Both metrics in Pause range - pausing immediately. ' ELSE 'All metrics in Pause range. ' END || summary
      WHEN 'warning_14_day' THEN CASE WHEN coalesce(has_premium, false) THEN 'One metric in Pause range - 14-day warning. ' ELSE 'One or more metrics in Pause range. ' END || summary
      WHEN 'demote_with_warning' THEN 'Metric(s) in Pause range - demoting to Standard with 14-day warning. ' || summary
      WHEN 'keep_premium' THEN 'All metrics in Premium range. ' || summary
      WHEN 'keep_premium_watch' THEN 'One metric slipping to Standard range - monitoring. ' || summary
      WHEN 'demote_to_standard' THEN 'Both metrics dropped to Standard range. ' || summary
      WHEN 'upgrade_to_premium' THEN 'Both metrics in Premium range - eligible for upgrade. ' || summary
      WHEN 'keep_standard_close' THEN 'One metric at Premium, one at Standard - almost there. ' || summary
      ELSE 'Metrics in Standard range. ' || summary END AS classification_reason,
    action IN ('warning_14_day', 'demote_with_warning', 'keep_premium_watch') AS has_warning,
    CASE action WHEN 'warning_14_day' THEN 'Fix within 14 days or traffic will be paused'
      WHEN 'demote_with_warning' THEN 'Demoted from Premium. Fix within 14 days or traffic will be paused.'
      WHEN 'keep_premium_watch' THEN 'Performance declining - monitor closely' END AS warning_reason,
    action = 'pause_immediate' AS is_paused,
    CASE WHEN coalesce(has_premium, false) AND n > 0 THEN cp END AS premium_min,
    CASE WHEN coalesce(has_premium, false) AND n > 0 THEN cs END AS standard_min
  FROM c4{tag})"""


def base() -> str:
    """Everything up to ``cls``."""
    return f"WITH {limits_cte()}, {facts_cte()}, {window_cte()}, {report_ctes()}, {rows_cte()}, {classified_ctes()}"


# ---- insights ---------------------------------------------------------------------------

def scoped(where: str = "true") -> str:
    """``base`` plus insight columns of every source (``ins``) and cohort figures (``coh``)."""
    name = "vertical || ' - ' || traffic_type"

    def rank(c: str) -> str:
        return half_up(f"CAST(rank() OVER (PARTITION BY vertical, traffic_type ORDER BY {c} NULLS LAST) - 1 AS DOUBLE) "
                       f"/ count({c}) OVER (PARTITION BY vertical, traffic_type) * 100e0")

    def z(c: str, mean: str, sd: str, count: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL AND {count} >= 3 THEN CASE WHEN {sd} = 0 THEN 0e0 ELSE round(({c} - {mean}) / {sd}, 9) END END"

    promote, pause, warn = ("action IN ('upgrade_to_premium', 'promote')", "action IN ('pause_immediate', 'pause')",
                            "action IN ('warning_14_day', 'below')")
    demote = "action IN ('demote_to_standard', 'demote_with_warning', 'demote')"
    prem = "current_classification = 'Premium'"
    call, lead, rev = "call_quality_rate", "lead_transfer_rate", "total_revenue"
    thin = "NOT has_insufficient_volume AND (total_calls < 30 OR lead_volume < 60)"

    def sig(c: str) -> str:
        return f"{fixed(f'abs({c})', 1)} || 'σ '"

    factors = joined(
        """CASE action WHEN 'pause_immediate' THEN 'PAUSE threshold triggered - both metrics in Pause range'
             WHEN 'demote_with_warning' THEN 'Premium demoted with 14-day warning' WHEN 'warning_14_day' THEN '14-day warning - one metric in Pause range'
             WHEN 'demote_to_standard' THEN 'Premium source quality dropped to Standard range'
             WHEN 'keep_premium_watch' THEN 'Premium source with one metric slipping'
             WHEN 'insufficient_volume' THEN 'Insufficient volume for classification'
             WHEN 'keep_standard_close' THEN 'Almost at Premium - one metric meeting targets' END""",
        f"CASE WHEN {prem} AND ({demote} OR {pause}) THEN 'Premium source losing status' END",
        f"CASE WHEN has_insufficient_volume THEN 'Low volume (' || {plain('total_calls')} || ' calls, ' || {plain('lead_volume')} || ' leads)' END",
        f"CASE WHEN {thin} THEN 'Volume near minimum threshold' END",
        f"CASE WHEN {call} < 0.25e0 THEN 'Call quality critical (' || {pct(call, 1)} || ')' WHEN {call} < 0.40e0 THEN 'Call quality below target (' || {pct(call, 1)} || ')' END",
        f"CASE WHEN {lead} < 0.08e0 THEN 'Lead transfer critical (' || {pct(lead, 1)} || ')' WHEN {lead} < 0.15e0 THEN 'Lead transfer below target (' || {pct(lead, 1)} || ')' END",
    )
    reasons = joined(
        f"CASE WHEN call_z > 2 THEN 'Call quality ' || {sig('call_z')} || 'above ' || vertical || ' ' || traffic_type || ' peers' "
        f"WHEN call_z < -2 THEN 'Call quality ' || {sig('call_z')} || 'below ' || vertical || ' ' || traffic_type || ' peers' END",
        f"CASE WHEN lead_z > 2 THEN 'Lead transfer ' || {sig('lead_z')} || 'above peers' WHEN lead_z < -2 THEN 'Lead transfer ' || {sig('lead_z')} || 'below peers' END",
        f"CASE WHEN revenue_z > 2 THEN 'Revenue ' || {sig('revenue_z')} || 'above peers ($' || {grouped(rev)} || ' vs avg $' || {grouped('rev_mean')} || ')' "
        f"WHEN revenue_z < -2 THEN 'Revenue ' || {sig('revenue_z')} || 'below peers' END",
        f"CASE WHEN NOT z_flag AND {prem} AND {demote} THEN 'Premium source recommended for demotion - quality dropped' END",
        f"CASE WHEN NOT z_flag AND current_classification = 'Standard' AND {promote} THEN 'Standard source exceeding Premium thresholds - promotion candidate' END",
    )
    uplift = fixed("(om - 1) * 100e0", 0)
    return f"""{base()},
scope AS (SELECT * FROM cls WHERE {where}),
coh AS (
  SELECT vertical, traffic_type, {name} AS cohort_name, count(*) AS peers, count({call}) AS call_peers, count({lead}) AS lead_peers,
         avg({call}) AS call_mean, avg({lead}) AS lead_mean, avg({rev}) AS rev_mean,
         stddev_pop({call}) AS call_sd, stddev_pop({lead}) AS lead_sd, stddev_pop({rev}) AS rev_sd, sum({rev}) AS cohort_revenue,
         count(*) FILTER (WHERE {prem}) AS premium_peers, count(*) FILTER (WHERE NOT {prem}) AS other_peers,
         median({rev}) FILTER (WHERE {prem}) AS median_premium, median({rev}) FILTER (WHERE NOT {prem}) AS median_other
  FROM scope GROUP BY vertical, traffic_type),
mult AS (
  SELECT *, CASE WHEN median_premium > 0 AND median_other > 0 AND premium_peers >= 2 AND other_peers >= 2
                 THEN greatest(1e0, least(2.5e0, median_premium / median_other)) ELSE 1e0 END AS im,
            CASE WHEN premium_peers > 0 AND other_peers > 0
                 THEN CASE WHEN median_other = 0 THEN CASE WHEN median_premium > 0 THEN 2e0 WHEN median_premium = 0 THEN 1.15e0 ELSE 1e0 END
                      ELSE least(2e0, greatest(1e0, median_premium / median_other)) END ELSE 1.15e0 END AS om FROM coh),
i1 AS (
  SELECT s.*, m.cohort_name, m.peers, m.rev_mean, m.im, m.om, (SELECT sum({rev}) FROM scope) AS grand_total,
    {z(f's.{call}', 'm.call_mean', 'm.call_sd', 'm.call_peers')} AS call_z,
    {z(f's.{lead}', 'm.lead_mean', 'm.lead_sd', 'm.lead_peers')} AS lead_z,
    {z(f's.{rev}', 'm.rev_mean', 'm.rev_sd', 'm.peers')} AS revenue_z,
    CASE WHEN {prem} AND action IN ('keep_premium', 'correct') THEN 0 WHEN {promote} THEN 1
      WHEN NOT {prem} AND action IN ('keep_standard', 'keep_standard_close', 'no_premium_available', 'correct', 'not_primary') THEN 2
      WHEN action IN ('keep_premium_watch', 'warning_14_day', 'below', 'demote_to_standard', 'demote') THEN 3
      WHEN action IN ('pause_immediate', 'pause', 'demote_with_warning') THEN 4 WHEN has_insufficient_volume THEN 5 ELSE 6 END AS cluster,
    coalesce({call} * 100e0, 50e0) * 0.5e0 + coalesce({lead} * 100e0, 50e0) * 0.5e0 AS composite_score,
    least(100, CASE action WHEN 'pause_immediate' THEN 40 WHEN 'demote_with_warning' THEN 35 WHEN 'warning_14_day' THEN 30
        WHEN 'demote_to_standard' THEN 20 WHEN 'keep_premium_watch' THEN 15 WHEN 'insufficient_volume' THEN 10 WHEN 'keep_standard_close' THEN 5 ELSE 0 END
      + CASE WHEN {prem} AND ({demote} OR {pause}) THEN 15 WHEN {prem} AND action = 'keep_premium_watch' THEN 5 ELSE 0 END
      + CASE WHEN has_insufficient_volume THEN 10 WHEN {thin} THEN 5 ELSE 0 END
      + CASE WHEN {call} < 0.25e0 THEN 15 WHEN {call} < 0.40e0 THEN 8 ELSE 0 END
      + CASE WHEN {lead} < 0.08e0 THEN 10 WHEN {lead} < 0.15e0 THEN 5 ELSE 0 END) AS risk_score,
    greatest(30, 100 - CASE WHEN {call} IS NULL THEN 25 ELSE 0 END - CASE WHEN {lead} IS NULL THEN 25 ELSE 0 END
      - CASE WHEN has_insufficient_volume THEN 20 ELSE 0 END) AS risk_confidence,
    {factors} AS risk_factors
  FROM scope s JOIN mult m ON s.vertical = m.vertical AND s.traffic_type = m.traffic_type),
i2 AS (
  SELECT *, CASE WHEN {call} IS NOT NULL THEN {rank(call)} END AS call_percentile,
            CASE WHEN {lead} IS NOT NULL THEN {rank(lead)} END AS lead_percentile, {rank(rev)} AS revenue_percentile,
    coalesce(abs(call_z) > 2, false) OR coalesce(abs(lead_z) > 2, false) OR coalesce(abs(revenue_z) > 2, false) AS z_flag,
    coalesce(call_z < -2, false) OR coalesce(lead_z < -2, false) OR coalesce(revenue_z < -2, false) AS z_neg,
    CASE WHEN risk_score >= 60 THEN 'critical' WHEN risk_score >= 40 THEN 'high' WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE cluster WHEN 0 THEN '⭐ Elite Performers' WHEN 1 THEN '📈 Promotion Ready' WHEN 2 THEN '⚖️ Stable Standard' WHEN 3 THEN '⚠️ Watch List'
      WHEN 4 THEN '🛑 Critical Action' WHEN 5 THEN '📊 Low Volume' ELSE '🔍 Needs Review' END AS cluster_label
  FROM i1),
i3 AS (
  SELECT *, {half_up('''(coalesce(call_percentile * 0.4e0, 0e0) + coalesce(lead_percentile * 0.4e0, 0e0) + coalesce(revenue_percentile * 0.2e0, 0e0))
      / (CASE WHEN call_percentile IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN lead_percentile IS NULL THEN 0e0 ELSE 0.4e0 END + 0.2e0)''')} AS overall_percentile,
    CASE WHEN z_neg THEN 'negative' WHEN z_flag THEN 'positive' WHEN {prem} AND {demote} THEN 'negative'
      WHEN NOT {prem} AND {promote} THEN 'positive' ELSE 'none' END AS anomaly_type,
    {reasons} AS anomaly_reasons,
    CASE WHEN grand_total > 0 THEN {rev} / grand_total * 100e0 ELSE 0e0 END AS share,
    CASE WHEN {promote} THEN {rev} * CASE WHEN im > 1 THEN im ELSE 1.15e0 END WHEN {demote} THEN {rev} * CASE WHEN im > 1 THEN 1e0 / im ELSE 0.85e0 END
      WHEN {pause} THEN 0e0 WHEN {warn} THEN {rev} * 0.75e0 ELSE {rev} END AS projected_revenue,
    50 + CASE WHEN peers >= 10 THEN 20 WHEN peers >= 5 THEN 10 ELSE 0 END AS conf0,
    (coalesce({call}, 0e0) + coalesce({lead}, 0e0)) / 2 AS quality
  FROM i2),
i4 AS (
  SELECT *, CASE WHEN {promote} THEN projected_revenue - {rev} ELSE 0e0 END AS potential_gain,
    CASE WHEN {demote} THEN {rev} - projected_revenue WHEN {pause} THEN {rev} WHEN {warn} THEN {rev} * 0.25e0 ELSE 0e0 END AS potential_loss,
    CASE WHEN {promote} THEN 'Promote to Premium - cohort shows ' || {fixed('(CASE WHEN im > 1 THEN im ELSE 1.15e0 END - 1) * 100e0', 0)} || '% revenue uplift'
      WHEN {demote} THEN 'Quality issues may lead to reduced traffic and revenue' WHEN {pause} THEN 'PAUSE - stop traffic immediately to protect quality'
      WHEN {warn} THEN '14-day warning - quality must improve to avoid pause'
      WHEN action IN ('keep_premium', 'keep_premium_watch') THEN 'Maintain Premium - continue quality monitoring'
      WHEN action IN ('keep_standard', 'keep_standard_close') THEN 'Stable at Standard - meeting quality requirements'
      ELSE 'Maintain current classification' END AS impact_action,
    CASE WHEN {promote} THEN least(85, conf0 + 15) WHEN {demote} THEN least(75, conf0 + 10) WHEN {pause} THEN 95 WHEN {warn} THEN 60
      WHEN action IN ('keep_premium', 'keep_premium_watch') THEN 80 WHEN action IN ('keep_standard', 'keep_standard_close') THEN 75 ELSE conf0 END AS impact_confidence,
    CASE WHEN {promote} OR action = 'keep_premium' THEN 'accelerating'
      WHEN action IN ('demote_to_standard', 'demote_with_warning', 'pause_immediate', 'pause', 'warning_14_day', 'keep_premium_watch') THEN 'decelerating' ELSE 'stable' END AS quality_momentum,
    CASE WHEN {promote} OR action = 'keep_premium' THEN 'improving'
      WHEN action IN ('demote_to_standard', 'demote_with_warning', 'pause_immediate', 'pause') THEN 'declining'
      WHEN action IN ('warning_14_day', 'keep_premium_watch') THEN 'volatile' ELSE 'stable' END AS trajectory,
    CASE WHEN total_calls > 100 OR lead_volume > 200 THEN 'growing' WHEN has_insufficient_volume THEN 'declining' ELSE 'stable' END AS volume_momentum,
    {half_up(f'CASE WHEN quality > 0 THEN {rev} / (quality * 100e0) ELSE 0e0 END * 100e0')} / 100e0 AS revenue_efficiency,
    {half_up('coalesce(nullif(overall_percentile, 0), 50) * 0.6e0 + coalesce(nullif(100 - risk_score, 0), 50) * 0.4e0')} AS performance_index,
    least(100, 70 + CASE WHEN peers >= 10 THEN 15 ELSE 0 END + CASE WHEN {call} IS NOT NULL AND {lead} IS NOT NULL THEN 10 ELSE 0 END
      + CASE WHEN has_insufficient_volume THEN 0 ELSE 5 END) AS momentum_confidence,
    least(100, 60 + CASE WHEN peers >= 10 THEN 20 WHEN peers >= 5 THEN 10 ELSE 0 END + CASE WHEN {call} IS NOT NULL AND {lead} IS NOT NULL THEN 15 ELSE 0 END
      + CASE WHEN has_insufficient_volume THEN 0 ELSE 5 END) AS opportunity_confidence,
    CASE WHEN {promote} THEN least(100e0, share * 3 + coalesce(nullif(overall_percentile, 0), 50) * 0.5e0)
      WHEN {pause} THEN least(100e0, 80 + (20 - least(20e0, share))) WHEN {warn} THEN least(100e0, 50 + share * 2)
      WHEN action = 'demote_to_standard' THEN least(100e0, 40 + share * 1.5e0) WHEN action = 'keep_premium_watch' THEN least(100e0, 35 + share * 2)
      WHEN action = 'keep_standard_close' THEN 30 + share WHEN action = 'keep_standard' THEN 15e0 ELSE 20e0 END AS impact,
    CASE WHEN {promote} THEN {rev} * (om - 1) WHEN {pause} THEN -{rev} WHEN {warn} THEN {rev} * 0.6e0 WHEN action = 'demote_to_standard' THEN {rev} * 0.3e0
      WHEN action = 'keep_premium_watch' THEN {rev} * 0.15e0 WHEN action = 'keep_standard_close' THEN {rev} * (om - 1) * 0.5e0
      WHEN action = 'keep_standard' THEN {rev} * (om - 1) * 0.2e0 ELSE 0e0 END AS potential,
    CASE action WHEN 'upgrade_to_premium' THEN 'promote' WHEN 'pause_immediate' THEN 'pause' WHEN 'warning_14_day' THEN 'remediate'
      WHEN 'demote_to_standard' THEN 'optimize' WHEN 'keep_premium_watch' THEN 'optimize' WHEN 'keep_standard_close' THEN 'optimize' ELSE 'investigate' END AS opportunity_type,
    CASE action WHEN 'upgrade_to_premium' THEN 70 WHEN 'pause_immediate' THEN 100 WHEN 'warning_14_day' THEN 85 WHEN 'demote_to_standard' THEN 65
      WHEN 'keep_premium_watch' THEN 60 WHEN 'keep_standard_close' THEN 45 WHEN 'keep_standard' THEN 25 ELSE 30 END AS urgency_score,
    CASE WHEN {promote} OR {pause} THEN 'immediate' WHEN action IN ('warning_14_day', 'demote_to_standard', 'keep_premium_watch') THEN 'short-term' ELSE 'medium-term' END AS timeframe,
    CASE action WHEN 'upgrade_to_premium' THEN 'Promote to Premium tier - ' || {uplift} || '% revenue uplift expected'
      WHEN 'pause_immediate' THEN 'PAUSE immediately - quality below minimum thresholds' WHEN 'warning_14_day' THEN 'Urgent remediation needed within 14 days'
      WHEN 'demote_to_standard' THEN 'Demote to Standard but work on quality improvement plan'
      WHEN 'keep_premium_watch' THEN 'Premium source needs attention - one metric slipping'
      WHEN 'keep_standard_close' THEN 'Near Premium thresholds - targeted improvement could unlock promotion'
      WHEN 'keep_standard' THEN 'Stable at Standard - consider quality optimization program' ELSE 'Review and assess manually' END AS opportunity_action,
    CASE action WHEN 'upgrade_to_premium' THEN 'Already meeting Premium thresholds. Cohort data shows ' || {uplift} || '% average uplift for Premium sources.'
      WHEN 'pause_immediate' THEN 'Both metrics in Pause range. Continuing traffic risks partner quality reputation. Revenue at risk: $' || {grouped(rev)}
      WHEN 'warning_14_day' THEN 'One metric in Pause range. Without intervention, this source will require pause. Work with partner on quality improvement.'
      WHEN 'demote_to_standard' THEN 'Quality dropped below Premium thresholds. Demotion protects tier integrity. Consider re-promotion program.'
      WHEN 'keep_premium_watch' THEN 'Premium source with one metric below target. Proactive intervention can prevent demotion.'
      WHEN 'keep_standard_close' THEN 'One metric already meeting Premium. Focus on improving the other metric for promotion opportunity.'
      WHEN 'keep_standard' THEN 'Meeting Standard requirements. Systematic quality improvements could unlock Premium tier.'
      ELSE 'Requires manual review to determine appropriate action.' END AS rationale
  FROM i3),
ins AS (
  SELECT *, {half_up('impact')} AS impact_score, {half_up('potential')} AS potential_revenue,
    {half_up('''impact * (urgency_score / 100e0) * (opportunity_confidence / 100e0)
        * CASE timeframe WHEN 'immediate' THEN 1.5e0 WHEN 'short-term' THEN 1.2e0 ELSE 1e0 END * 100e0''')} / 100e0 AS priority_score FROM i4)"""


def health_select() -> str:
    def n(cond: str) -> str:
        return f"count(*) FILTER (WHERE {cond})"

    risk = "action IN ('pause_immediate', 'pause', 'warning_14_day', 'below', 'demote_with_warning')"
    total = "sum(total_revenue)"
    pos, neg = n("action IN ('upgrade_to_premium', 'promote', 'keep_premium')"), n(
        "action IN ('pause_immediate', 'pause', 'demote_to_standard', 'demote_with_warning', 'warning_14_day')")
    div = half_up("(1 - (SELECT sum((total_revenue / grand_total) * (total_revenue / grand_total)) FROM ins)) * 100e0")
    prem, at_risk, paused = n("current_classification = 'Premium'"), n("action IN ('warning_14_day', 'below', 'demote_with_warning')"), n("action IN ('pause_immediate', 'pause')")

    def top(k: int) -> str:
        return half_up(f"(SELECT sum(total_revenue) FROM (SELECT total_revenue FROM ins ORDER BY total_revenue DESC LIMIT {k})) / {total} * 100e0")

    health = (f"greatest(0e0, least(100e0, 100 - avg(risk_score) * 0.5e0 + CAST({prem} AS DOUBLE) / count(*) * 20 "
              f"- CAST({paused} + {at_risk} AS DOUBLE) / count(*) * 30 + {div} * 0.1e0))")
    return f"""
  SELECT {half_up(health)} AS overall_health_score, sum(CASE WHEN {risk} THEN total_revenue ELSE 0e0 END) AS revenue_at_risk,
    {half_up(f"sum(CASE WHEN {risk} THEN total_revenue ELSE 0e0 END) / {total} * 100e0")} AS revenue_at_risk_percent,
    {div} AS diversification_score, {prem} AS premium_count,
    {n("current_classification <> 'Premium'")} - {at_risk} - {paused} AS standard_count, {at_risk} AS at_risk_count, {paused} AS paused_count,
    {top(5)} AS top5_revenue_share, {top(10)} AS top10_revenue_share, max(total_revenue) > {total} * 0.25e0 AS single_source_dependency,
    {paused} AS immediate_actions, {n("action IN ('warning_14_day', 'below', 'demote_to_standard', 'demote_with_warning')")} AS short_term_actions,
    {n("action IN ('keep_premium_watch', 'keep_standard_close')")} AS monitoring_required,
    {n("action IN ('keep_premium', 'keep_standard', 'upgrade_to_premium', 'promote', 'correct', 'not_primary')")} AS no_action_needed,
    CASE WHEN {pos} > {neg} * 1.5e0 THEN 'improving' WHEN {neg} > {pos} * 1.5e0 THEN 'declining' ELSE 'stable' END AS trend_indicator
  FROM ins"""


def cohort_intelligence_cte() -> str:
    def trait(top: str, own: str, name: str) -> str:
        return (f"CASE WHEN {top} > coalesce({own}, 0e0) * 1.1e0 THEN {fixed(f'({top} - coalesce({own}, 0e0)) * 100e0', 0)} || 'pp higher {name} than cohort avg' END")

    def issue(own: str, whole: str, name: str) -> str:
        return f"CASE WHEN {own} < {whole} * 0.9e0 THEN '{name} quality ' || {fixed(f'({whole} - {own}) * 100e0', 1)} || 'pp below portfolio avg' END"

    def share(x: str) -> str:
        return fixed(f"CAST({x} AS DOUBLE) / peers * 100e0", 0)

    traits = joined(trait("top_call", "call_mean", "call quality"), trait("top_lead", "lead_mean", "lead transfer"),
                    "CASE WHEN top_premium > 0 THEN top_premium || '/' || top_n || ' top performers are Premium tier' END")
    issues = joined(f"CASE WHEN pauses > 0 THEN pauses || ' sources (' || {share('pauses')} || '%) flagged for PAUSE' END",
                    "CASE WHEN warnings > 0 THEN warnings || ' sources with 14-day warnings' END",
                    f"CASE WHEN low_volume > peers * 0.3e0 THEN 'High low-volume rate: ' || {share('low_volume')} || '%' END",
                    issue("call_mean", "p_call", "Call"), issue("lead_mean", "p_lead", "Lead"))
    return f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY vertical, traffic_type ORDER BY total_revenue DESC, ord) - 1 AS position,
             count(*) OVER (PARTITION BY vertical, traffic_type) AS size FROM ins),
best AS (SELECT * FROM placed WHERE position < greatest(3, floor(size * 0.2e0))),
bestc AS (SELECT vertical, traffic_type, count(*) AS top_n, count(*) FILTER (WHERE current_classification = 'Premium') AS top_premium,
            avg(call_quality_rate) AS top_call, avg(lead_transfer_rate) AS top_lead FROM best GROUP BY vertical, traffic_type),
riskc AS (SELECT vertical, traffic_type, avg(risk_score) AS avg_risk, count(*) FILTER (WHERE action IN ('pause_immediate', 'pause')) AS pauses,
            count(*) FILTER (WHERE action IN ('warning_14_day', 'below')) AS warnings, count(*) FILTER (WHERE has_insufficient_volume) AS low_volume,
            count(*) FILTER (WHERE action IN ('upgrade_to_premium', 'promote')) AS candidates,
            sum(CASE WHEN action IN ('pause_immediate', 'pause', 'warning_14_day', 'below') THEN total_revenue ELSE 0e0 END) AS risk_revenue
          FROM ins GROUP BY vertical, traffic_type),
pf AS (SELECT avg(call_quality_rate) AS p_call, avg(lead_transfer_rate) AS p_lead, avg(total_revenue) AS p_rev, sum(total_revenue) AS p_total FROM ins),
ci AS (
  SELECT coh.vertical, coh.traffic_type, cohort_name, peers AS source_count, cohort_revenue AS total_revenue,
    cohort_revenue / p_total * 100e0 AS revenue_share, call_mean AS avg_call_quality, lead_mean AS avg_lead_quality,
    call_mean - p_call AS call_quality_delta, lead_mean - p_lead AS lead_quality_delta, rev_mean - p_rev AS revenue_delta,
    coalesce(nullif({traits}, ''), 'Insufficient data to identify patterns') AS top_performer_traits,
    coalesce(nullif({issues}, ''), 'No significant issues detected') AS common_issues,
    CASE WHEN other_peers > 0 THEN {half_up('CAST(candidates AS DOUBLE) / other_peers * 100e0')} ELSE 0 END AS optimization_potential,
    {half_up('100 - avg_risk')} AS health_score,
    CASE WHEN cohort_revenue > 0 THEN {half_up('risk_revenue / cohort_revenue * 100e0')} ELSE 0 END AS risk_concentration
  FROM coh JOIN riskc USING (vertical, traffic_type) JOIN bestc USING (vertical, traffic_type), pf)"""


def scenario_cte() -> str:
    obs = fixed("(obs - 1) * 100e0", 0)
    return f"""
om AS (SELECT CASE WHEN mp > 0 AND mo > 0 THEN least(2e0, greatest(1e0, mp / mo)) ELSE 1e0 END AS obs, tot
  FROM (SELECT median(total_revenue) FILTER (WHERE current_classification = 'Premium') AS mp,
               median(total_revenue) FILTER (WHERE current_classification <> 'Premium') AS mo, sum(total_revenue) AS tot FROM ins)),
sc AS (
  SELECT 1 AS scenario_no, 'Promote All Eligible to Premium' AS scenario, n AS affected_count, r AS current_revenue, r * up AS projected_revenue,
    r * up - r AS revenue_change, (r * up - r) / nullif(r, 0) * 100e0 AS revenue_change_percent,
    n || ' sources already meeting Premium quality thresholds' AS quality_impact,
    'Low risk - based on ' || CASE WHEN obs > 1 THEN 'observed ' || {obs} || '% Premium uplift' ELSE 'conservative 15% estimate' END AS risk_assessment
  FROM (SELECT count(*) AS n, sum(total_revenue) AS r FROM ins WHERE action IN ('upgrade_to_premium', 'promote')),
       (SELECT *, CASE WHEN obs > 1 THEN obs ELSE 1.15e0 END AS up FROM om) WHERE n > 0
  UNION ALL
  SELECT 2, 'Pause All Critical Sources', n, r, 0e0, -r, -100e0,
    'Removes ' || n || ' sources with metrics in Pause range (' || {fixed('r / tot * 100e0', 1)} || '% of total revenue)',
    'High priority - these sources have both metrics below minimum thresholds'
  FROM (SELECT count(*) AS n, sum(total_revenue) AS r FROM ins WHERE action IN ('pause_immediate', 'pause')), om WHERE n > 0
  UNION ALL
  SELECT 3, 'Remediate Watch List Sources', n, r, r * 0.6e0, r * 0.6e0 - r, (r * 0.6e0 - r) / nullif(r, 0) * 100e0,
    n || ' sources have 14-day warnings or declining quality',
    'Estimate ~60% can be remediated with focused attention; remaining 40% likely need pause'
  FROM (SELECT count(*) AS n, sum(total_revenue) AS r FROM ins WHERE cluster = 3) WHERE n > 0
  UNION ALL
  SELECT 4, 'Quality Improvement Initiative', n, r, r + k * avg_r * (obs - 1), k * avg_r * (obs - 1),
    coalesce(k * avg_r * (obs - 1) / nullif(r, 0) * 100e0, 0e0),
    '~' || CAST(k AS BIGINT) || ' of ' || n || ' Stable Standard sources could reach Premium thresholds',
    'Medium effort - requires quality coaching and optimization programs'
  FROM (SELECT count(*) AS n, sum(total_revenue) AS r, avg(total_revenue) AS avg_r, floor(count(*) * 0.1e0) AS k FROM ins WHERE cluster = 2), om WHERE n > 3)"""


def alerts_cte() -> str:
    def money(x: str) -> str:
        return f"'$' || {grouped(x)}"

    def n(cond: str, extra: str = "") -> str:
        return f"(SELECT count(*) AS n, sum(total_revenue) AS r FROM ins WHERE {cond}) {extra}"

    tot = "(SELECT sum(total_revenue) AS tot, max(total_revenue) AS largest FROM ins)"
    return f"""
al0 AS (
  SELECT 1 AS rule, 'critical' AS severity, 'quality' AS category, '🛑 ' || n || ' Sources Require Immediate PAUSE' AS title,
    'These sources have both quality metrics below minimum thresholds. Continuing traffic risks partner relationships and overall quality scores. Combined revenue impact: '
      || {money('r')} || ' (' || {fixed('r / tot * 100e0', 1)} || '% of total).' AS description, n AS affected_count,
    'Review and pause traffic immediately. Schedule partner calls to discuss quality improvement plans.' AS suggested_action,
    r AS potential_impact, 'immediate' AS urgency, 0 AS severity_rank FROM {n("action IN ('pause_immediate', 'pause')")}, {tot} WHERE n > 0
  UNION ALL SELECT 2, 'warning', 'quality', '⚠️ ' || n || ' Sources Have 14-Day Warning',
    'These sources have one quality metric in the Pause range. Without improvement, they will need to be paused within 14 days. Revenue at risk: ' || {money('r')} || '.',
    n, 'Contact partners to discuss quality improvement plans. Set calendar reminder for 14-day review.', r * 0.6e0, 'this_week', 1
    FROM {n("action IN ('warning_14_day', 'below')")} WHERE n > 0
  UNION ALL SELECT 3, 'opportunity', 'opportunity', '📈 ' || n || ' Sources Ready for Premium Promotion',
    'These Standard sources are already meeting Premium quality thresholds. Promoting them could unlock approximately ' || {money('r * 0.15e0')}
      || ' in additional revenue based on observed Premium tier uplift.', n,
    'Review and approve promotions. Update partner agreements to reflect Premium status.', r * 0.15e0, 'today', 2
    FROM {n("action IN ('upgrade_to_premium', 'promote')")} WHERE n > 0
  UNION ALL SELECT 4, 'warning', 'risk', '🎯 High Revenue Concentration Detected',
    'Single source accounts for over 25% of total revenue (' || {money('largest')} || '). This creates significant business risk if that source experiences quality issues or decides to leave.',
    1, 'Diversify revenue sources. Identify and develop backup sources in the same vertical.', largest, 'this_week', 1
    FROM {tot} WHERE largest > tot * 0.25e0
  UNION ALL SELECT 5, 'info', 'quality', '📊 ' || n || ' Cohorts Underperforming',
    'These vertical/traffic type combinations have health scores below 50%: ' || names || '. Combined revenue: ' || {money('r')} || '.', m,
    'Review cohort-specific quality standards. Consider vertical-specific optimization programs.', r * 0.2e0, 'this_month', 3
    FROM (SELECT count(*) AS n, sum(total_revenue) AS r, CAST(sum(source_count) AS BIGINT) AS m,
            string_agg(cohort_name, ', ' ORDER BY total_revenue DESC, cohort_name) AS names FROM ci WHERE health_score < 50 AND source_count >= 3) WHERE n > 0
  UNION ALL SELECT 6, 'warning', 'risk', '⚡ ' || n || ' High-Revenue Sources at Elevated Risk',
    'These sources each represent >5% of total revenue but have high risk scores. Combined: ' || {money('r')} || ' (' || {fixed('r / tot * 100e0', 1)} || '% of portfolio).',
    n, 'Prioritize quality monitoring and partner engagement for these critical sources.', r, 'this_week', 1
    FROM {n("risk_level = 'high' AND total_revenue > grand_total * 0.05e0")}, {tot} WHERE n > 0
  UNION ALL SELECT 7, 'opportunity', 'opportunity', '🎯 ' || n || ' Sources Close to Premium Threshold',
    'These Standard sources have one metric meeting Premium. Targeted improvement on the other metric could unlock Premium status. Current revenue: ' || {money('r')} || '.',
    n, 'Create focused improvement plans for the underperforming metric. Consider incentive programs.', r * 0.15e0, 'this_month', 2
    FROM {n("action = 'keep_standard_close'")} WHERE n >= 3),
al AS (SELECT 'alert_' || row_number() OVER (ORDER BY rule) AS alert_id, * FROM al0)"""


def overall_cte() -> str:
    return f"""
hs AS ({health_select()}),
ov AS (
  SELECT count(*) AS source_count, count(*) FILTER (WHERE anomaly_type <> 'none') AS total_anomalies,
    count(*) FILTER (WHERE anomaly_type = 'positive') AS positive_anomalies, count(*) FILTER (WHERE anomaly_type = 'negative') AS negative_anomalies,
    count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk_count, sum(potential_gain) AS total_potential_gain, sum(potential_loss) AS total_potential_loss,
    coalesce((SELECT string_agg(sub_id, ', ' ORDER BY overall_percentile DESC, ord) FROM
      (SELECT * FROM ins WHERE overall_percentile >= 80 ORDER BY overall_percentile DESC, ord LIMIT 5)), '') AS top_performers,
    coalesce((SELECT string_agg(sub_id, ', ' ORDER BY risk_score DESC, ord) FROM
      (SELECT * FROM ins WHERE risk_level IN ('high', 'critical') ORDER BY risk_score DESC, ord LIMIT 5)), '') AS at_risk_performers,
    sum(potential_gain) + coalesce((SELECT revenue_change FROM sc WHERE scenario_no = 1), 0e0) AS optimization_opportunity,
    (SELECT CASE WHEN overall_health_score >= 85 THEN 'A' WHEN overall_health_score >= 70 THEN 'B' WHEN overall_health_score >= 55 THEN 'C'
       WHEN overall_health_score >= 40 THEN 'D' ELSE 'F' END FROM hs) AS portfolio_grade,
    CASE WHEN count(*) FILTER (WHERE trajectory = 'improving') > 1.5e0 * count(*) FILTER (WHERE trajectory = 'declining') THEN 'improving'
      WHEN count(*) FILTER (WHERE trajectory = 'declining') > 1.5e0 * count(*) FILTER (WHERE trajectory = 'improving') THEN 'declining' ELSE 'stable' END AS quality_trend,
    {half_up('avg(performance_index)')} AS revenue_efficiency_score,
    count(*) FILTER (WHERE priority_score > 1.5e0 OR timeframe = 'immediate')
      + (SELECT count(*) FROM al WHERE severity IN ('critical', 'opportunity')) AS actionable_insights_count,
    {half_up('sum(CASE WHEN potential_revenue > 0 THEN potential_revenue * (opportunity_confidence / 100e0) ELSE 0e0 END)')} AS estimated_optimization_value
  FROM ins)"""


# ---- queries ----------------------------------------------------------------------------

def _round(*columns: str, d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in columns)


def _rollup(dimension: str) -> str:
    group = f"coalesce(nullif({dimension}, ''), 'Unknown')"
    sums = ", ".join(f"sum({m}) AS {m}" for m in MEASURES)
    if dimension == "overall":
        name = "vertical || ' - ' || traffic_type || ' ' || coalesce(internal_channel, 'Standard')"
        keys = "vertical, traffic_type, coalesce(internal_channel, 'Standard')"
    else:
        name, keys = group, f"{group}, vertical, traffic_type, coalesce(internal_channel, 'Standard')"
    rolled = (f"rolled AS (SELECT {name} AS sub_id, vertical, traffic_type, coalesce(internal_channel, 'Standard') AS internal_channel, {sums} "
              f"FROM src GROUP BY {keys})")
    return (f"{base()}, {rolled}, {classified_ctes('rolled', '_r')} SELECT sub_id, vertical, traffic_type, internal_channel, {', '.join(MEASURES)}, "
            f"call_quality_rate, lead_transfer_rate, action, recommended_classification, '{dimension}' AS dimension FROM cls_r")


def _mode_ctes(mode: str) -> str:
    other = "lead" if mode == "call" else "call"
    rate, on, tier = {"call": ("call_quality_rate", "call_on", "call_tier"), "lead": ("lead_transfer_rate", "lead_on", "lead_tier")}[mode]
    volume = "nullif(total_calls + lead_volume, 0)"
    shares = (f"CASE WHEN total_revenue > 0 THEN call_revenue / total_revenue ELSE coalesce(total_calls / {volume}, 0e0) END AS call_sh, "
              f"CASE WHEN total_revenue > 0 THEN lead_revenue / total_revenue ELSE coalesce(lead_volume / {volume}, 0e0) END AS lead_sh")
    focus = "Lead Focused" if mode == "call" else "Call Focused"
    return f"""
m1 AS (SELECT *, {shares} FROM cls),
m2 AS (SELECT * REPLACE (CASE WHEN {rate} IS NULL THEN 'review' WHEN NOT {on} THEN 'insufficient_volume' WHEN {mode}_sh < 0.10e0 THEN 'not_primary'
    WHEN {tier} = 'Pause' THEN 'pause_immediate' WHEN {tier} = 'Premium' AND current_classification <> 'Premium' THEN 'upgrade_to_premium'
    WHEN {tier} = 'Standard' AND current_classification = 'Premium' THEN 'demote_to_standard' ELSE 'keep_standard' END AS action) FROM m1),
mode AS (SELECT * REPLACE (
    CASE action WHEN 'review' THEN '🔍 Review' WHEN 'insufficient_volume' THEN '📊 Low Volume' WHEN 'not_primary' THEN '📋 N/A - {focus}'
      WHEN 'pause_immediate' THEN '🛑 PAUSE TODAY' WHEN 'upgrade_to_premium' THEN '↑ Upgrade to Premium'
      WHEN 'demote_to_standard' THEN '↓ Demote to Standard' ELSE '✓ Standard' END AS action_label,
    CASE action WHEN 'review' THEN current_classification WHEN 'pause_immediate' THEN 'PAUSE' WHEN 'upgrade_to_premium' THEN 'Premium' ELSE 'Standard' END AS recommended_classification,
    action = 'pause_immediate' AS is_paused,
    CASE WHEN action = 'not_primary' THEN 'Source primarily generates {other}s (' || {fixed(f'{other}_sh * 100e0', 0)} || '% of revenue). Not evaluated on {mode} quality.'
      WHEN {rate} IS NOT NULL THEN '{mode.title()} tier: ' || {tier} ELSE 'No data for selected metric' END AS classification_reason) FROM m2)"""


def _explanation() -> str:
    def val(rate: str, tier: str) -> str:
        return f"coalesce({pct(rate, 1)}, 'N/A') || ' (' || CASE WHEN {rate} IS NULL THEN 'Unknown' ELSE {tier} END || ')'"

    def status(tier: str) -> str:
        return f"""CASE WHEN action IN ('demote_to_standard') THEN 'warning' WHEN action = 'upgrade_to_premium' THEN 'good'
          WHEN action IN ('keep_standard', 'no_premium_available') THEN 'neutral' WHEN action = 'pause_immediate' THEN 'bad'
          WHEN action = 'keep_premium' THEN CASE WHEN {tier} = 'Premium' THEN 'good' ELSE 'neutral' END
          WHEN action IN ('keep_premium_watch', 'keep_standard_close') THEN CASE WHEN {tier} = 'Premium' THEN 'good' ELSE 'warning' END
          ELSE CASE {tier} WHEN 'Pause' THEN 'bad' WHEN 'Premium' THEN 'good' ELSE 'warning' END END"""

    low = joined(f"'Call Volume: ' || {grouped('total_calls')} || ' / 50 required: ' || CASE WHEN total_calls >= 50 THEN 'good' ELSE 'warning' END",
                 f"'Lead Volume: ' || {grouped('lead_volume')} || ' / 100 required: ' || CASE WHEN lead_volume >= 100 THEN 'good' ELSE 'warning' END")
    both = joined(f"'Call Quality: ' || {val('call_quality_rate', 'call_tier')} || ': ' || {status('call_tier')}",
                  f"'Lead Transfer: ' || {val('lead_transfer_rate', 'lead_tier')} || ': ' || {status('lead_tier')}",
                  "CASE action WHEN 'demote_to_standard' THEN 'Current Tier: ' || current_classification || ': neutral' "
                  "WHEN 'demote_with_warning' THEN 'Warning: 14 days to fix: bad' WHEN 'warning_14_day' THEN 'Deadline: 14 days: bad' END")
    return f"""{base()} SELECT sub_id, vertical, CASE action
      WHEN 'keep_premium' THEN 'This source is meeting Premium targets on all metrics with sufficient volume. No action needed.'
      WHEN 'keep_premium_watch' THEN 'This Premium source has one metric slipping to Standard range. Keeping at Premium but monitoring closely.'
      WHEN 'demote_to_standard' THEN 'Both metrics have dropped from Premium to Standard range. Demoting from Premium to Standard tier.'
      WHEN 'demote_with_warning' THEN 'One or more metrics hit the Pause range. Premium sources don''t get paused immediately - demoting to Standard with a 14-day window to fix performance.'
      WHEN 'upgrade_to_premium' THEN 'Both metrics are performing at Premium level. This source qualifies for upgrade to Premium tier.'
      WHEN 'keep_standard_close' THEN 'One metric is at Premium level, but not both. Almost qualified for Premium upgrade - keep optimizing.'
      WHEN 'keep_standard' THEN 'Both metrics are in the Standard range. Maintaining current tier.'
      WHEN 'no_premium_available' THEN 'This traffic type doesn''t have a Premium tier available. Meeting Standard targets.'
      WHEN 'warning_14_day' THEN 'One metric has dropped into the Pause range. This source has 14 days to improve performance or traffic will be paused.'
      WHEN 'pause_immediate' THEN 'BOTH metrics are in the Pause range. This source should be paused immediately.'
      ELSE 'Not enough data to make a classification decision. Minimum volume thresholds not met.' END AS explanation,
    CASE WHEN action = 'insufficient_volume' THEN {low} ELSE {both} END AS details FROM cls"""


def _not_primary() -> str:
    def part(m: str) -> str:
        return f"CASE WHEN total_revenue > 0 THEN {fixed(f'{m}_revenue / nullif(total_revenue, 0) * 100e0', 0)} ELSE '0' END"

    details = joined(f"'Call Revenue: $' || {grouped('call_revenue')} || ' (' || {part('call')} || '%): warning'",
                     f"'Lead Revenue: $' || {grouped('lead_revenue')} || ' (' || {part('lead')} || '%): good'", "'Evaluation: Not Evaluated: neutral'")
    return (f"{base()} SELECT sub_id, vertical, 'This source primarily generates leads (' || {part('lead')} || '% of revenue). "
            f"Call quality is not the primary metric for this source.' AS explanation, {details} AS details FROM cls")


def _status(rate: str, k: str, volume: str, minimum: int) -> str:
    return (f"CASE WHEN {volume} < {minimum} THEN 'LOW VOL' WHEN {rate} IS NULL OR {k}s IS NULL THEN 'N/A' WHEN {rate} >= {k}p THEN 'ON TARGET' "
            f"WHEN {rate} >= {k}s THEN 'MAINTAIN' WHEN {rate} <= {k}x THEN 'BELOW MIN' ELSE 'ATTENTION' END")


def _remarks() -> str:
    def one(name: str, subject: str, rate: str, vol: str, least: int, hi: str, mid: str, lo: str, closing: str) -> str:
        return (f"CASE WHEN {vol} >= {least} AND {rate} IS NOT NULL THEN CASE WHEN {rate} >= {hi} THEN 'Strong {subject} at ' || {pct(rate, 1)} "
                f"WHEN {rate} >= {mid} THEN 'Moderate {subject} at ' || {pct(rate, 1)} WHEN {rate} < {lo} THEN 'Low {subject} at ' || {pct(rate, 1)} || ' {closing}' END "
                f"WHEN {vol} < {least} AND {vol} > 0 THEN '{name} volume (' || {plain(vol)} || ') below minimum threshold of {least}' END")

    text = joined(one("Call", "call quality", "call_quality_rate", "total_calls", 50, "0.20e0", "0.15e0", "0.10e0", "needs attention"),
                  one("Lead", "lead transfer", "lead_transfer_rate", "lead_volume", 100, "0.18e0", "0.12e0", "0.08e0", "needs review"))
    return f"{base()} SELECT sub_id, vertical, coalesce(nullif({text}, ''), 'Insufficient data to assess quality metrics') AS remarks FROM cls"


def _stat(action: str) -> str:
    return (f"CASE WHEN {action} = 'upgrade_to_premium' THEN 'promote' WHEN {action} IN ('demote_to_standard', 'demote_with_warning') THEN 'demote' "
            f"WHEN {action} = 'warning_14_day' THEN 'below' WHEN {action} = 'pause_immediate' THEN 'pause' WHEN {action} = 'insufficient_volume' THEN 'insufficient_volume' "
            f"WHEN {action} = 'review' THEN 'review' ELSE 'correct' END")


def _counters() -> str:
    return ", ".join(f"count(*) FILTER (WHERE cat = '{c}') AS {c}" for c in ("promote", "demote", "below", "correct", "review", "pause", "insufficient_volume"))


COMPARED = {"lead_volume": "lead_volume", "call_volume": "total_calls", "click_volume": "click_volume", "redirect_volume": "redirect_volume",
            "revenue": "total_revenue"}


def _compare(total: bool) -> str:
    sums = ", ".join(f"sum(CASE WHEN sel THEN {c} ELSE 0e0 END) AS selected_{n}, sum({c}) AS total_{n}" for n, c in COMPARED.items())
    pcts = ", ".join(f"CASE WHEN total_{n} > 0 THEN selected_{n} / total_{n} * 100e0 ELSE 0e0 END AS {n}_pct" for n in COMPARED)
    picked = f"{base()}, marked AS (SELECT *, action IN ('upgrade_to_premium', 'warning_14_day') AS sel FROM cls)"
    if total:
        inner = (f"SELECT count(*) FILTER (WHERE sel) AS selected_count, count(*) AS total_count, {sums}, string_agg(DISTINCT vertical, '; ' ORDER BY vertical) AS verticals "
                 f"FROM marked WHERE vertical IN (SELECT vertical FROM marked WHERE sel)")
    else:
        inner = (f"SELECT vertical, traffic_type, count(*) FILTER (WHERE sel) AS selected_count, count(*) AS total_count, {sums} "
                 f"FROM marked GROUP BY vertical, traffic_type")
    return f"{picked} SELECT *, {pcts} FROM ({inner}) WHERE selected_count > 0"


def _history() -> str:
    return f"""WITH h AS (SELECT sub_id, coalesce(vertical, '') AS vertical, coalesce(traffic_type, '') AS traffic_type, nullif(media_type, '') AS media_type,
      action_taken, coalesce(nullif(action_label, ''), action_taken) AS action_label, previous_state, new_state, metric_mode, call_quality, lead_quality,
      total_revenue, notes, taken_by, created_at FROM ({HISTORY_SQL.format(**NAMES)}) WHERE sub_id <> '' AND action_taken <> '')"""


RUN_COUNTERS = ("promote_count", "demote_count", "below_min_count", "correct_count", "review_count", "pause_count", "insufficient_volume_count")


def _run_header(run: str, start: str, end: str, day: int, table: str) -> str:
    names = dict(zip(RUN_COUNTERS, ("promote", "demote", "below", "correct", "review", "pause", "insufficient_volume")))
    counts = ", ".join(f"count(*) FILTER (WHERE {_stat('action')} = '{c}') AS {n}" for n, c in names.items())
    return (f"SELECT '{run}' AS run_id, CAST(NULL AS VARCHAR) AS name, '{start}' AS start_date, '{end}' AS end_date, 'report_{run}.csv' AS file_name, "
            f"count(*) AS total_records, {counts}, TIMESTAMP '2024-01-0{day} 00:00:00' AS created_at FROM {table}")


# Adjoining windows, which together hold every date.
RUNS = {"early": ("1900-01-01", "1996-12-31"), "middle": ("1997-01-01", "1998-12-31"), "late": ("1999-01-01", "2199-12-31")}


def _runs_ctes(*runs: str) -> str:
    steps = [limits_cte(), facts_cte()]
    for run in runs:
        t = f"_{run}"
        steps += [window_cte(*RUNS[run], f"win{t}"), report_ctes(f"win{t}", t), rows_cte(t), classified_ctes(f"src{t}", t)]
    return "WITH " + ", ".join(steps)


def _run_with_results() -> str:
    header = ", ".join(f"run_{c}" for c in ("start_date", "end_date", "file_name", "total_records", *RUN_COUNTERS, "created_at"))
    renamed = ", ".join(f"{c} AS run_{c}" for c in ("start_date", "end_date", "file_name", "total_records", *RUN_COUNTERS, "created_at"))
    return f"""{_runs_ctes("middle")}, hd AS (SELECT run_id, {renamed} FROM ({_run_header("middle", *RUNS["middle"], 2, "cls_middle")}))
    SELECT run_id, sub_id, vertical, traffic_type, current_classification AS current_tier_label, recommended_classification AS recommended_tier, action, action_label,
      channel, placement, description, source_name, media_type AS media_type_name, campaign_type, CAST(total_calls AS BIGINT) AS total_calls,
      CAST(calls_over_threshold AS BIGINT) AS calls_over_threshold, call_quality_rate, CAST(lead_volume AS BIGINT) AS total_leads, CAST(0 AS BIGINT) AS total_clicks,
      lead_transfer_rate AS lead_ctr_rate, total_revenue, classification_reason, premium_min, standard_min, TIMESTAMP '2024-01-02 00:00:00' AS created_at, {header}
    FROM cls_middle, hd"""


def _overrides() -> str:
    value = "CASE WHEN s_suppkey % 11 <> 0 THEN (CAST(floor(s_acctbal) AS BIGINT) % 30 + 30) % 30 + 0.5e0 END / 100e0"
    fields = {("call", "standard_min"): "cs", ("call", "pause_max"): "cx", ("lead", "standard_min"): "ls", ("lead", "pause_max"): "lx"}
    latest = ", ".join(f"arg_max(v, s_suppkey) FILTER (WHERE metric = '{m}' AND field = '{f}') AS n{c}" for (m, f), c in fields.items())
    merged = ", ".join(f"coalesce(n{c}, {c}) AS {c}" if c in fields.values() else c for c in ("cp", "cs", "cx", "ct", "lp", "ls", "lx", "lt"))
    edits = f"""edits AS (SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Health' WHEN 2 THEN 'Life' WHEN 3 THEN 'Auto' ELSE 'Home' END AS vertical,
      CASE s_suppkey % 3 WHEN 0 THEN 'Full O&O' WHEN 1 THEN 'Partial O&O' ELSE 'Non O&O' END AS traffic_type, CASE WHEN s_suppkey % 2 = 0 THEN 'call' ELSE 'lead' END AS metric,
      CASE WHEN s_suppkey % 4 < 2 THEN 'standard_min' ELSE 'pause_max' END AS field, {value} AS v FROM supplier),
    wide AS (SELECT vertical, traffic_type, {latest} FROM edits WHERE v IS NOT NULL GROUP BY vertical, traffic_type),
    edited AS (SELECT vertical, traffic_type, has_premium, {merged} FROM limits LEFT JOIN wide USING (vertical, traffic_type))"""
    return (f"WITH {limits_cte()}, {facts_cte()}, {window_cte()}, {report_ctes()}, {rows_cte()}, {edits}, {classified_ctes(limits='edited', calls=100, leads=50)} "
            "SELECT sub_id, vertical, traffic_type, action, classification_reason, standard_min FROM cls")


def _export() -> str:
    def yes(c: str) -> str:
        return f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END"

    cols = {
        "Sub ID": "sub_id", "Vertical": "vertical", "Traffic Type": "traffic_type", "Internal Channel": "coalesce(internal_channel, '')",
        "Current Classification": "current_classification", "Is Unmapped": yes("is_unmapped"), "Recommended Classification": "recommended_classification",
        "Action": "action_label", "Is Paused": yes("is_paused"), "Pause Reason": "CASE WHEN is_paused THEN classification_reason ELSE '' END", "Channel": "channel",
        "Description": "description", "Source": "source_name", "Media Type": "media_type", "Campaign Type": "campaign_type",
        "Call Volume": plain("total_calls"), "Paid Calls": plain("paid_calls"), "Calls Over Threshold": plain("calls_over_threshold"),
        "Call Quality %": f"coalesce({fixed('call_quality_rate * 100e0', 2)}, '')", "Call Revenue": fixed("call_revenue", 2),
        "Lead Volume": plain("lead_volume"), "Leads Transferred": plain("leads_transferred"),
        "Lead Transfer Rate %": f"coalesce({fixed('lead_transfer_rate * 100e0', 2)}, '')", "Lead Revenue": fixed("lead_revenue", 2),
        "Click Volume": plain("click_volume"), "Click Revenue": fixed("click_revenue", 2), "Redirect Volume": plain("redirect_volume"),
        "Redirect Revenue": fixed("redirect_revenue", 2), "Total Revenue": fixed("total_revenue", 2),
        **{n: f"coalesce({fixed(c, 4)}, '')" for n, c in {"RPLead": "rp_lead", "RPQCall": "rp_qcall", "RPClick": "rp_click", "RPRedirect": "rp_redirect"}.items()},
        "Classification Reason": "classification_reason",
    }
    return f"{base()} SELECT " + ", ".join(f'{c} AS "{n}"' for n, c in cols.items()) + " FROM cls"


def _limit_text(c: str) -> str:
    p = f"({c} * 100e0)"
    return (f"CASE WHEN abs({p}) < 1 AND {p} <> 0 THEN {fixed(p, 2)} || '%' WHEN abs({p}) < 10 AND right({fixed(p, 2)}, 1) <> '0' THEN {fixed(p, 2)} || '%' "
            f"ELSE {fixed(p, 1)} || '%' END")


def oracle_queries() -> dict[str, str]:
    b, s = base(), scoped()
    ci, sc, al, ov = cohort_intelligence_cte(), scenario_cte(), alerts_cte(), overall_cte()
    facts = f"WITH {facts_cte()}, {window_cte()}, {report_ctes()}"
    direct = "sub_id, vertical, direct_calls, direct_paid_calls, direct_calls_over_threshold, total_leads, lead_revenue, total_clicks, click_revenue, call_revenue, redirect_volume, redirect_revenue, total_revenue"
    spelled = "unnest(list_distinct([t, upper(t)]))"
    meta = ", ".join(
        f"CASE WHEN count(DISTINCT nullif({c}, '')) > 1 THEN count(DISTINCT nullif({c}, '')) || ' {w}' ELSE coalesce(min(nullif({c}, '')), '') END AS {c}"
        for c, w in {"placement": "placements", "description": "descriptions", "source_name": "sources", "campaign_type": "types"}.items())
    fields = ", ".join(
        f"CASE WHEN {r} IS NOT NULL THEN {x} END AS {m}_{f}"
        for m, k, r, v, n in (("call", "c", "call_quality_rate", "total_calls", 50), ("lead", "l", "lead_transfer_rate", "lead_volume", 100))
        for f, x in {"value": r, "volume": v, "has_insufficient_volume": f"{v} < {n}", "tier": f"{m}_tier", "premium_min": f"{k}p",
                     "standard_min": f"coalesce({k}s, 0e0)", "pause_max": f"coalesce({k}x, 0e0)", "target": f"{k}t"}.items())
    out = {
        "report_direct_metrics": f"{facts} SELECT {direct} FROM direct",
        "report_top_placement": f"{facts} SELECT sub_id, vertical, top_placement, top_channel FROM direct",
        "report_outbound_link": f"{facts} SELECT * FROM outbound",
        "report_outbound_link_deduped": f"""WITH {facts_cte()}, {window_cte()},
            own AS (SELECT DISTINCT sub_id, vertical, session_id FROM win WHERE transaction_type = 'Lead' AND session_id IS NOT NULL)
            SELECT o.sub_id, o.vertical, count(DISTINCT o.session_id) AS lead_count, CAST(sum(coalesce(c.call_transfers, 0)) AS BIGINT) AS outbound_transfers,
              CAST(sum(coalesce(c.paid_calls, 0)) AS BIGINT) AS outbound_paid_calls,
              CAST(sum(CASE WHEN {LONG_CALL.format(v='o.vertical', d='c.call_duration')} THEN c.call_transfers ELSE 0 END) AS BIGINT) AS outbound_calls_over_threshold
            FROM own o LEFT JOIN (SELECT * FROM win WHERE call_category = 'Outbound') c ON o.session_id = c.session_id GROUP BY o.sub_id, o.vertical""",
        "report_full": f"{facts} SELECT * FROM report",
        "report_bucketed": f"{facts} SELECT * FROM report",
        "report_ordered": f"{b} SELECT sub_id, vertical, total_revenue, ord - 1 AS position FROM cls",
        "report_window": f"WITH {facts_cte()}, {window_cte('1998-06-01', '1998-07-01')}, {report_ctes()} SELECT * FROM report",
        "report_window_states": f"WITH {facts_cte()}, {window_cte('1998-06-01', '1998-07-01')}, {report_ctes()} SELECT * FROM report",
        "latest_snapshot_rows": f"WITH {facts_cte()} SELECT * EXCLUDE (snapshot_date) FROM dimension WHERE snapshot_date = (SELECT max(snapshot_date) FROM dimension)",
        "numeric_prefix_parse": """WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem),
            t AS (SELECT *, CASE l_linenumber WHEN 1 THEN q || 'abc' WHEN 2 THEN '  -' || q || '.5x' WHEN 3 THEN '$' || q WHEN 4 THEN ''
              WHEN 5 THEN q || 'e2' WHEN 6 THEN q || ',500' END AS cell FROM c)
            SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cell,
              coalesce(TRY_CAST(regexp_extract(cell, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE), 0e0) AS parsed FROM t""",
        "csv_upload": f"{b} SELECT sub_id, vertical, traffic_type, internal_channel, {', '.join(TEXTS)}, {', '.join(MEASURES)} FROM src",
        "csv_upload_semicolon": f"{b} SELECT sub_id, vertical, traffic_type, internal_channel, {', '.join(TEXTS)}, {', '.join(MEASURES)} FROM src",
        "csv_upload_line_breaks": f"""{b} SELECT sub_id, vertical, traffic_type, internal_channel, {', '.join(TEXTS)}, {', '.join(MEASURES)}
            FROM (SELECT * REPLACE (description || chr(10) || '"' || source_name || '", first,' || chr(10) || chr(10) || 'second' AS description) FROM src)""",
        "upload_record_counts": f"""{b} SELECT (SELECT count(*) FROM src) AS original_record_count,
            (SELECT count(*) FROM (SELECT DISTINCT vertical, traffic_type, coalesce(nullif(internal_channel, ''), 'Standard') FROM src)) AS total_records""",
        "upload_checks": f"""{b}, u AS (SELECT unnest(['all', 'Medicare', 'Health', 'Life', 'Auto', 'Home', 'None']) AS upload)
            SELECT upload, '' AS left_out, count(sub_id) AS parsed_rows, CASE WHEN count(sub_id) = 0 THEN 'no data provided' END AS refused
            FROM u LEFT JOIN src ON upload IN ('all', vertical) GROUP BY upload
            UNION ALL SELECT 'all', k, 0, 'column mapping required for: ' || k FROM (SELECT unnest(['subid', 'traffic_type', 'vertical']) AS k)""",
        "current_tiers": f"""{b}, sp AS (SELECT sub_id, unnest([coalesce(internal_channel, 'null'), ' ' || coalesce(internal_channel, 'null') || ' ', '']) AS t FROM src),
            u AS (SELECT DISTINCT sub_id, {spelled} AS channel_text FROM sp)
            SELECT sub_id, channel_text, CASE WHEN lower(trim(channel_text)) = 'premium' THEN 'Premium' ELSE 'Standard' END AS current_classification,
              channel_text IN ('', 'null', 'undefined') AS is_unmapped FROM u""",
        "metric_tiers": f"""{b} SELECT sub_id, vertical, {fields},
            coalesce(CASE WHEN call_quality_rate IS NOT NULL THEN {_limit_text('coalesce(cs, 0e0)')} END, '—') AS call_standard_text,
            coalesce(CASE WHEN lead_transfer_rate IS NOT NULL THEN {_limit_text('coalesce(ls, 0e0)')} END, '—') AS lead_standard_text FROM cls""",
        "classify_actions": f"{b} SELECT vertical, traffic_type, action, recommended_classification, count(*) AS sources, sum(total_revenue) AS revenue FROM cls GROUP BY ALL",
        "classify_reasons": f"""{b} SELECT sub_id, vertical, traffic_type, internal_channel, current_classification, is_unmapped, call_quality_rate, lead_transfer_rate, action,
            action_label, recommended_classification, classification_reason, has_warning, warning_reason, is_paused,
            CASE WHEN is_paused THEN classification_reason END AS pause_reason, has_insufficient_volume, insufficient_volume_reason, premium_min, standard_min,
            'sub_id' AS dimension FROM cls""",
        "action_counters": f"{b} SELECT count(*) AS total_records, {_counters()} FROM (SELECT {_stat('action')} AS cat FROM cls)",
        "rp_metrics": f"{b} SELECT sub_id, vertical, rp_lead, rp_qcall, rp_click, rp_redirect FROM cls",
        **{f"rollup_{d}": _rollup(d) for d in ("source_name", "placement", "media_type", "overall")},
        "rollup_metadata": f"""{b}, g AS (SELECT *, coalesce(nullif(media_type, ''), 'Unknown') AS grp, coalesce(internal_channel, 'Standard') AS chan FROM src)
            SELECT grp AS sub_id, vertical, traffic_type, chan AS internal_channel, first(channel ORDER BY ord) AS channel, {meta}, grp AS media_type
            FROM g GROUP BY grp, vertical, traffic_type, chan""",
        **{f"mode_{m}": f"{b}, {_mode_ctes(m)} SELECT sub_id, vertical, action, action_label, recommended_classification, is_paused, classification_reason, has_warning FROM mode"
           for m in ("call", "lead")},
        "view_counters": f"{b}, {_mode_ctes('lead')} SELECT {_counters()} FROM (SELECT {_stat('action')} AS cat FROM mode WHERE traffic_type = 'Full O&O')",
        "perf_status": f"{b} SELECT sub_id, vertical, {_status('call_quality_rate', 'c', 'total_calls', 50)} AS call_status, {_status('lead_transfer_rate', 'l', 'lead_volume', 100)} AS lead_status FROM cls",
        "quality_remarks": _remarks(),
        "explanation": _explanation(),
        "explanation_not_primary": _not_primary(),
        "revenue_mix": f"{b} SELECT sub_id, vertical, " + ", ".join(f"{m}_revenue / nullif(total_revenue, 0) * 100e0 AS {m}_share" for m in ("call", "lead", "click", "redirect")) + " FROM cls",
        "revenue_breakdown": f"{b} " + " UNION ALL ".join(
            f"SELECT sub_id, '{t}' AS revenue_type, {r} AS revenue, {v} AS volume, {rp} AS rp FROM cls"
            for t, r, v, rp in (("Calls", "call_revenue", "paid_calls", "rp_qcall"), ("Leads", "lead_revenue", "lead_volume", "rp_lead"),
                                ("Clicks", "click_revenue", "click_volume", "rp_click"), ("Redirects", "redirect_revenue", "redirect_volume", "rp_redirect"))),
        "revenue_share_in_vertical": f"""{b}, t AS (SELECT sub_id, vertical, traffic_type, total_revenue, sum(total_revenue) OVER (PARTITION BY vertical, traffic_type) AS cohort_total,
            sum(total_revenue) OVER (PARTITION BY vertical) AS vertical_total FROM cls)
            SELECT *, total_revenue / vertical_total * 100e0 AS vertical_share, total_revenue / cohort_total * 100e0 AS cohort_share FROM t""",
        "filter_sort_page": f"""{b} SELECT sub_id, vertical, action, total_revenue FROM cls WHERE traffic_type = 'Non O&O'
            AND action IN ('keep_premium', 'keep_premium_watch', 'keep_standard', 'keep_standard_close', 'no_premium_available', 'not_primary')
            ORDER BY total_revenue DESC, ord LIMIT 10 OFFSET 10""",
        "stored_page": f"""{b} SELECT sub_id, vertical, action, total_revenue FROM cls WHERE traffic_type = 'Non O&O'
            AND action IN ('keep_premium', 'keep_premium_watch', 'keep_standard', 'keep_standard_close', 'no_premium_available', 'not_primary')
            ORDER BY total_revenue DESC, ord LIMIT 10 OFFSET 10""",
        "locate_page": f"""{b}, o AS (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, ord) - 1 AS position FROM cls)
            SELECT sub_id, min(position) AS position, CAST(floor(min(position) / 25e0) AS BIGINT) + 1 AS page FROM o
            WHERE sub_id IN (SELECT sub_id FROM cls WHERE media_type = 'Search') GROUP BY sub_id""",
        "stored_places": f"""{b}, o AS (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, ord) - 1 AS position FROM cls)
            SELECT sub_id, min(position) AS position, CAST(floor(min(position) / 25e0) AS BIGINT) + 1 AS page FROM o
            WHERE sub_id IN (SELECT sub_id FROM cls WHERE media_type = 'Search') GROUP BY sub_id""",
        "distinct_media": f"{b} SELECT DISTINCT media_type FROM cls WHERE media_type <> '' ORDER BY 1",
        "selection_sets": f"""{b}, a AS (SELECT DISTINCT sub_id FROM cls WHERE action IN ('upgrade_to_premium', 'warning_14_day')), t AS (SELECT DISTINCT sub_id FROM cls WHERE media_type = 'Social')
            SELECT sub_id FROM a WHERE sub_id NOT IN (SELECT sub_id FROM t) UNION ALL SELECT sub_id FROM t WHERE sub_id NOT IN (SELECT sub_id FROM a)""",
        "selection_compare_groups": _compare(False),
        "selection_compare_total": _compare(True),
        "anomalies": f"{s} SELECT sub_id, cohort_name, anomaly_type <> 'none' AS is_anomaly, anomaly_type, {_round('call_z', 'lead_z', 'revenue_z')}, anomaly_reasons FROM ins",
        "clusters": f"""{s} SELECT sub_id, vertical, cluster, cluster_label, CASE cluster WHEN 0 THEN 'Premium sources meeting all quality targets'
            WHEN 1 THEN 'Standard sources meeting Premium thresholds - ready for upgrade' WHEN 2 THEN 'Standard sources meeting quality requirements'
            WHEN 3 THEN 'Sources with declining quality or 14-day warnings' WHEN 4 THEN 'Sources requiring immediate action - pause or urgent attention'
            WHEN 5 THEN 'Insufficient data for reliable classification' ELSE 'Requires manual review' END AS cluster_description, composite_score FROM ins""",
        "cluster_summary": f"""{s} SELECT cluster AS cluster_id, cluster_label AS label, CASE cluster WHEN 0 THEN 'Premium sources meeting all quality targets'
            WHEN 1 THEN 'Standard sources meeting Premium thresholds' WHEN 2 THEN 'Standard sources meeting quality requirements'
            WHEN 3 THEN 'Sources with declining quality or warnings' WHEN 4 THEN 'Sources requiring immediate action'
            WHEN 5 THEN 'Insufficient data for classification' ELSE 'Requires manual review' END AS description, count(*) AS sources, sum(total_revenue) AS total_revenue,
            round(avg(call_quality_rate), 6) AS avg_call_quality, round(avg(lead_transfer_rate), 6) AS avg_lead_quality, round(avg(total_revenue), 6) AS avg_revenue
            FROM ins GROUP BY cluster, cluster_label""",
        "cluster_members": f"{s} SELECT sub_id, composite_score, call_quality_rate, lead_transfer_rate FROM ins WHERE cluster = 3",
        "risk_scores": f"{s} SELECT sub_id, vertical, risk_score, risk_level, risk_confidence, risk_factors FROM ins",
        "peer_percentiles": f"{s} SELECT sub_id, cohort_name AS peer_group, peers AS peer_count, call_percentile, lead_percentile, revenue_percentile, overall_percentile FROM ins",
        "cohort_multiplier": f"{s} SELECT vertical, traffic_type, peers, premium_peers, other_peers, median_premium, median_other, im AS impact_multiplier, om AS opportunity_multiplier FROM mult",
        "revenue_impacts": f"{s} SELECT sub_id, vertical, total_revenue, {_round('projected_revenue', 'potential_gain', 'potential_loss', d=4)}, impact_action, impact_confidence FROM ins",
        "momentum": f"{s} SELECT sub_id, vertical, quality_momentum, volume_momentum, trajectory, revenue_efficiency, performance_index, momentum_confidence FROM ins",
        "opportunity_matrix": f"{s} SELECT sub_id, vertical, opportunity_type, impact_score, urgency_score, priority_score, potential_revenue, opportunity_action, timeframe, opportunity_confidence, rationale FROM ins",
        "priority_top": f"{s} SELECT sub_id, opportunity_type, priority_score FROM ins WHERE opportunity_type = 'remediate' ORDER BY priority_score DESC, ord LIMIT 3",
        "opportunity_counts": f"{s} SELECT opportunity_type, count(*) AS sources FROM ins GROUP BY 1",
        "source_profile": f"""{s} SELECT sub_id, vertical, traffic_type, current_classification, action, call_quality_rate, lead_transfer_rate, total_revenue, risk_score, risk_level,
            overall_percentile, cluster_label, anomaly_type <> 'none' AS is_anomaly, anomaly_type, risk_factors FROM ins""",
        "cohort_intelligence": f"""{s}, {ci} SELECT vertical, traffic_type, cohort_name, source_count, total_revenue,
            {_round('revenue_share', 'avg_call_quality', 'avg_lead_quality', 'call_quality_delta', 'lead_quality_delta')}, round(revenue_delta, 3) AS revenue_delta,
            top_performer_traits, common_issues, optimization_potential, health_score, risk_concentration FROM ci""",
        "cohort_top_performers": f"{s}, {ci} SELECT sub_id, vertical, traffic_type, position, total_revenue FROM best",
        "cohorts_ordered": f"{s}, {ci} SELECT cohort_name, total_revenue, health_score, row_number() OVER (ORDER BY total_revenue DESC, cohort_name) - 1 AS position FROM ci",
        "portfolio_health": f"{s} {health_select()}",
        "what_if": f"""{s}, {sc} SELECT scenario_no, scenario, affected_count, current_revenue, {_round('projected_revenue', 'revenue_change', d=3)},
            round(revenue_change_percent, 6) AS revenue_change_percent, quality_impact, risk_assessment FROM sc""",
        "what_if_members": f"""{s}, mm AS (SELECT CASE WHEN action = 'upgrade_to_premium' THEN 1 WHEN action = 'pause_immediate' THEN 2 WHEN cluster = 3 THEN 3 END AS scenario_no, sub_id FROM ins
            UNION ALL SELECT 4, sub_id FROM (SELECT sub_id, count(*) OVER () AS n FROM ins WHERE cluster = 2) WHERE n > 3)
            SELECT scenario_no, sub_id, CASE scenario_no WHEN 1 THEN 'Promote All Eligible to Premium' WHEN 2 THEN 'Pause All Critical Sources'
              WHEN 3 THEN 'Remediate Watch List Sources' ELSE 'Quality Improvement Initiative' END AS scenario FROM mm WHERE scenario_no IS NOT NULL""",
        "scenario_facts": f"""{s}, {sc} SELECT scenario, affected_count, current_revenue, round(projected_revenue, 3) AS projected_revenue,
            round(revenue_change_percent, 6) AS revenue_change_percent, quality_impact, risk_assessment FROM sc""",
        "smart_alerts": f"{s}, {ci}, {al} SELECT * REPLACE (round(potential_impact, 3) AS potential_impact) FROM al",
        "alerts_ordered": f"{s}, {ci}, {al} SELECT alert_id, severity, row_number() OVER (ORDER BY severity_rank, rule) - 1 AS position FROM al",
        "alert_members": f"""{s}, {ci} SELECT CASE WHEN action = 'pause_immediate' THEN 1 WHEN action = 'warning_14_day' THEN 2 WHEN action = 'upgrade_to_premium' THEN 3 END AS rule, sub_id FROM ins
              WHERE action IN ('pause_immediate', 'warning_14_day', 'upgrade_to_premium')
            UNION ALL SELECT 4, sub_id FROM (SELECT * FROM ins ORDER BY total_revenue DESC, ord LIMIT 1) WHERE total_revenue > grand_total * 0.25e0
            UNION ALL SELECT 5, sub_id FROM (SELECT i.sub_id FROM ins i
              JOIN ci ON ci.vertical = i.vertical AND ci.traffic_type = i.traffic_type WHERE health_score < 50 AND source_count >= 3)
            UNION ALL SELECT 6, sub_id FROM ins WHERE risk_level = 'high' AND total_revenue > grand_total * 0.05e0
            UNION ALL SELECT 7, sub_id FROM ins WHERE action = 'keep_standard_close' AND (SELECT count(*) FROM ins WHERE action = 'keep_standard_close') >= 3""",
        "overall_insights": f"""{s}, {ci}, {sc}, {al}, {ov} SELECT * REPLACE (round(total_potential_gain, 3) AS total_potential_gain, round(total_potential_loss, 3) AS total_potential_loss,
            round(optimization_opportunity, 3) AS optimization_opportunity) FROM ov""",
        "executive_facts": f"""{s}, {ci}, {sc}, {al}, {ov} SELECT (SELECT count(*) FROM ins) AS total_sources, (SELECT count(*) FROM ins WHERE current_classification = 'Premium') AS premium_count,
            (SELECT count(*) FROM ins WHERE current_classification = 'Standard') AS standard_count, (SELECT count(*) FROM ins WHERE action = 'pause_immediate') AS pause_count,
            (SELECT sum(total_revenue) FROM ins) AS total_revenue, revenue_at_risk, high_risk_count, round(optimization_opportunity, 3) AS optimization_opportunity,
            top_performers, at_risk_performers, positive_anomalies, negative_anomalies,
            (SELECT string_agg(cluster_label || ':' || n, ', ' ORDER BY cluster) FROM (SELECT cluster, cluster_label, count(*) AS n FROM ins GROUP BY 1, 2)) AS cluster_summary,
            'All Data' AS filter_context FROM ov, hs""",
        "scoped_health": "{} {}".format(scoped("media_type = 'Search'"), health_select()),
        "history_search": f"""{_history()} SELECT * FROM h WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21' AND vertical = 'Health'
            AND (lower(sub_id) LIKE '%"k": 1%' OR lower(notes) LIKE '%"k": 1%')""",
        "history_search_indexed": f"{_history()} SELECT * FROM h WHERE lower(sub_id) LIKE '%sub00017%' OR lower(notes) LIKE '%sub00017%'",
        "history_by_person": f"""{_history()} SELECT * FROM h WHERE traffic_type = 'Full O&O' AND media_type = 'Search' AND taken_by = 'Ana'
            AND (lower(sub_id) LIKE '%sub0000%' OR lower(notes) LIKE '%sub0000%')""",
        "history_latest": f"{_history()} SELECT * FROM h ORDER BY created_at DESC, sub_id, action_taken LIMIT 50",
        "history_options": f"{_history()} " + " UNION ALL ".join(
            f"SELECT '{c}' AS filter, {c} AS value FROM h WHERE {c} <> '' GROUP BY {c}" for c in ("vertical", "traffic_type", "media_type", "taken_by")),
        "decision_log": f"""{b}, g AS (SELECT *, CASE {_stat('action')} WHEN 'promote' THEN 'promote' WHEN 'demote' THEN 'demote' WHEN 'pause' THEN 'pause' WHEN 'below' THEN 'below'
              ELSE 'correct' END AS action_taken FROM cls)
            SELECT sub_id, vertical, traffic_type, nullif(media_type, '') AS media_type, action_taken,
              CASE action_taken WHEN 'promote' THEN 'Promoted to Premium' WHEN 'demote' THEN 'Demoted to Standard' WHEN 'pause' THEN 'PAUSED' WHEN 'below' THEN 'Flagged Below MIN'
                ELSE 'Maintained Current' END AS action_label, current_classification AS previous_state,
              CASE action_taken WHEN 'promote' THEN 'Premium' WHEN 'demote' THEN 'Standard' WHEN 'pause' THEN 'PAUSED' ELSE current_classification END AS new_state,
              'both' AS metric_mode, call_quality_rate AS call_quality, lead_transfer_rate AS lead_quality, total_revenue, CAST(NULL AS VARCHAR) AS notes, 'Ana' AS taken_by,
              TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM g""",
        "runs_latest": _runs_ctes(*RUNS) + " " + " UNION ALL ".join(_run_header(run, *RUNS[run], i + 1, f"cls_{run}") for i, run in enumerate(RUNS)),
        "run_with_results": _run_with_results(),
        "threshold_overrides": _overrides(),
        "export_view": _export(),
    }
    return out
