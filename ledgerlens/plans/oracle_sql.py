"""DuckDB twins of the registered queries, for the correctness gate.

Each statement runs on the driver's pre-registered star-schema views and
derives the two operational tables with the same rules as
``sources.conform`` (written independently, in SQL). Rounding uses the same
exact integer forms as ``functions.core``.
"""

from __future__ import annotations

from .. import constants as K
from .forest_sql import forest_ctes

AS_OF = "2024-01-31 00:00:00"


def _list(values) -> str:
    """A DuckDB list literal of the fixed values, in their order."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sla_case(col: str, default_low: bool = True) -> str:
    """CASE over the priority labels giving the fixed SLA hours."""
    items = list(K.SLA_TARGET_BY_PRIORITY.items())
    last = items[-1]
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in (items[:-1] if default_low else items))
    return f"CASE {col} {whens} " + (f"ELSE {last[1]} END" if default_low else "END")


def _penalty_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}E0" for k, v in K.TEAM_PENALTY_HOURS.items())
    return f"CASE {col} {whens} ELSE 0.0E0 END"


CONFORM = f"""
WITH RECURSIVE nr AS (
  SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
txn_base AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value,
         o.o_custkey, o.o_totalprice, o.o_orderpriority, nr.r_name,
         o.o_totalprice * e.value / 1000.0E0 AS amount,
         1 + (o.o_custkey * 37) % 3650 AS account_age_days
  FROM events e
  JOIN orders o ON o.o_orderkey = e.event_id
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nr ON c.c_nationkey = nr.n_nationkey
),
txn_risk AS (
  SELECT *, least(100.0E0, greatest(0.0E0,
           o_totalprice / 6250.0E0
           + CASE WHEN amount > 100000.0E0 THEN 12.0E0 ELSE 0.0E0 END
           + CASE WHEN account_age_days < 30 THEN 15.0E0 ELSE 0.0E0 END)) AS risk_score
  FROM txn_base
),
txn_e AS (
  SELECT
    'TXN' || CAST(100000 + event_id AS VARCHAR) AS transaction_id,
    ts AS "timestamp",
    CAST(o_custkey AS BIGINT) AS customer_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'UPI' WHEN '2-HIGH' THEN 'Card'
         WHEN '3-MEDIUM' THEN 'NetBanking' WHEN '4-NOT SPECIFIED' THEN 'Wallet' ELSE 'POS' END AS channel,
    {_list(K.TRANSACTION_TYPES)}[event_id % 6 + 1] AS transaction_type,
    amount,
    'INR' AS currency,
    CASE WHEN event_type = 'error' THEN 'Failed' WHEN event_id % 50 = 0 THEN 'Pending'
         WHEN event_id % 67 = 0 THEN 'Reversed' ELSE 'Success' END AS status,
    CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 41 = 0 THEN ''
         ELSE {_list(K.FAILURE_REASONS)}[event_id % 9 + 1]
    END AS failure_reason,
    CAST(50 + floor(value * 20) AS INTEGER) AS processing_time_ms,
    'Gateway' || chr(CAST(65 + user_id % 4 AS INTEGER)) AS gateway,
    r_name AS region,
    {_list(K.DEVICE_TYPES)}[event_id % 4 + 1] AS device_type,
    CAST(CASE WHEN event_type = 'error' THEN o_custkey % 5 WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
    CAST(CASE WHEN risk_score > 70 AND event_id % 5 < 2 THEN 1 ELSE 0 END AS INTEGER) AS is_fraud_flag,
    {_list(K.MERCHANT_CATEGORIES)}[o_custkey % 8 + 1] AS merchant_category,
    CAST(account_age_days AS INTEGER) AS account_age_days,
    risk_score,
    event_id
  FROM txn_risk
),
transactions AS (
  SELECT transaction_id, "timestamp", customer_id, channel, transaction_type, amount, currency, status,
         failure_reason, processing_time_ms, gateway, region, device_type, retry_count, is_fraud_flag,
         merchant_category, account_age_days, risk_score
  FROM txn_e
),
tk_base AS (
  SELECT l.*, o.o_custkey, nr.r_name AS s_region, t.transaction_id AS t_transaction_id,
         t."timestamp" AS t_timestamp, t.event_id AS t_event_id,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
              WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS priority,
         CASE WHEN l.l_partkey % 100 < 35 THEN 'Tier1-Support' WHEN l.l_partkey % 100 < 55 THEN 'Tier2-Technical'
              WHEN l.l_partkey % 100 < 70 THEN 'Fraud-Risk' WHEN l.l_partkey % 100 < 90 THEN 'Billing-Ops'
              ELSE 'Premium-Care' END AS agent_team,
         CASE WHEN l.l_returnflag = 'R' THEN 'Reopened' WHEN l.l_returnflag = 'A' THEN 'Resolved'
              WHEN l.l_linestatus = 'F' THEN 'Closed' ELSE 'Pending' END AS tstatus
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  LEFT JOIN (SELECT * FROM txn_e WHERE status IN ('Failed', 'Reversed')) t ON t.event_id = l.l_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nr ON s.s_nationkey = nr.n_nationkey
),
tk_sla AS (
  SELECT *, {_sla_case("priority")} AS target
  FROM tk_base
),
tk_res AS (
  SELECT *, l_quantity * 0.25E0
            + {_penalty_case("agent_team")}
            + CAST(target AS DOUBLE) * 0.15E0 AS res,
         CASE WHEN t_event_id IS NOT NULL THEN t_timestamp + to_hours(CAST(1 + l_partkey % 71 AS BIGINT))
              ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((l_orderkey * 13) % 43200 AS BIGINT)) END AS created
  FROM tk_sla
),
support_tickets AS (
  SELECT
    'TCK' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
          || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS ticket_id,
    created AS created_at,
    CASE WHEN tstatus IN ('Resolved', 'Closed', 'Reopened')
         THEN created + to_seconds(CAST(round(res * 3600.0E0) AS BIGINT)) END AS resolved_at,
    CAST(o_custkey AS BIGINT) AS customer_id,
    CASE WHEN t_event_id IS NOT NULL THEN t_transaction_id WHEN l_linenumber % 2 = 1 THEN '' ELSE NULL END
      AS related_transaction_id,
    {_list(K.ISSUE_CATEGORIES)}[l_partkey % 8 + 1] AS issue_category,
    priority,
    {_list(K.TICKET_CHANNELS)}[l_suppkey % 4 + 1] AS channel,
    s_region AS region,
    CAST(target AS INTEGER) AS sla_target_hours,
    res AS resolution_time_hours,
    CAST(CASE WHEN res > target THEN 1 ELSE 0 END AS INTEGER) AS sla_breached,
    'AGT' || CAST(1000 + (l_partkey * 7 + l_suppkey) % 600 AS VARCHAR) AS agent_id,
    agent_team,
    CAST(CASE WHEN res > target THEN 1 + l_linenumber % 3 ELSE 3 + l_linenumber % 3 END AS INTEGER) AS csat_score,
    tstatus AS status,
    CAST(CASE WHEN res > target AND l_partkey % 10 < 3 THEN 1 ELSE 0 END AS INTEGER) AS escalation_flag,
    CAST(CASE WHEN tstatus = 'Reopened' THEN 1 + l_linenumber % 3 ELSE 0 END AS INTEGER) AS reopened_count
  FROM tk_res
)
"""


def rate_pct(num: str, den: str) -> str:
    """Twin of ``functions.core.rate_pct_2dp``."""
    return (f"CASE WHEN ({den}) > 0 THEN CAST((2 * 100 * 100 * CAST({num} AS BIGINT) + CAST({den} AS BIGINT))"
            f" // (2 * CAST({den} AS BIGINT)) AS DOUBLE) / 100.0E0 END")


def ratio_half_up(num: str, den: str, scale: int) -> str:
    return (f"CASE WHEN ({den}) > 0 THEN CAST((2 * {scale} * CAST({num} AS BIGINT) + CAST({den} AS BIGINT))"
            f" // (2 * CAST({den} AS BIGINT)) AS DOUBLE) / {float(scale)!r}E0 END")


def units(x: str) -> str:
    return f"CAST(round({x} * 1000000.0E0) AS BIGINT)"


def mean_2dp_units(sum_units: str, n: str) -> str:
    return ratio_half_up(sum_units, f"({n}) * 1000000", 100)


def round_half_away(x: str, digits: int) -> str:
    p = float(10 ** digits)
    return (f"(CASE WHEN ({x}) < 0 THEN -1.0E0 ELSE 1.0E0 END) * "
            f"(floor(abs({x}) * {p}E0 + 0.5E0) / {p}E0)")


def round_half_even(x: str, digits: int) -> str:
    p = float(10 ** digits)
    return f"(round_even(({x}) * {p}E0, 0) / {p}E0)"


def pct(num: str, den: str) -> str:
    return f"(100.0E0 * (CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)))"


def sample_hash(key: str, seed: int) -> str:
    """Twin of ``operators.quantile.sample_hash``."""
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 15) AS BIGINT)"


def with_conform(body: str) -> str:
    """A full statement: the conform CTEs followed by ``body``'s CTEs/select.

    ``body`` starts either with ``SELECT`` or with ``, name AS (...)`` to add
    more CTEs.
    """
    body = body.strip()
    if body.startswith(","):
        return CONFORM + body
    return CONFORM + "\n" + body


def analysis_sql() -> dict[str, str]:
    q = {}
    q["gateway_health"] = with_conform(f"""
, g AS (
  SELECT gateway, COUNT(*) AS total_txns,
         CAST(SUM(CASE WHEN status = 'Success' THEN 1 ELSE 0 END) AS BIGINT) AS successful,
         CAST(SUM(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
         CAST(SUM(processing_time_ms) AS BIGINT) AS s_pt, COUNT(processing_time_ms) AS n_pt
  FROM transactions GROUP BY gateway)
SELECT gateway, total_txns, successful, failed,
       {rate_pct('successful', 'total_txns')} AS success_rate_pct,
       {rate_pct('failed', 'total_txns')} AS failure_rate_pct,
       {ratio_half_up('s_pt', 'n_pt', 10)} AS avg_processing_time_ms
FROM g ORDER BY failure_rate_pct DESC, gateway""")

    q["failure_reasons"] = with_conform(f"""
, f AS (
  SELECT failure_reason, COUNT(*) AS occurrences,
         (SELECT COUNT(*) FROM transactions WHERE status = 'Failed') AS all_failed
  FROM transactions WHERE status = 'Failed' AND failure_reason <> ''
  GROUP BY failure_reason)
SELECT failure_reason, occurrences, {rate_pct('occurrences', 'all_failed')} AS pct_of_all_failures
FROM f ORDER BY occurrences DESC, failure_reason""")

    q["daily_throughput"] = with_conform(f"""
, d AS (
  SELECT CAST("timestamp" AS DATE) AS txn_date, COUNT(*) AS total_txns,
         CAST(SUM(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed_txns,
         AVG(amount) AS a
  FROM transactions GROUP BY CAST("timestamp" AS DATE))
SELECT txn_date, total_txns, failed_txns, {rate_pct('failed_txns', 'total_txns')} AS failure_rate_pct,
       {round_half_away('a', 2)} AS avg_txn_amount
FROM d ORDER BY txn_date""")

    means = f"""COUNT(*) AS n, CAST(SUM({units('resolution_time_hours')}) AS BIGINT) AS rc,
         COUNT(resolution_time_hours) AS n_res, CAST(SUM(csat_score) AS BIGINT) AS cs, COUNT(csat_score) AS n_cs"""
    q["sla_by_priority_team"] = with_conform(f"""
, g AS (
  SELECT priority, agent_team, {means}, CAST(SUM(sla_breached) AS BIGINT) AS breached_tickets
  FROM support_tickets GROUP BY priority, agent_team)
SELECT priority, agent_team, n AS total_tickets, breached_tickets,
       {rate_pct('breached_tickets', 'n')} AS sla_breach_rate_pct,
       {mean_2dp_units('rc', 'n_res')} AS avg_resolution_hours,
       {ratio_half_up('cs', 'n_cs', 100)} AS avg_csat
FROM g ORDER BY sla_breach_rate_pct DESC, priority, agent_team""")

    q["agent_efficiency"] = with_conform(f"""
, g AS (
  SELECT agent_id, agent_team, {means},
         CAST(SUM(sla_breached) AS BIGINT) AS sla_breaches, CAST(SUM(escalation_flag) AS BIGINT) AS escalations
  FROM support_tickets GROUP BY agent_id, agent_team HAVING COUNT(*) >= 20)
SELECT agent_id, agent_team, n AS tickets_handled,
       {mean_2dp_units('rc', 'n_res')} AS avg_resolution_hours,
       sla_breaches, escalations, {ratio_half_up('cs', 'n_cs', 100)} AS avg_csat
FROM g ORDER BY avg_resolution_hours DESC, agent_id, agent_team LIMIT 20""")

    q["ticket_impact_by_reason"] = with_conform(f"""
, g AS (
  SELECT t.failure_reason, COUNT(DISTINCT s.ticket_id) AS tickets_generated,
         CAST(SUM({units('s.resolution_time_hours')}) AS BIGINT) AS rc, COUNT(s.resolution_time_hours) AS n_res,
         CAST(SUM(s.csat_score) AS BIGINT) AS cs, COUNT(s.csat_score) AS n_cs
  FROM support_tickets s JOIN transactions t ON s.related_transaction_id = t.transaction_id
  WHERE s.related_transaction_id <> ''
  GROUP BY t.failure_reason)
SELECT failure_reason, tickets_generated, {mean_2dp_units('rc', 'n_res')} AS avg_resolution_hours,
       {ratio_half_up('cs', 'n_cs', 100)} AS avg_csat
FROM g ORDER BY tickets_generated DESC, failure_reason NULLS FIRST""")
    q["ticket_impact_bucketed"] = q["ticket_impact_by_reason"]

    us = "(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at))".replace("{AS_OF}", AS_OF)
    q["sla_risk"] = with_conform(f"""
, p AS (SELECT *, {us} AS d FROM support_tickets WHERE status = 'Pending')
SELECT ticket_id, priority, agent_team, created_at, sla_target_hours,
       (CASE WHEN d < 0 THEN -1.0E0 ELSE 1.0E0 END)
         * (CAST((2 * abs(d) + 36000000) // 72000000 AS DOUBLE) / 100.0E0) AS hours_open,
       CASE WHEN d > CAST(sla_target_hours AS BIGINT) * 3600000000 THEN 'BREACHED'
            WHEN d * 10 > CAST(sla_target_hours AS BIGINT) * 3600000000 * 8 THEN 'AT RISK'
            ELSE 'ON TRACK' END AS sla_risk_status
FROM p ORDER BY hours_open DESC, ticket_id""")

    q["processing_time_outliers"] = with_conform(f"""
, st AS (
  SELECT CAST(COUNT(processing_time_ms) AS HUGEINT) AS n, CAST(SUM(processing_time_ms) AS HUGEINT) AS s1,
         SUM(CAST(processing_time_ms AS HUGEINT) * processing_time_ms) AS s2 FROM transactions),
z AS (
  SELECT t.transaction_id, t.gateway, t.processing_time_ms,
         st.n * t.processing_time_ms - st.s1 AS num, st.n * st.s2 - st.s1 * st.s1 AS v
  FROM transactions t, st)
SELECT transaction_id, gateway, processing_time_ms,
       {round_half_away('CAST(num AS DOUBLE) / sqrt(CAST(v AS DOUBLE))', 2)} AS z_score
FROM z WHERE v > 0 AND num * num > 9 * v
ORDER BY z_score DESC, transaction_id LIMIT 100""")

    q["regional_health"] = with_conform(f"""
, g AS (
  SELECT region, COUNT(*) AS total_txns, CAST(SUM(CASE WHEN status = 'Success' THEN 1 ELSE 0 END) AS BIGINT) AS ok,
         CAST(SUM(is_fraud_flag) AS BIGINT) AS fraud_flagged_txns
  FROM transactions GROUP BY region)
SELECT region, total_txns, {rate_pct('ok', 'total_txns')} AS success_rate_pct, fraud_flagged_txns
FROM g ORDER BY success_rate_pct ASC, region""")
    return q


# The view filter registered for the filtered-table queries (a real date
# window, three regions, two gateways).
DEMO_FILTER = {"start": "2024-01-08", "end": "2024-01-21",
               "regions": ("AMERICA", "ASIA", "EUROPE"), "gateways": ("GatewayA", "GatewayC")}


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def filtered_views(spec: dict | None = None) -> str:
    """CTEs ``ftxn`` and ``ftk``: the filtered transactions and tickets."""
    if spec is None:
        return """
, bounds AS (SELECT min(CAST("timestamp" AS DATE)) AS lo, max(CAST("timestamp" AS DATE)) AS hi FROM transactions),
ftxn AS (SELECT * FROM transactions WHERE "timestamp" IS NOT NULL),
ftk AS (SELECT s.* FROM support_tickets s, bounds b
        WHERE s.created_at >= CAST(b.lo AS TIMESTAMP) AND s.created_at < CAST(b.hi + 1 AS TIMESTAMP))"""
    lo, hi = f"TIMESTAMP '{spec['start']} 00:00:00'", f"(CAST(DATE '{spec['end']}' + 1 AS TIMESTAMP))"
    return f"""
, ftxn AS (SELECT * FROM transactions WHERE "timestamp" >= {lo} AND "timestamp" < {hi}
           AND region IN {_in(spec['regions'])} AND gateway IN {_in(spec['gateways'])}),
ftk AS (SELECT * FROM support_tickets WHERE created_at >= {lo} AND created_at < {hi}
        AND region IN {_in(spec['regions'])})"""


def _kpi_body() -> str:
    return f"""
, t AS (SELECT COUNT(*) AS total_txns,
               CAST(SUM(CASE WHEN status = 'Success' THEN 1 ELSE 0 END) AS BIGINT) AS ok,
               CAST(SUM(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
               CAST(SUM(processing_time_ms) AS BIGINT) AS pt_sum, COUNT(processing_time_ms) AS pt_n FROM ftxn),
k AS (SELECT COUNT(*) AS total_tickets, CAST(SUM(sla_breached) AS BIGINT) AS br, COUNT(sla_breached) AS br_n,
             CAST(SUM({units('resolution_time_hours')}) AS BIGINT) AS res, COUNT(resolution_time_hours) AS res_n,
             CAST(SUM(csat_score) AS BIGINT) AS cs, COUNT(csat_score) AS cs_n FROM ftk)
SELECT total_txns,
       coalesce({pct('ok', 'nullif(total_txns, 0)')}, 0.0E0) AS success_rate,
       coalesce({pct('failed', 'nullif(total_txns, 0)')}, 0.0E0) AS failure_rate,
       coalesce(CAST(pt_sum AS DOUBLE) / CAST(nullif(pt_n, 0) AS DOUBLE), 0.0E0) AS avg_proc_time,
       total_tickets,
       coalesce({pct('br', 'nullif(br_n, 0)')}, 0.0E0) AS sla_breach_rate,
       coalesce(CAST(res AS DOUBLE) / (1000000.0E0 * CAST(nullif(res_n, 0) AS DOUBLE)), 0.0E0) AS avg_resolution,
       coalesce(CAST(cs AS DOUBLE) / CAST(nullif(cs_n, 0) AS DOUBLE), 0.0E0) AS avg_csat
FROM t, k"""


def dashboard_sql() -> dict[str, str]:
    v = filtered_views()
    q = {}
    q["filtered_transactions"] = with_conform(filtered_views(DEMO_FILTER) + "\nSELECT * FROM ftxn")
    q["filtered_tickets"] = with_conform(filtered_views(DEMO_FILTER) + "\nSELECT * FROM ftk")
    q["filter_domains"] = with_conform("""
SELECT 'min_date' AS kind, CAST(min(CAST("timestamp" AS DATE)) AS VARCHAR) AS value FROM transactions
UNION ALL SELECT 'max_date', CAST(max(CAST("timestamp" AS DATE)) AS VARCHAR) FROM transactions
UNION ALL SELECT DISTINCT 'region', region FROM transactions WHERE region IS NOT NULL
UNION ALL SELECT DISTINCT 'gateway', gateway FROM transactions WHERE gateway IS NOT NULL""")
    q["kpi_summary"] = with_conform(v + _kpi_body())
    q["kpi_summary_filtered"] = with_conform(filtered_views(DEMO_FILTER) + _kpi_body())
    return q | _dataset_sql(v)


def cube_sql() -> dict[str, str]:
    """The datasets that the cube answers, under a view filter: the same statements over rows."""
    v = filtered_views(DEMO_FILTER)
    found = {"filter_domains": dashboard_sql()["filter_domains"], "kpi_summary": with_conform(v + _kpi_body())} | _dataset_sql(v)
    rows = analysis_sql()["ticket_impact_by_reason"][len(CONFORM):].replace("FROM support_tickets s", "FROM ftk s")
    found["ticket_impact_by_reason"] = with_conform(v + rows)
    return {f"cube_{name}": sql for name, sql in found.items()}


def _dataset_sql(v: str) -> dict[str, str]:
    q = {}
    q["daily_failure_trend"] = with_conform(v + """
SELECT CAST("timestamp" AS DATE) AS date, COUNT(transaction_id) AS total,
       CAST(SUM(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       CAST(100 * SUM(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(transaction_id) AS DOUBLE)
         AS failure_rate_pct
FROM ftxn WHERE "timestamp" IS NOT NULL GROUP BY CAST("timestamp" AS DATE) ORDER BY date""")
    q["gateway_performance"] = with_conform(v + f"""
SELECT gateway, COUNT(transaction_id) AS total,
       {pct("SUM(CASE WHEN status = 'Success' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS success_rate,
       CAST(SUM(processing_time_ms) AS DOUBLE) / CAST(COUNT(processing_time_ms) AS DOUBLE) AS avg_proc
FROM ftxn WHERE gateway IS NOT NULL GROUP BY gateway ORDER BY gateway""")
    q["top_failure_reasons"] = with_conform(v + """
SELECT failure_reason, COUNT(*) AS count FROM ftxn
WHERE status = 'Failed' AND failure_reason <> ''
GROUP BY failure_reason ORDER BY count DESC, failure_reason LIMIT 10""")
    q["regional_ops"] = with_conform(v + f"""
SELECT region, COUNT(transaction_id) AS total,
       {pct("SUM(CASE WHEN status = 'Success' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS success_rate,
       CAST(SUM(is_fraud_flag) AS BIGINT) AS fraud_flagged
FROM ftxn WHERE region IS NOT NULL GROUP BY region ORDER BY region""")
    q["sla_heatmap"] = with_conform(v + f"""
SELECT priority, agent_team, COUNT(ticket_id) AS total,
       {pct('SUM(sla_breached)', 'COUNT(sla_breached)')} AS breach_rate
FROM ftk WHERE priority IS NOT NULL AND agent_team IS NOT NULL
GROUP BY priority, agent_team ORDER BY priority, agent_team""")
    c = units("resolution_time_hours")
    q["resolution_distribution"] = with_conform(v + f"""
, g AS (SELECT agent_team, min({c}) AS mn, quantile_cont({c}, [0.25, 0.5, 0.75]) AS qs, max({c}) AS mx
        FROM ftk WHERE agent_team IS NOT NULL AND resolution_time_hours IS NOT NULL GROUP BY agent_team)
SELECT agent_team, CAST(mn AS DOUBLE) / 1000000.0E0 AS "min", qs[1] / 1000000.0E0 AS q1, qs[2] / 1000000.0E0 AS median,
       qs[3] / 1000000.0E0 AS q3, CAST(mx AS DOUBLE) / 1000000.0E0 AS "max"
FROM g ORDER BY agent_team""")
    q["csat_by_sla_outcome"] = with_conform(v + """
SELECT CASE sla_breached WHEN 0 THEN 'SLA Met' WHEN 1 THEN 'SLA Breached' END AS sla_outcome,
       CAST(SUM(csat_score) AS DOUBLE) / CAST(COUNT(csat_score) AS DOUBLE) AS csat_score
FROM ftk WHERE sla_breached IS NOT NULL GROUP BY sla_breached ORDER BY sla_outcome""")
    q["bottleneck_agents"] = with_conform(v + f"""
, g AS (SELECT agent_id, agent_team, COUNT(ticket_id) AS tickets,
               CAST(SUM({c}) AS DOUBLE) / (1000000.0E0 * CAST(COUNT(resolution_time_hours) AS DOUBLE)) AS avg_resolution,
               CAST(SUM(sla_breached) AS BIGINT) AS breaches
        FROM ftk WHERE agent_id IS NOT NULL AND agent_team IS NOT NULL GROUP BY agent_id, agent_team)
SELECT * FROM g WHERE tickets >= 20 ORDER BY avg_resolution DESC, agent_id, agent_team LIMIT 10""")
    return q


def _reason_sql() -> str:
    zf = ("coalesce(abs(({x} - {m}) / (CASE WHEN {s} > 0 THEN {s} END)) > 2.5E0, false)")
    return f"""coalesce(nullif(concat_ws(', ',
      CASE WHEN {zf.format(x='processing_time_ms', m='mp', s='sp')} THEN 'Slow processing' END,
      CASE WHEN {zf.format(x='amount', m='ma', s='sa')} THEN 'Unusual amount' END,
      CASE WHEN retry_count >= 3 THEN 'High retries' END,
      CASE WHEN risk_score > 75 THEN 'High risk score' END,
      CASE WHEN status = 'Failed' THEN 'Failed txn' END), ''), 'Multivariate pattern')"""


_ZSTATS = """avg(processing_time_ms) AS mp, stddev_samp(processing_time_ms) AS sp,
             avg(amount) AS ma, stddev_samp(amount) AS sa"""


def _zscore_ranked() -> str:
    """CTE ``ranked``: every transaction with the stand-in score, flag, reason and priority."""
    return f"""
, mo AS (
  SELECT CAST(COUNT(processing_time_ms) AS HUGEINT) AS n, CAST(SUM(processing_time_ms) AS HUGEINT) AS s1,
         SUM(CAST(processing_time_ms AS HUGEINT) * processing_time_ms) AS s2 FROM transactions),
zr AS (SELECT t.*, mo.n * t.processing_time_ms - mo.s1 AS num, mo.n * mo.s2 - mo.s1 * mo.s1 AS v
       FROM transactions t, mo),
z AS (SELECT *, CASE WHEN v > 0 THEN abs(CAST(num AS DOUBLE) / sqrt(CAST(v AS DOUBLE))) END AS anomaly_score,
             coalesce(v > 0 AND num * num > 9 * v, false) AS is_anomaly FROM zr),
{_explained('z')}"""


def _explained(scored: str) -> str:
    """CTE ``ranked``: the rows of a scored CTE with reason and priority."""
    return f"""
st AS (SELECT {_ZSTATS}, min(anomaly_score) AS smin, max(anomaly_score) AS smax,
              min(amount) AS amin, max(amount) AS amax FROM {scored}),
ranked AS (
  SELECT {scored}.*, {_reason_sql()} AS anomaly_reason,
         {round_half_even('(0.55E0 * ((anomaly_score - smin) / (smax - smin + 1e-9)) + 0.3E0 * ((amount - amin) / (amax - amin + 1e-9)) + 0.15E0 * is_fraud_flag) * 100.0E0', 2)} AS priority_score
  FROM {scored}, st)"""


# Other sensitivities and list lengths than the defaults.
ANOMALY_SETTINGS = {"top_anomalies_strict": (0.005, 10), "top_anomalies_wide": (0.05, 50)}

# A thirtieth of the tickets: fewer links than candidates, so that a sample is drawn.
LINK_SAMPLE_DIVISOR = 30


def anomaly_sql() -> dict[str, str]:
    q = {}
    q["zscore_flags"] = with_conform(f"""
, st AS (SELECT {_ZSTATS} FROM transactions)
SELECT transaction_id,
       coalesce(abs((processing_time_ms - mp) / (CASE WHEN sp > 0 THEN sp END)) > 3.0E0, false) AS pt_outlier,
       coalesce(abs((amount - ma) / (CASE WHEN sa > 0 THEN sa END)) > 3.0E0, false) AS amount_outlier
FROM transactions, st""")
    q["anomaly_reasons"] = with_conform(f"""
, st AS (SELECT {_ZSTATS} FROM transactions)
SELECT transaction_id, {_reason_sql()} AS anomaly_reason FROM transactions, st""")
    q["amount_minmax"] = with_conform("""
, st AS (SELECT min(amount) AS lo, max(amount) AS hi FROM transactions)
SELECT transaction_id, (amount - lo) / (hi - lo + 1e-9) AS norm_amount FROM transactions, st""")
    q["amount_distribution"] = with_conform("""
, g AS (SELECT gateway, list_sort(list(amount)) AS v FROM transactions
        WHERE gateway IS NOT NULL AND amount IS NOT NULL GROUP BY gateway),
w AS (SELECT gateway, v, unnest([1, 2, 3]) AS i FROM g),
p AS (SELECT gateway, i, v, 0.25E0 * i * (len(v) - 1) AS pos FROM w),
n AS (SELECT gateway, i, v[CAST(floor(pos) AS BIGINT) + 1] AS a, v[least(CAST(floor(pos) AS BIGINT) + 2, len(v))] AS b,
             pos - floor(pos) AS t FROM p),
x AS (SELECT gateway, i, CASE WHEN t >= 0.5E0 THEN b - (b - a) * (1.0E0 - t) ELSE a + (b - a) * t END AS x FROM n)
SELECT g.gateway, v[1] AS "min", max(x) FILTER (WHERE i = 1) AS q1, max(x) FILTER (WHERE i = 2) AS median,
       max(x) FILTER (WHERE i = 3) AS q3, v[len(v)] AS "max"
FROM g JOIN x ON g.gateway = x.gateway GROUP BY g.gateway, v ORDER BY g.gateway""")
    q["zscore_priority_anomalies"] = with_conform(_zscore_ranked() + """
SELECT transaction_id, "timestamp", gateway, channel, amount, status, processing_time_ms, retry_count,
       risk_score, anomaly_reason, priority_score
FROM ranked WHERE is_anomaly
ORDER BY priority_score DESC, transaction_id LIMIT 25""")
    nine = "round(anomaly_score * 1.0E9) / 1.0E9 AS anomaly_score"
    forest = lambda rows, share: forest_ctes(rows, sample_hash, share)
    listed = f"SELECT {', '.join(K.ANOMALY_COLUMNS)} FROM ranked WHERE is_anomaly ORDER BY priority_score DESC, transaction_id"
    q["isolation_forest_scores"] = with_conform(
        forest("transactions", K.DEFAULT_CONTAMINATION) + f"SELECT transaction_id, {nine}, is_anomaly FROM scored")
    whole = forest("transactions", K.DEFAULT_CONTAMINATION) + "," + _explained("scored")
    q["transaction_anomalies"] = with_conform(
        whole + f"SELECT transaction_id, {nine}, is_anomaly, anomaly_reason, priority_score FROM ranked")
    q["top_priority_anomalies"] = with_conform(whole + f"{listed} LIMIT {K.DEFAULT_TOP_N}")
    view = filtered_views()
    q["sampled_anomaly_view"] = with_conform(
        view + forest("ftxn", K.DEFAULT_CONTAMINATION) + "," + _explained("scored") + f"{listed} LIMIT {K.DASHBOARD_TOP_N}")
    for name, (share, top) in ANOMALY_SETTINGS.items():
        q[name] = with_conform(forest("transactions", share) + "," + _explained("scored") + f"{listed} LIMIT {top}")
    q["zscore_transaction_anomalies"] = with_conform(_zscore_ranked() + """
SELECT transaction_id, anomaly_score, is_anomaly, anomaly_reason, priority_score FROM ranked""")
    return q


def enrich_sql() -> dict[str, str]:
    q = {}
    q["enrich_sla"] = with_conform(f"""
SELECT ticket_id,
       CAST({_sla_case("priority", default_low=False)} AS INTEGER) AS sla_target_hours,
       CAST(CASE WHEN resolution_time_hours > {_sla_case("priority", default_low=False)} THEN 1 ELSE 0 END AS INTEGER)
         AS sla_breached
FROM support_tickets""")
    q["enrich_resolution_time"] = f"""
WITH b AS (
  SELECT 'TCK' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-'
           || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) AS ticket_id,
         CASE WHEN l.l_partkey % 100 < 35 THEN 'Tier1-Support' WHEN l.l_partkey % 100 < 55 THEN 'Tier2-Technical'
              WHEN l.l_partkey % 100 < 70 THEN 'Fraud-Risk' WHEN l.l_partkey % 100 < 90 THEN 'Billing-Ops'
              ELSE 'Premium-Care' END AS agent_team,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 12 WHEN '3-MEDIUM' THEN 24 ELSE 48 END AS target,
         l.l_quantity * 0.25E0 AS base_hours
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT ticket_id, agent_team,
       {round_half_even("base_hours + " + _penalty_case("agent_team") + " + CAST(target AS DOUBLE) * 0.15E0", 2)}
         AS resolution_time_hours
FROM b"""
    q["enrich_resolved_at"] = with_conform("""
SELECT ticket_id,
       CASE WHEN status IN ('Resolved', 'Closed', 'Reopened')
            THEN created_at + to_seconds(CAST(round(resolution_time_hours * 3600.0E0) AS BIGINT)) END AS resolved_at
FROM support_tickets""")
    q["enrich_risk_score"] = f"""
WITH b AS (
  SELECT 'TXN' || CAST(100000 + e.event_id AS VARCHAR) AS transaction_id,
         o.o_totalprice / 6250.0E0 AS base_risk, o.o_totalprice * e.value / 1000.0E0 AS amount,
         1 + (o.o_custkey * 37) % 3650 AS age
  FROM events e JOIN orders o ON o.o_orderkey = e.event_id)
SELECT transaction_id,
       {round_half_even("least(100.0E0, greatest(0.0E0, base_risk + CASE WHEN amount > 100000.0E0 THEN 12.0E0 ELSE 0.0E0 END + CASE WHEN age < 30 THEN 15.0E0 ELSE 0.0E0 END))", 1)}
         AS risk_score
FROM b"""
    q["failure_expectation"] = with_conform(f"""
, g AS (
  SELECT gateway, hour("timestamp") BETWEEN {K.NIGHT_HOURS[0]} AND {K.NIGHT_HOURS[1]} AS night, COUNT(*) AS txns,
         CAST(SUM(CASE WHEN gateway = 'GatewayC' THEN {round(K.GATEWAY_C_FAILURE_PROB * 10000)}
                       ELSE {round(K.BASE_FAILURE_PROB * 10000)} END
                  + CASE WHEN hour("timestamp") BETWEEN {K.NIGHT_HOURS[0]} AND {K.NIGHT_HOURS[1]}
                         THEN {round(K.NIGHT_FAILURE_BOOST * 10000)} ELSE 0 END) AS BIGINT) AS bp,
         CAST(SUM(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed
  FROM transactions WHERE "timestamp" IS NOT NULL GROUP BY ALL)
SELECT gateway, night, txns, {ratio_half_up('bp', 'txns * 100', 100)} AS expected_rate_pct,
       {rate_pct('failed', 'txns')} AS observed_rate_pct
FROM g ORDER BY gateway, night""")
    for name, divisor in (("link_candidates", 1), ("link_candidates_sampled", LINK_SAMPLE_DIVISOR)):
        q[name] = with_conform(f"""
SELECT transaction_id, "timestamp", customer_id, status FROM transactions
WHERE status IN ('Failed', 'Reversed')
ORDER BY {sample_hash('transaction_id', K.DASHBOARD_SAMPLE_SEED)}, transaction_id
LIMIT (SELECT CAST(floor((COUNT(*) // {divisor}) * {K.LINKED_TICKET_SHARE}E0) AS BIGINT) FROM support_tickets)""")
    q["ticket_links"] = with_conform("""
SELECT ticket_id, related_transaction_id, 'linked' AS link_kind FROM support_tickets
WHERE related_transaction_id <> ''
UNION ALL
SELECT ticket_id, related_transaction_id, 'unlinked' FROM support_tickets
WHERE related_transaction_id = '' OR related_transaction_id IS NULL""")
    return q


def source_sql() -> dict[str, str]:
    q = {}
    q["load_audit"] = with_conform("""
SELECT 'transactions' AS "table", COUNT(*) AS "rows" FROM transactions
UNION ALL SELECT 'support_tickets', COUNT(*) FROM support_tickets""")
    q["preview_transactions"] = with_conform("""
SELECT * FROM transactions ORDER BY "timestamp", transaction_id LIMIT 1000""")
    q["preview_tickets"] = with_conform("""
SELECT * FROM support_tickets ORDER BY created_at, ticket_id LIMIT 1000""")
    return q
