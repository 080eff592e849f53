"""Independent SQL statements of the same model, used as oracles.

`with_ctes` puts before a statement the common table expressions it names.
"""

from __future__ import annotations

import re

from fintrail.functions import constants as K


def r(expr: str, n: int = 4) -> str:
    return f"(round(({expr}) + 1e-9, {n}) + 0)"


def in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case_map(col: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {col} {whens} ELSE {default} END"


def clip(e: str, lo, hi) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE greatest({lo}, least(({e}), {hi})) END)"


def nth(expr: str, values) -> str:
    return f"list_extract([{in_list(values)}], CAST({expr} AS INTEGER) + 1)"


REF = "TIMESTAMP '2024-01-31 00:00:00'"
US_DAY = "86400000000.0"
LAM = "(ln(2) / 30.0)"

CTES: dict[str, str] = {}

CTES["ev"] = f"""
SELECT event_id, user_id, ts, k,
  CASE WHEN event_type = 'signup' THEN round(4 * value, 2) ELSE round(-value, 2) END AS amount,
  'M' || (k % 20) AS merchant_name,
  CASE WHEN k % 3 = 0 THEN 'UPI' ELSE 'BANK_TRANSFER' END AS channel,
  {nth('k % 6', K.PROVENANCE[:6])} AS source_provenance,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN k % 2 = 0 THEN 'P2M' ELSE 'P2P' END AS txn_kind,
  CASE event_type WHEN 'signup' THEN 'INCOME' WHEN 'click' THEN 'EXPENSE_ESSENTIAL'
    WHEN 'purchase' THEN 'EXPENSE_DISCRETIONARY' WHEN 'view' THEN 'EMI_PAYMENT'
    WHEN 'error' THEN 'SUBSCRIPTION' END AS transaction_type,
  {nth('k % 16', K.CATEGORIES)} AS merchant_category
FROM (SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k FROM events)"""

CTES["profiles"] = """
SELECT c_custkey AS user_id, 'upi' || c_custkey AS upi_id, 'G' || c_custkey AS gstin,
  'vpa' || c_custkey AS vpa, 'N' || c_nationkey AS node,
  c_nationkey % 4 + 1 AS city_tier,
  CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END AS income_band,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '18-25' WHEN 'BUILDING' THEN '26-35'
    WHEN 'FURNITURE' THEN '36-45' WHEN 'HOUSEHOLD' THEN '46-55' ELSE '56+' END AS age_group,
  c_custkey % 36 AS months_active
FROM customer"""

CTES["invoices"] = """
SELECT o_custkey AS user_id, o_orderkey AS invoice_id, o_orderdate AS ts, o_totalprice AS taxable_value,
  CASE o_orderstatus WHEN 'F' THEN 'ontime' WHEN 'O' THEN 'delayed' ELSE 'missing' END AS filing_status,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 45 END AS filing_delay_days
FROM orders"""

CTES["eway"] = """
SELECT o_custkey AS user_id, l_shipdate AS ts, round(l_extendedprice * (1 - l_discount) + 1e-7, 2) AS tot_inv_value,
  'H' || (l_partkey % 12) AS main_hsn_code, l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTES["raw_edges"] = """
SELECT 'N' || c_nationkey AS src, 'N' || s_nationkey AS dst,
  round(l_extendedprice * (1 - l_discount) + 1e-7, 2) AS amount, l_shipdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey"""

CTES["edges"] = "SELECT * FROM raw_edges WHERE src <> dst"


def _scalar_sql(src: str) -> str:
    """Scalar features over one grouped row set `g` of (key, ref) with its events `e`."""
    def s(t, w):
        return f"round(abs(coalesce(sum(e.amount) FILTER (e.transaction_type = '{t}' AND e.ts >= g.ref - INTERVAL {w} DAY), 0.0)), 2)"
    names = {"income": "INCOME", "essential": "EXPENSE_ESSENTIAL", "disc": "EXPENSE_DISCRETIONARY",
             "emi": "EMI_PAYMENT", "subs": "SUBSCRIPTION"}
    cols = ",\n ".join(f"{s(t, w)} AS {n}_{w}" for n, t in names.items() for w in (7, 30, 90))
    age = f"greatest(0.0, (epoch_us(g.ref) - epoch_us(e.ts)) / {US_DAY})"
    return f"""
SELECT e.user_id, g.ref, {cols},
 count(*) AS n_90, count(*) FILTER (e.ts >= g.ref - INTERVAL 7 DAY) AS n_7,
 count(*) FILTER (e.ts >= g.ref - INTERVAL 30 DAY) AS n_30,
 coalesce(sum(abs(e.amount) * exp(-{LAM} * {age})) FILTER (e.ts >= g.ref - INTERVAL 30 DAY), 0.0) AS decayed,
 coalesce(sum(exp(-{LAM} * {age})) FILTER (e.ts >= g.ref - INTERVAL 30 DAY), 0.0) AS decayed_n,
 count(*) FILTER (e.amount < 0) AS n_out, count(*) FILTER (e.amount < 0 AND e.status = 'FAILED') AS n_out_failed,
 count(*) FILTER (e.status = 'FAILED') AS n_failed,
 round(coalesce(sum(abs(e.amount)) FILTER (e.merchant_category = 'CASH_ATM'), 0.0), 2) AS cash,
 round(coalesce(sum(-e.amount) FILTER (e.amount < 0), 0.0), 2) AS outflow,
 count(*) FILTER (e.transaction_type = 'INCOME') AS n_income,
 avg(e.amount) FILTER (e.transaction_type = 'INCOME') AS inc_avg,
 stddev_samp(e.amount) FILTER (e.transaction_type = 'INCOME') AS inc_std,
 count(*) FILTER (e.transaction_type = 'SUBSCRIPTION' AND e.ts >= g.ref - INTERVAL 30 DAY) AS n_subs,
 count(*) FILTER (e.transaction_type = 'EMI_PAYMENT') AS n_emi
FROM {src} GROUP BY e.user_id, g.ref"""


def _derived_sql(base: str, daily: str, dips: str, life: str, spike: str | None) -> str:
    burden = "(b.emi_30 + b.subs_30) / CASE WHEN b.income_30 > 0 THEN b.income_30 ELSE greatest(b.income_90 / 3, 1.0) END"
    out30 = "(b.essential_30 + b.disc_30 + b.emi_30 + b.subs_30)"
    sav = "(b.income_30 - b.essential_30 - b.disc_30)"
    spend90 = "(b.essential_90 + b.disc_90 + b.emi_90)"
    stab = ("CASE WHEN b.n_income = 0 THEN 0.3 WHEN b.n_income = 1 THEN 0.8 "
            "ELSE greatest(0.0, least(1.0, 1 - CASE WHEN b.inc_avg = 0 THEN 0 ELSE b.inc_std / abs(b.inc_avg) END)) END")
    money = ",\n ".join(f"{r(f'b.{a}_{w}', 2)} AS {n}_{w}d" for a, n in
                        (("income", "income"), ("essential", "essential"), ("disc", "discretionary"))
                        for w in (7, 30, 90))
    spike_col = "coalesce(s.spike, FALSE) AS salary_day_spike_flag," if spike else ""
    spike_join = f"LEFT JOIN {spike} s ON s.user_id = b.user_id AND s.ref = b.ref" if spike else ""
    return f"""
SELECT b.user_id, b.ref, b.n_90 AS event_count_90d,
 {r('b.decayed / 30')} AS daily_avg_throughput_30d, {r('b.decayed_n')} AS decayed_count_30d,
 {r(f'CASE WHEN {out30} > 0 THEN least(b.income_30 / ({out30} / 30), 90.0) ELSE 90.0 END')} AS cash_buffer_days,
 {r('CASE WHEN b.n_out > 0 THEN b.n_out_failed / b.n_out ELSE 0.0 END')} AS debit_failure_rate_90d,
 {r('coalesce(p.dip, 0.0)')} AS end_of_month_liquidity_dip,
 {burden} AS raw_emi_burden, {r(f'greatest(0.0, least(5.0, {burden}))')} AS emi_burden_ratio,
 {r(f'CASE WHEN b.income_30 > 0 THEN greatest(-1.0, least(1.0, {sav} / b.income_30)) ELSE 0.0 END')} AS savings_rate,
 {r(stab)} AS income_stability_score,
 {r('coalesce(v.cv, 0.0)')} AS spending_volatility_index,
 {r(f'CASE WHEN {spend90} > 0 THEN least(1.0, b.disc_90 / {spend90}) ELSE 0.0 END')} AS discretionary_ratio,
 {r('CASE WHEN b.outflow > 0 THEN least(1.0, b.cash / b.outflow) ELSE 0.0 END')} AS cash_dependency_index,
 b.n_subs AS subscription_count_30d, b.n_emi AS emi_payment_count_90d,
 {spike_col}
 {r('greatest(-1.0, least(5.0, CASE WHEN coalesce(l.prev, 0) = 0 THEN 0.0 ELSE (coalesce(l.cur, 0) - l.prev) / l.prev END))')} AS lifestyle_inflation_trend,
 b.n_failed > 2 AS anomaly_flag,
 {money},
 {r('b.emi_30', 2)} AS emi_30d, {r('b.emi_90', 2)} AS emi_90d, {r('b.subs_30', 2)} AS subscription_30d,
 {r('b.income_7 - b.essential_7 - b.disc_7', 2)} AS net_cashflow_7d,
 {r('b.income_30 - b.essential_30 - b.disc_30 - b.emi_30 - b.subs_30', 2)} AS net_cashflow_30d,
 {r('b.income_90 - b.essential_90 - b.disc_90 - b.emi_90', 2)} AS net_cashflow_90d,
 {r('((b.n_7 > 0)::INT + (b.n_30 > 0)::INT + (b.n_90 > 0)::INT) / 3.0')} AS data_completeness_score
FROM {base} b
LEFT JOIN {daily} v ON v.user_id = b.user_id AND v.ref = b.ref
LEFT JOIN {dips} p ON p.user_id = b.user_id AND p.ref = b.ref
LEFT JOIN {life} l ON l.user_id = b.user_id AND l.ref = b.ref
{spike_join}"""


def _parts(prefix: str, src: str, life_src: str) -> None:
    """CTEs <prefix>_base, _cv, _dip, _life over `src`, a FROM clause joining events e to refs g."""
    CTES[f"{prefix}_base"] = _scalar_sql(src)
    CTES[f"{prefix}_cv"] = f"""
SELECT user_id, ref, CASE WHEN count(*) < 2 OR avg(x) = 0 THEN 0.0 ELSE stddev_samp(x) / avg(x) END AS cv
FROM (SELECT e.user_id, g.ref, sum(-e.amount) AS x FROM {src}
  AND e.transaction_type IN ('EXPENSE_ESSENTIAL', 'EXPENSE_DISCRETIONARY', 'EMI_PAYMENT') AND e.amount < 0
  GROUP BY e.user_id, g.ref, CAST(e.ts AS DATE)) GROUP BY user_id, ref"""
    CTES[f"{prefix}_dip"] = f"""
SELECT user_id, ref, avg(late - early) AS dip
FROM (SELECT e.user_id, g.ref, sum(e.amount) FILTER (day(e.ts) >= 25) AS late,
  sum(e.amount) FILTER (day(e.ts) < 25) AS early FROM {src}
  GROUP BY e.user_id, g.ref, date_trunc('month', e.ts))
WHERE late IS NOT NULL AND early IS NOT NULL GROUP BY user_id, ref"""
    CTES[f"{prefix}_life"] = f"""
SELECT e.user_id, g.ref,
 round(sum(abs(e.amount)) FILTER (e.ts >= date_trunc('month', g.ref) - INTERVAL 1 MONTH AND e.ts < g.ref), 2) AS cur,
 round(sum(abs(e.amount)) FILTER (e.ts >= date_trunc('month', g.ref) - INTERVAL 2 MONTH
   AND e.ts < date_trunc('month', g.ref) - INTERVAL 1 MONTH), 2) AS prev
FROM {life_src} AND e.transaction_type = 'EXPENSE_DISCRETIONARY' GROUP BY e.user_id, g.ref"""


_one = f"ev e JOIN (SELECT {REF} AS ref) g ON e.ts >= g.ref - INTERVAL 90 DAY AND e.ts <= g.ref"
_parts("fx", _one, f"ev e JOIN (SELECT {REF} AS ref) g ON TRUE")
CTES["fx_spike"] = f"""
SELECT user_id, {REF} AS ref,
 coalesce(avg(amt) FILTER (near) > 1.25 * avg(amt) FILTER (NOT near) AND avg(amt) FILTER (NOT near) > 0, FALSE) AS spike
FROM (SELECT d.user_id, d.day, d.amt, EXISTS (
    SELECT 1 FROM ev i WHERE i.user_id = d.user_id AND i.transaction_type = 'INCOME'
      AND abs(date_diff('day', CAST(i.ts AS DATE), d.day)) <= 3) AS near
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(abs(amount), (ts, event_id)) AS amt
        FROM ev WHERE transaction_type = 'EXPENSE_DISCRETIONARY' GROUP BY 1, 2) d)
GROUP BY user_id"""
CTES["fx"] = _derived_sql("fx_base", "fx_cv", "fx_dip", "fx_life", "fx_spike")

CTES["fx_top3"] = f"""
SELECT user_id, sum(s * s) FILTER (rn <= 3) AS hhi FROM (
  SELECT user_id, t / sum(t) OVER (PARTITION BY user_id) AS s,
    row_number() OVER (PARTITION BY user_id ORDER BY t DESC, merchant_name) AS rn
  FROM (SELECT user_id, merchant_name, sum(-amount) AS t FROM ev WHERE amount < 0 GROUP BY 1, 2))
GROUP BY user_id"""
CTES["fx_cats"] = f"""
SELECT user_id, cur, merchant_category AS cat FROM (
  SELECT user_id, ts >= {REF} - INTERVAL 30 DAY AS cur, merchant_category,
    row_number() OVER (PARTITION BY user_id, ts >= {REF} - INTERVAL 30 DAY
      ORDER BY sum(abs(amount)) DESC, merchant_category) AS rn
  FROM ev WHERE ts >= {REF} - INTERVAL 60 DAY AND ts < {REF} AND transaction_type NOT IN ('INCOME', 'TRANSFER')
  GROUP BY user_id, ts >= {REF} - INTERVAL 30 DAY, merchant_category) WHERE rn <= 5"""
CTES["fx_shift"] = f"""
SELECT u.user_id, CASE WHEN bool_or(u.cur) AND bool_or(NOT u.cur) THEN
  (SELECT count(*) FROM (SELECT cat FROM fx_cats c WHERE c.user_id = u.user_id GROUP BY cat HAVING count(*) = 1))
  ELSE 0 END AS shift
FROM (SELECT DISTINCT user_id, ts >= {REF} - INTERVAL 30 DAY AS cur FROM ev
      WHERE ts >= {REF} - INTERVAL 60 DAY AND ts < {REF}) u GROUP BY u.user_id"""
CTES["fx_gst"] = f"""
SELECT user_id, sum(taxable_value * exp(-{LAM} * date_diff('day', ts, hi))) AS gst,
  avg((filing_status = 'ontime')::INT) AS compliance, count(DISTINCT date_trunc('month', ts)) AS months,
  greatest(0.0, 1 - least(avg(filing_delay_days) / 30.0, 1.0)) AS regularity
FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS hi FROM invoices) GROUP BY user_id"""
CTES["fx_ewb"] = f"""
SELECT v.user_id, v.ewb, h.entropy FROM
 (SELECT user_id, sum(tot_inv_value * exp(-{LAM} * date_diff('day', ts, hi))) AS ewb
  FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS hi FROM eway) GROUP BY user_id) v
JOIN (SELECT user_id, -sum(p * ln(p + 1e-9)) AS entropy FROM
  (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM eway
   GROUP BY user_id, main_hsn_code) GROUP BY user_id) h USING (user_id)"""
CTES["fx_in"] = f"""
SELECT user_id, avg((txn_kind = 'P2M')::INT) AS p2m,
  sum(amount * exp(-{LAM} * greatest(0.0, (epoch_us({REF}) - epoch_us(ts)) / {US_DAY}))) AS inbound
FROM ev WHERE amount > 0 AND ts >= {REF} - INTERVAL 30 DAY AND ts <= {REF} GROUP BY user_id"""
CTES["fv0"] = f"""
SELECT fx.* EXCLUDE (ref), fx.ref, {r('coalesce(t.hhi, 0.0)')} AS top3_merchant_concentration,
  CAST(coalesce(s.shift, 0) AS INTEGER) AS merchant_category_shift_count,
  {r('coalesce(g.gst, 0.0)', 2)} AS gst_30d_value, {r('coalesce(g.compliance, 0.0)')} AS gst_filing_compliance_rate,
  CAST(coalesce(g.months, 0) AS INTEGER) AS months_active_gst,
  {r('coalesce(g.regularity, 0.0)')} AS statutory_payment_regularity_score,
  {r('coalesce(w.ewb, 0.0)', 2)} AS ewb_30d_value, {r('coalesce(w.entropy, 0.0)')} AS hsn_entropy_90d,
  {r('coalesce(i.p2m, 0.0)')} AS upi_p2m_ratio_30d,
  CASE WHEN {r('g.gst', 2)} > 0 AND i.inbound IS NOT NULL
    THEN {r('(' + r('g.gst', 2) + ' - i.inbound) / ' + r('g.gst', 2))} ELSE 0.0 END AS gst_upi_receivables_gap,
  0.0::DOUBLE AS temporal_anomaly_flag, p.gstin, p.city_tier, p.income_band, p.age_group, p.months_active
FROM fx LEFT JOIN fx_top3 t USING (user_id) LEFT JOIN fx_shift s USING (user_id)
LEFT JOIN fx_gst g USING (user_id) LEFT JOIN fx_ewb w USING (user_id) LEFT JOIN fx_in i USING (user_id)
LEFT JOIN profiles p USING (user_id)"""
_coh = {"emi_burden_ratio": "emi_burden", "savings_rate": "savings_rate",
        "spending_volatility_index": "spending_volatility", "cash_buffer_days": "cash_buffer",
        "income_stability_score": "income_stability"}
CTES["cohorts"] = ("SELECT income_band, city_tier, age_group, count(*) AS n_users, "
                   + ", ".join(f"{r(f'avg({c})')} AS mean_{n}, "
                               f"{r(f'greatest(coalesce(stddev_samp({c}), 1.0), 1e-6)')} AS std_{n}"
                               for c, n in _coh.items())
                   + ", income_band || '_' || city_tier || '_' || age_group AS cohort_key"
                   + " FROM fv0 GROUP BY 1, 2, 3")
CTES["fv"] = f"""
SELECT fv0.*, CASE WHEN c.std_emi_burden > 0
  THEN {r('(fv0.raw_emi_burden - c.mean_emi_burden) / c.std_emi_burden')} ELSE 0.0 END AS peer_cohort_benchmark_deviation
FROM fv0 LEFT JOIN cohorts c USING (income_band, city_tier, age_group)"""

# ---- one vector per active user-day
CTES["dref"] = ("SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS ref FROM ev")
_day = "ev e JOIN dref g ON e.user_id = g.user_id AND e.ts >= g.ref - INTERVAL 90 DAY AND e.ts < g.ref"
_parts("dx", _day, "ev e JOIN dref g ON e.user_id = g.user_id")
CTES["dx"] = _derived_sql("dx_base", "dx_cv", "dx_dip", "dx_life", None)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _messages_sql() -> str:
    from fintrail.plans.tables import MESSAGE_TEMPLATES
    return f"""
SELECT 'c' || conv_id || '-' || turn AS message_id, conv_id AS user_id, NULL::TIMESTAMP AS ts,
  NULL::VARCHAR AS sender_id, text FROM conversations WHERE role = 'user'
UNION ALL SELECT 'e' || event_id, user_id, ts, CASE WHEN k % 5 = 0 THEN 'TM-HDFCBK' ELSE '9876543210' END,
  list_extract([{quoted(MESSAGE_TEMPLATES)}], k % {len(MESSAGE_TEMPLATES)} + 1) FROM ev"""


def _merchant_sql() -> str:
    from fintrail.plans.tables import MERCHANT_TEXTS
    return f"""SELECT * REPLACE (list_extract([{quoted(MERCHANT_TEXTS)}], k % {len(MERCHANT_TEXTS)} + 1) AS merchant_name) FROM ev"""


CTES["messages"] = _messages_sql()
CTES["merchant_ev"] = _merchant_sql()


def first_match_sql(col: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({col}, {quoted(['(?i)' + p])}) THEN '{v}'" for p, v in rules)
    return f"CASE {whens} ELSE {default} END"

# ---- state snapshots

def risk_sql(p: str = "") -> str:
    raw = (f"0.25 * least({p}emi_burden_ratio, 2.0) / 2.0 + 0.20 * {p}debit_failure_rate_90d"
           f" + 0.15 * least({p}spending_volatility_index, 3.0) / 3.0"
           f" + 0.10 * least({p}end_of_month_liquidity_dip, 50000.0) / 50000.0"
           f" + 0.05 * {p}discretionary_ratio + 0.05 * {p}cash_dependency_index"
           f" - 0.15 * greatest({p}savings_rate, 0.0) - 0.05 * {p}income_stability_score")
    return r(f"1 / (1 + exp(-greatest(-6.0, least(6.0, ({raw}) * 6 - 3))))", 6)


def derive_sql(src: str, peer: str = "0.0::DOUBLE") -> str:
    return f"""
SELECT *, CASE WHEN cash_buffer_days < 5 THEN 'LOW' WHEN cash_buffer_days <= 15 THEN 'MEDIUM' ELSE 'HIGH' END AS liquidity_health,
 {r('greatest(0.0, least(1.0, 0.8 * greatest(0.0, least(1.0, cash_buffer_days / 30)) + 0.2 * (1 - greatest(0.0, least(1.0, debit_failure_rate_90d)))))', 6)} AS liquidity_health_index,
 {r('greatest(0.0, least(1.0, 0.6 * income_stability_score + 0.4 * (1 - least(spending_volatility_index, 1.0))))', 6)} AS income_stability,
 least(spending_volatility_index, 1.0) AS spending_volatility, {risk_sql()} AS risk_score,
 {r('greatest(0.0, least(1.0, 0.45 * least(emi_burden_ratio, 1.2) / 1.2 + 0.35 * greatest(0.0, least(1.0, cash_dependency_index)) + 0.20 * least(subscription_count_30d / 12.0, 1.0)))', 6)} AS credit_dependency_score,
 greatest(-3.0, least(3.0, {peer})) AS peer_deviation_score
FROM {src}"""


def persona_sql(top3: str) -> str:
    return f"""CASE WHEN {top3} > 0.80 AND debit_failure_rate_90d > 0.30 AND daily_avg_throughput_30d > 100000 THEN 'shell_circular'
 WHEN spending_volatility_index > 1.5 AND daily_avg_throughput_30d > 50000 AND income_stability_score < 0.4 THEN 'paper_trader'
 WHEN income_90d < 30000 AND emi_payment_count_90d = 0 AND daily_avg_throughput_30d < 2000 THEN 'new_to_credit'
 WHEN emi_burden_ratio > 0.55 AND savings_rate < 0.05 THEN 'genuine_struggling' END"""


CTES["dx_top3"] = """
SELECT user_id, ref, sum(s * s) FILTER (rn <= 3) AS top3 FROM (
  SELECT user_id, ref, t / sum(t) OVER (PARTITION BY user_id, ref) AS s,
    row_number() OVER (PARTITION BY user_id, ref ORDER BY t DESC, merchant_name) AS rn
  FROM (SELECT e.user_id, g.ref, e.merchant_name, sum(-e.amount) AS t
        FROM ev e JOIN dref g ON e.user_id = g.user_id AND e.ts >= g.ref - INTERVAL 90 DAY AND e.ts < g.ref
        WHERE e.amount < 0 GROUP BY ALL)) GROUP BY user_id, ref"""
CTES["dstate"] = derive_sql("dx")
CTES["twin"] = f"""
SELECT *, coalesce(last_value(candidate IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts), 'genuine_healthy') AS persona,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS version
FROM (SELECT s.*, s.ref AS ts, {persona_sql('coalesce(t.top3, 0)')} AS candidate
      FROM dstate s LEFT JOIN dx_top3 t USING (user_id, ref))"""
CTES["twin_latest"] = "SELECT * FROM (SELECT *, max(version) OVER (PARTITION BY user_id) AS mv FROM twin) WHERE version = mv"
CTES["fstate"] = derive_sql("fv", "peer_cohort_benchmark_deviation")


def _names(text: str, table: dict[str, str]) -> list[str]:
    return [n for n in table if re.search(rf"(FROM|JOIN|,)\s+{n}\b", text)]


def with_ctes(statement: str, **local: str) -> str:
    """Prefix a statement with every CTE it refers to, in dependency order.

    A recursive CTE is written with a leading /*RECURSIVE*/ mark.
    """
    table = {**CTES, **local}
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in _names(table[name], table):
            if other != name:
                visit(other)
        done.append(name)

    for name in _names(statement, table):
        visit(name)
    if not done:
        return statement
    recursive = any(table[n].startswith("/*RECURSIVE*/") for n in done)
    parts = [f"{n} AS {'' if table[n].startswith('/*RECURSIVE*/') else 'MATERIALIZED '}(\n{table[n].strip()})"
             for n in done]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + statement
