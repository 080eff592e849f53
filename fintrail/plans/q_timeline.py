"""Queries for series, calendars and business aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fintrail.functions import constants as K
from fintrail.operators import features as FT, timeline as TL
from fintrail.plans import tables as T
from fintrail.plans.registry import query
from fintrail.plans.sql import CTES, REF, US_DAY, first_match_sql, r

CTES["nseries0"] = """
SELECT node, day, CAST(trunc(round(coalesce(sum(v), 0), 2)) AS BIGINT) AS daily_volume, CAST(coalesce(sum(c), 0) AS BIGINT) AS daily_count,
  CAST(trunc(round(coalesce(sum(w), 0), 2)) AS BIGINT) AS daily_ewb_volume, CAST(coalesce(sum(e), 0) AS BIGINT) AS daily_ewb_count FROM (
  SELECT p.node, CAST(i.ts AS DATE) AS day, i.taxable_value AS v, 1 AS c, NULL AS w, NULL AS e FROM invoices i JOIN profiles p USING (user_id)
  UNION ALL SELECT p.node, CAST(i.ts AS DATE), NULL, NULL, abs(i.tot_inv_value), 1 FROM eway i JOIN profiles p USING (user_id))
GROUP BY node, day"""
CTES["nseries"] = """
SELECT c.node, CAST(c.day AS DATE) AS day, coalesce(daily_volume, 0) AS daily_volume, coalesce(daily_count, 0) AS daily_count,
  coalesce(daily_ewb_volume, 0) AS daily_ewb_volume, coalesce(daily_ewb_count, 0) AS daily_ewb_count
FROM (SELECT node, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM nseries0 GROUP BY node) c
LEFT JOIN nseries0 s ON s.node = c.node AND s.day = CAST(c.day AS DATE)"""

_AGE = f"floor(greatest(0, epoch_us({REF}) - epoch_us(ts)) / {US_DAY})"


def _summary_sql() -> str:
    parts, outer = [], []
    for w in (7, 30, 90):
        for n, t in TL_SUMMARY:
            v = "amount" if t == "INCOME" else "abs(amount)"
            parts.append(f"coalesce(sum({v}) FILTER (age <= {w} AND transaction_type = '{t}'), 0.0) AS {n}_{w}")
            outer.append(f"{r(f'{n}_{w}', 2)} AS {n}_{w}d")
        parts.append(f"count(*) FILTER (age <= {w}) AS event_count_{w}d")
        outer.append(f"event_count_{w}d")
        outer.append(r(f"total_income_{w} - total_essential_{w} - total_discretionary_{w} - emi_{w} - subscription_{w}", 2)
                     + f" AS net_cashflow_{w}d")
    maps = " ".join(f"""LEFT JOIN (SELECT user_id, string_agg(merchant_category || '=' || CAST(round(v * 100) AS BIGINT), ',' ORDER BY merchant_category) AS b{w}
      FROM (SELECT user_id, merchant_category, round(sum(abs(amount)), 2) AS v FROM aged WHERE age <= {w} GROUP BY 1, 2) GROUP BY user_id) USING (user_id)"""
                    for w in (7, 30, 90))
    return f"""SELECT b.user_id, {', '.join(outer)}, {', '.join(f"coalesce(b{w}, '') AS category_breakdown_{w}d" for w in (7, 30, 90))} FROM (
      SELECT user_id, {', '.join(parts)} FROM aged GROUP BY user_id) b {maps}"""


TL_SUMMARY = FT._SUMMARY


@query("a19_window_summary", _summary_sql(), aged=f"SELECT *, {_AGE} AS age FROM ev WHERE {_AGE} <= 90 AND ts <= {REF}")
def a19(spark, d):
    s = FT.window_summary(T.ev(spark, d), T.REF)
    flat = lambda n: F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(n)), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"] * 100, 0).cast("long"))), ","), F.lit(""))
    return s.withColumns({n: flat(n) for n in (f"category_breakdown_{w}d" for w in (7, 30, 90))})


@query("a20_invoice_value", f"SELECT user_id, {r('gst', 2)} AS gst_30d_value FROM fx_gst")
def a20(spark, d):
    return FT.invoice_features(T.invoices(spark, d)).select("user_id", "gst_30d_value")


@query("a21_filing_habits", f"""SELECT user_id, {r('compliance')} AS gst_filing_compliance_rate, CAST(months AS INTEGER) AS months_active_gst,
  {r('regularity')} AS statutory_payment_regularity_score FROM fx_gst""")
def a21(spark, d):
    return FT.invoice_features(T.invoices(spark, d)).drop("gst_30d_value")


@query("a22_consignments", f"SELECT user_id, {r('ewb', 2)} AS ewb_30d_value, {r('entropy')} AS hsn_entropy_90d FROM fx_ewb")
def a22(spark, d):
    return FT.eway_features(T.eway(spark, d))


@query("a23_inbound_share_and_gap", "SELECT user_id, upi_p2m_ratio_30d, gst_upi_receivables_gap FROM fv0")
def a23(spark, d):
    return T.feature_table(spark, d).select("user_id", "upi_p2m_ratio_30d", "gst_upi_receivables_gap")


_COH = [f"{m}_{n}" for n in FT.COHORT_FEATURES.values() for m in ("mean", "std")]


@query("a24_cohort_stats", f"SELECT income_band, city_tier, age_group, n_users, {', '.join(_COH)} FROM cohorts")
def a24(spark, d):
    return FT.cohort_stats(T.feature_table(spark, d)).select(*FT.COHORT, "n_users", *_COH)


def _band(c: str) -> str:
    return f"CASE WHEN {c} > 100000 THEN 'high' WHEN {c} > 30000 THEN 'mid' ELSE 'low' END"


@query("a25_income_band", f"SELECT user_id, {_band('income_90d')} AS income_band, {_band('gst_30d_value')} AS turnover_band FROM fv0")
def a25(spark, d):
    return T.feature_table(spark, d).select("user_id", FT.income_band(F.col("income_90d")).alias("income_band"),
                                            FT.income_band(F.col("gst_30d_value")).alias("turnover_band"))


_COLS = "daily_volume, daily_count, daily_ewb_volume, daily_ewb_count"


@query("a26_daily_series", f"SELECT node, day, {_COLS} FROM nseries0")
def a26(spark, d):
    inv, ew = T.region_flows(spark, d)
    return TL.daily_series(inv, ew, ["node"])


def _trailing_sql() -> str:
    cols = []
    for n in (30, 60, 90, 365):
        f = f"FILTER (rn <= {n})"
        cols.append(f"CAST(sum(daily_volume) {f} AS BIGINT) AS upi_volume_{n}, CAST(sum(daily_count) {f} AS BIGINT) AS upi_count_{n}, "
                    f"CAST(sum(daily_ewb_volume) {f} AS BIGINT) AS ewb_volume_{n}, CAST(sum(daily_ewb_count) {f} AS BIGINT) AS ewb_count_{n}, "
                    f"CAST(trunc(sum(daily_volume) {f} / greatest(1, count(*) {f})) AS BIGINT) AS avg_daily_upi_{n}")
    return f"""SELECT node, {', '.join(cols)} FROM (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY day DESC) AS rn FROM nseries) GROUP BY node"""


@query("a27_trailing_summaries", _trailing_sql())
def a27(spark, d):
    return TL.trailing_summaries(T.region_series(spark, d), ["node"])


@query("a28_data_maturity", """SELECT node, CAST(greatest(count(DISTINCT date_trunc('month', day)), 1) AS INTEGER) AS data_maturity_months
  FROM nseries WHERE daily_volume > 0 OR daily_ewb_volume > 0 GROUP BY node""")
def a28(spark, d):
    return TL.maturity(T.region_series(spark, d), ["node"])


_BUCKET = "CASE " + " ".join(f"WHEN tot_inv_value >= {lo} AND tot_inv_value < {hi} THEN '{n}'" for lo, hi, n in TL.BUCKETS) + " ELSE '70k+' END"


@query("a29_value_histogram", f"""SELECT bucket, n AS rows, bucket = '45k-49.9k' AS below_threshold, {r('n / sum(n) OVER ()')} AS share
  FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM eway GROUP BY 1)""")
def a29(spark, d):
    return TL.value_histogram(T.eway(spark, d))


@query("a30_receivables_by_month", f"""SELECT month, {r('coalesce(i, 0.0)', 2)} AS invoiced, {r('coalesce(r, 0.0)', 2)} AS received,
  {r('coalesce(i, 0.0) - coalesce(r, 0.0)', 2)} AS gap FROM
  (SELECT strftime(ts, '%Y-%m') AS month, sum(taxable_value) AS i FROM invoices GROUP BY 1)
  FULL JOIN (SELECT strftime(ts, '%Y-%m') AS month, sum(tot_inv_value) AS r FROM eway GROUP BY 1) USING (month)""")
def a30(spark, d):
    return TL.receivables_by_month(T.invoices(spark, d), T.eway(spark, d).withColumnRenamed("tot_inv_value", "amount"))


_MED = ["cash_buffer_days", "savings_rate", "gst_filing_compliance_rate"]


@query("a31_cohort_medians", "SELECT income_band, " + ", ".join(f"{r(f'quantile_cont({c}, 0.5)')} AS median_{c}" for c in _MED)
       + " FROM fv GROUP BY income_band")
def a31(spark, d):
    return TL.cohort_medians(T.feature_table(spark, d), ["income_band"], _MED)


@query("a32_income_posterior", f"""SELECT user_id, {r('mu')} AS mu, {r('sigma', 6)} AS sigma, {r('exp(mu + 0.5 * sigma * sigma)', 2)} AS mean_income FROM (
  SELECT user_id, (p0 * mu0 + 100 * logs) / (p0 + 100 * n) AS mu, sqrt(1 / (p0 + 100 * n)) AS sigma FROM (
    SELECT f.user_id, 1 / pow(greatest((1 - income_stability_score) * 0.5 + 0.05, 0.05), 2) AS p0, ln(greatest(income_30d, 1.0)) AS mu0,
      coalesce(s.n, 0) AS n, coalesce(s.logs, 0) AS logs
    FROM fx f LEFT JOIN (SELECT user_id, count(*) AS n, sum(ln(amount)) AS logs FROM ev
      WHERE transaction_type = 'INCOME' AND amount > 0 GROUP BY user_id) s USING (user_id)))""")
def a32(spark, d):
    prior = T.feature_table(spark, d).select("user_id", F.col("income_30d").alias("income_mean"),
                                             F.col("income_stability_score").alias("stability"))
    p = TL.income_posterior(T.event_table(spark, d).where("transaction_type = 'INCOME'"), prior)
    from fintrail.functions.numeric import rnd
    return p.select("user_id", rnd("mu", 4).alias("mu"), rnd("sigma", 6).alias("sigma"), rnd("mean_income", 2).alias("mean_income"))


FLOW_SQL = f"""SELECT node, {r('coalesce(o.total, 0.0)', 2)} AS total_outflow, {r('coalesce(i.total, 0.0)', 2)} AS total_inflow,
  coalesce(i.n, 0) AS inflow_sources, {r('coalesce(o.top / (o.total + 1e-9), 0.0)')} AS top_receiver_share FROM
  (SELECT src AS node, max(a) AS top, sum(a) AS total FROM (SELECT src, dst, sum(amount) AS a FROM edges GROUP BY 1, 2) GROUP BY 1) o
  FULL JOIN (SELECT dst AS node, count(DISTINCT src) AS n, sum(amount) AS total FROM edges GROUP BY 1) i USING (node)"""


@query("a33_flow_concentration", FLOW_SQL)
def a33(spark, d):
    return TL.flow_concentration(T.edges(spark, d))


_MIX = ", ".join(
    f"{r(f'''CASE WHEN ta > 0 THEN coalesce(sum(x) FILTER (merchant_category = '{c}' AND w30), 0.0) / ta ELSE 0.0 END''')} AS mix30_{c}, "
    f"{r(f'''CASE WHEN tb > 0 THEN coalesce(sum(x) FILTER (merchant_category = '{c}'), 0.0) / tb ELSE 0.0 END''')} AS mix90_{c}"
    for c in K.CATEGORIES)


@query("a34_spend_mix", f"""SELECT user_id, {_MIX} FROM (SELECT *, sum(x) FILTER (w30) OVER (PARTITION BY user_id) AS ta, sum(x) OVER (PARTITION BY user_id) AS tb
  FROM (SELECT user_id, merchant_category, -amount AS x, ts >= {REF} - INTERVAL 30 DAY AS w30 FROM ev
        WHERE amount < 0 AND ts >= {REF} - INTERVAL 90 DAY AND ts <= {REF})) GROUP BY user_id, ta, tb""")
def a34(spark, d):
    from fintrail.functions.numeric import rnd
    m = FT.spend_mix(T.ev(spark, d), T.REF, K.CATEGORIES)
    return m.select("user_id", *[rnd(c, 4).alias(c) for c in m.columns if c != "user_id"])


@query("a35_flow_totals", f"""SELECT user_id, {r('coalesce(sum(amount) FILTER (amount > 0), 0.0)', 2)} AS inbound_30d,
  {r('coalesce(sum(-amount) FILTER (amount <= 0), 0.0)', 2)} AS outbound_30d, count(*) AS transactions_30d
  FROM ev WHERE ts >= {REF} - INTERVAL 30 DAY AND ts <= {REF} GROUP BY user_id""")
def a35(spark, d):
    return TL.flow_totals(T.ev(spark, d), T.REF)


@query("a35_top_categories", f"""SELECT user_id, category, CAST(rank AS INTEGER) AS rank, {r('spend / total * 100', 1)} AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spend DESC, category) AS rank,
    round(sum(spend) OVER (PARTITION BY user_id), 2) AS total FROM (
    SELECT user_id, merchant_category AS category, {r('sum(-amount)', 2)} AS spend FROM ev
    WHERE ts >= {REF} - INTERVAL 30 DAY AND ts <= {REF} AND amount <= 0 GROUP BY 1, 2)) WHERE rank <= 5 AND total > 0""")
def a35_top(spark, d):
    return TL.top_categories(T.ev(spark, d), T.REF)


_AT = "TIMESTAMP '2001-08-02 00:00:00'"


@query("a36_income_trend", f"""SELECT user_id, CAST(n AS INTEGER) AS months, CASE WHEN n >= 4 AND (r - l) / greatest(l, 1.0) > 0.06 THEN 'rising'
  WHEN n >= 4 AND (r - l) / greatest(l, 1.0) < -0.06 THEN 'declining' ELSE 'stable' END AS income_trend FROM (
  SELECT user_id, n, avg(v) FILTER (i < n // 2) AS l, avg(v) FILTER (i >= n // 2) AS r FROM (
    SELECT user_id, v, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY month) - 1 AS i FROM (
      SELECT user_id, month, v, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS back FROM (
        SELECT dst AS user_id, date_trunc('month', ts) AS month, round(sum(amount), 2) AS v FROM edges
        WHERE ts >= {_AT} - INTERVAL 180 DAY AND ts <= {_AT} GROUP BY 1, 2)) WHERE back <= 6) GROUP BY user_id, n)""")
def a36(spark, d):
    return TL.income_trend(T.edges(spark, d).withColumnRenamed("dst", "user_id"), datetime(2001, 8, 2))


@query("a37_source_lag", f"""SELECT source_provenance, count(*) AS raw, count(*) FILTER (typed) AS typed, count(*) - count(*) FILTER (typed) AS lag
  FROM (SELECT source_provenance, {first_match_sql('merchant_name', K.MERCHANT_RULES, 'NULL')} IS NOT NULL AS typed FROM merchant_ev) GROUP BY 1""")
def a37(spark, d):
    """Rows no merchant rule could type are the backlog."""
    from fintrail.operators.classify import merchant_category
    e = T.merchant_texts(spark, d)
    return TL.unclassified_lag(e, e.where(merchant_category(F.col("merchant_name")).isNotNull()))


@query("w17_winsorised_trend", f"""SELECT node, day, daily_volume AS raw_value,
  {r('avg(v) OVER (PARTITION BY node ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS trend_value FROM (
  SELECT s.node, s.day, s.daily_volume, least(CAST(s.daily_volume AS DOUBLE), greatest(1.0, coalesce(c.cut, 1.0))) AS v FROM nseries s
  LEFT JOIN (SELECT node, daily_volume AS cut FROM (SELECT node, daily_volume, row_number() OVER (PARTITION BY node ORDER BY daily_volume) AS rn,
    count(*) OVER (PARTITION BY node) AS n FROM nseries WHERE daily_volume > 0) WHERE rn - 1 = floor((n - 1) * 0.9::DOUBLE)) c USING (node))""")
def w17(spark, d):
    return TL.winsorised_trend(T.region_series(spark, d), ["node"])


@query("t9_downsample", f"""SELECT node, day, {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY day) - 1 AS i,
  count(*) OVER (PARTITION BY node) AS n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY day DESC) AS b FROM nseries) WHERE b <= 365)
  WHERE i % greatest(1, CAST(ceil(n / 60.0) AS BIGINT)) = 0""")
def t9(spark, d):
    return TL.downsample(T.region_series(spark, d), ["node"], 60, last=365).select("node", "day", *TL.MEASURES)
