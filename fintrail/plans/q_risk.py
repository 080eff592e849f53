"""Queries for scoring, credit, intervention and audit operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import ntz, rnd
from fintrail.functions.rules import lookup
from fintrail.operators import canonical as C, features as FT, joins as J, ordered as O, risk as R, twin as TW
from fintrail.plans import tables as T
from fintrail.plans.registry import query
from fintrail.plans.sql import CTES, _derived_sql, _parts, derive_sql, in_list, r
from fintrail.session import scratch

c = F.col


def clamp(e: str, lo, hi) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {e}))"


def state(spark, d):
    """Feature vectors with their state columns."""
    return TW.derive(T.feature_table(spark, d))


def snaps(spark, d):
    """Snapshots with the earlier volatility that triggers compare with."""
    return TW.previous_volatility(T.twin(spark, d))


CTES["declared"] = "SELECT f.*, abs(cu.c_acctbal) * 10 AS declared_income, coalesce(p.frac, 0.0) AS p2p_income_fraction " \
    "FROM fv f JOIN customer cu ON cu.c_custkey = f.user_id LEFT JOIN (SELECT user_id, avg((txn_kind = 'P2P')::INT) AS frac " \
    "FROM ev WHERE transaction_type = 'INCOME' GROUP BY user_id) p USING (user_id)"


def declared(spark, d):
    bal = T.table(spark, d, "customer").select(c("c_custkey").alias("user_id"), (F.abs("c_acctbal") * 10).alias("declared_income"))
    p2p = T.ev(spark, d).where("transaction_type = 'INCOME'").groupBy("user_id").agg(
        F.avg((c("txn_kind") == "P2P").cast("int")).alias("p2p_income_fraction"))
    return (T.feature_table(spark, d).join(bal, "user_id").join(p2p, "user_id", "left")
            .fillna(0.0, subset=["p2p_income_fraction"]))


@query("r8_situation", """SELECT user_id, CASE WHEN emi_burden_ratio > 0.55 OR debit_failure_rate_90d > 0.15 OR cash_buffer_days < 5 THEN 'STRESSED_CRITICAL'
  WHEN emi_burden_ratio > 0.40 OR savings_rate < 0.05 THEN 'STRESSED_RECOVERABLE'
  WHEN savings_rate > 0.15 AND emi_burden_ratio < 0.30 AND cash_buffer_days > 20 THEN 'STABLE_IMPROVING' ELSE 'STABLE_FLAT' END AS situation,
  concat_ws(',', CASE WHEN emi_burden_ratio > 0.55 THEN 'EMI_OVERLOAD' END, CASE WHEN cash_buffer_days < 7 THEN 'LIQUIDITY_CRISIS' END) AS flags FROM fv""")
def r8(spark, d):
    return T.feature_table(spark, d).select("user_id", R.situation().alias("situation"), F.array_join(
        F.transform(R.concern_flags(), lambda x: x["flag_type"]), ",").alias("flags"))


CTES["contra0"] = """SELECT *, list_filter_pos AS m, len(list_filter_pos) AS n FROM (SELECT *, [x FOR x IN
  [income_7d, greatest(income_30d - income_7d, 0.0), greatest(income_90d - income_30d, 0.0)] IF x > 0] AS list_filter_pos FROM declared)"""
CTES["contra1"] = f"""SELECT *, CASE WHEN n > 0 THEN list_avg(m) ELSE 0.0 END AS mu,
  CASE WHEN n > 1 AND list_stddev_samp(m) > 0 THEN (declared_income - list_avg(m)) / (list_stddev_samp(m) / sqrt(n)) ELSE 0.0 END AS z,
  {r('CASE WHEN declared_income > 0 THEN discretionary_30d / declared_income ELSE 0.0 END')} AS lci FROM contra0"""
CTES["contra"] = """SELECT *, abs(z) > CASE WHEN income_stability_score < 0.5 THEN 2.5 ELSE 2.0 END AS l1, p2p_income_fraction > 0.40 AS l2,
  lci > 0.45 AND declared_income > 50000 AS over3, lci < 0.05 AND declared_income < 30000 AND cash_dependency_index > 0.25 AS under3 FROM contra1"""


@query("r9_income_contradiction", f"""SELECT user_id, {r('mu', 2)} AS observed_mean_income, {r('z')} AS z_score, l1 AS layer1_flag, l2 AS layer2_flag,
  lci AS layer3_lci, l3 AS layer3_flag, CAST(k AS INTEGER) AS layers_triggered,
  CASE WHEN l1 AND z > 0 THEN 'over_reported' WHEN l1 THEN 'under_reported' WHEN over3 THEN 'over_reported' WHEN under3 THEN 'under_reported' ELSE 'consistent' END AS direction,
  CASE WHEN k <= 1 THEN 'LOW' WHEN k = 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  {r('k / 3.0 * 0.7 + least(abs(z) / 3.0, 1.0) * 0.3')} AS confidence FROM (
  SELECT *, over3 OR under3 AS l3, l1::INT + l2::INT + (over3 OR under3)::INT AS k FROM contra)""")
def r9(spark, d):
    return R.income_contradiction(declared(spark, d))


@query("r10_follow_up", """SELECT user_id, reason, reason <> '' AS triggered FROM (SELECT user_id,
  CASE WHEN data_completeness_score < 0.7 THEN 'low_posterior_confidence' WHEN l1::INT + l2::INT + (over3 OR under3)::INT >= 2 THEN 'income_contradiction_multi_layer'
  WHEN debit_failure_rate_90d > 0.12 AND anomaly_flag THEN 'stress_anomaly_combined' WHEN merchant_category_shift_count > 3 THEN 'sudden_behavioral_shift'
  WHEN months_active < 6 THEN 'first_run_baseline' ELSE '' END AS reason FROM contra)""")
def r10(spark, d):
    f = declared(spark, d)
    x = R.income_contradiction(f).select("user_id", "layers_triggered")
    reason = R.follow_up_reason(c("data_completeness_score") < 0.7, c("layers_triggered"), c("months_active") < 6)
    return f.join(x, "user_id").select("user_id", reason.alias("reason")).withColumn("triggered", c("reason") != "")


def _label_sql() -> str:
    parts = [str(K.LABEL_BASE)]
    for col, op, bound, inc in K.LABEL_RULES:
        x = f"CAST({col} AS DOUBLE)"
        cond = {">": f"{x} > {bound}", "<": f"{x} < {bound}", "=": f"{x} = {bound}", "0<x<": f"{x} > 0 AND {x} < {bound}"}[op]
        parts.append(f"CASE WHEN {cond} THEN {inc}::DOUBLE ELSE 0.0 END")
    floor, inc = K.LABEL_SHORT_TERM
    parts.append(f"CASE WHEN income_7d < discretionary_7d AND discretionary_7d > {floor} THEN {inc}::DOUBLE ELSE 0.0 END")
    return r(clamp(" + ".join(parts), *K.LABEL_RANGE))


@query("r11_proxy_labels", f"SELECT user_id, {_label_sql()} AS risk_label_score, ({_label_sql()} > 0.5)::INT AS label FROM fv")
def r11(spark, d):
    return T.feature_table(spark, d).select("user_id", R.proxy_label().alias("risk_label_score")).withColumn(
        "label", (c("risk_label_score") > 0.5).cast("int"))


def _band_case(i: int, col: str = "risk_band") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {str(v[i]).upper()}" for k, v in K.CREDIT_BANDS.items()) + " END"


def _terms(src: str) -> str:
    band = "CASE " + " ".join(f"WHEN credit_score BETWEEN {v[0]} AND {v[1]} THEN '{k}'" for k, v in K.CREDIT_BANDS.items()) + " ELSE 'high_risk' END"
    return f"""SELECT *, {r(f'least(25000.0::DOUBLE / (greatest(probability_of_default, 0.0001) * 0.45), {_band_case(2)} * 100000.0::DOUBLE)', 2)} AS loan_amount,
      {_band_case(3)} AS tenure_months, {r(f'{_band_case(4)}::DOUBLE + ({_band_case(5)} - {_band_case(4)})::DOUBLE * least(probability_of_default, 1.0)', 2)} AS apr,
      {_band_case(6)} AS guarantee_eligible FROM (SELECT *, {band} AS risk_band FROM {src})"""


CTES["scored0"] = "SELECT *, risk_score AS probability_of_default, CAST(greatest(300, least(900, floor(900 - risk_score * 600))) AS INTEGER) AS credit_score FROM fstate"
CTES["scored"] = _terms("scored0")
TERMS = ["credit_score", "risk_band", "loan_amount", "tenure_months", "apr", "guarantee_eligible"]


def scored(df):
    s = df.withColumn("probability_of_default", c("risk_score")).withColumn("credit_score", TW.bureau_score(c("risk_score")))
    return R.loan_terms(s)


@query("r12_loan_terms", f"SELECT user_id, {', '.join(TERMS)} FROM scored")
def r12(spark, d):
    return scored(state(spark, d)).select("user_id", *TERMS)


_CHECKS = {"emi_burden_check": "emi_burden_ratio <= 0.5", "savings_rate_check": "savings_rate >= 0", "cash_buffer_check": "cash_buffer_days >= 15",
           "debit_failure_check": "debit_failure_rate_90d <= 0.1", "income_stability_check": "income_stability_score >= 0.5",
           "anomaly_check": "NOT anomaly_flag", "net_cashflow_check": "net_cashflow_30d >= 0"}
_GST = {"msme_gst_check": "gst_filing_compliance_rate >= 0.8", "msme_receivables_gap_check": "gst_upi_receivables_gap <= 0.4"}


@query("r13_rule_trace", "SELECT user_id, " + ", ".join(
    [f"CASE WHEN {v} THEN 'PASSED' ELSE 'FAILED' END AS {k}" for k, v in _CHECKS.items()]
    + [f"CASE WHEN {v} THEN 'PASSED' WHEN gstin IS NULL THEN 'N/A' ELSE 'FAILED' END AS {k}" for k, v in _GST.items()])
    + f", {r('emi_burden_ratio', 3)} AS emi_value FROM fv")
def r13(spark, d):
    t = T.feature_table(spark, d).select("user_id", R.rule_trace().alias("t"))
    return t.select("user_id", *[c(f"t.{n}.result").alias(n) for n in R.TRACE], c("t.emi_burden_check.value").alias("emi_value"))


CTES["delta"] = f"""SELECT user_id, version, CASE WHEN n >= 2 THEN {r('greatest(first_risk - risk_score, 0.0)')} ELSE 0.0 END AS trajectory_delta
  FROM (SELECT *, count(*) OVER w AS n, first_value(risk_score) OVER w AS first_risk FROM twin
    WINDOW w AS (PARTITION BY user_id ORDER BY version ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
CTES["boosted"] = f"""SELECT user_id, model, boost, CAST(CASE WHEN delta > 0 THEN greatest(300, least(900, s + boost)) ELSE s END AS INTEGER) AS credit_score,
    CASE WHEN delta > 0 THEN (900 - greatest(300, least(900, s + boost))) / 600.0::DOUBLE ELSE risk_score END AS probability_of_default FROM (
  SELECT f.user_id, CASE WHEN f.data_completeness_score < 0.7 THEN 'income_heavy' ELSE 'full' END AS model, f.risk_score, t.trajectory_delta AS delta,
    CAST(greatest(300, least(900, floor(900 - f.risk_score * 600))) AS INTEGER) AS s,
    CAST(CASE WHEN t.trajectory_delta > 0 THEN least(round_even(t.trajectory_delta * 50, 0), 75) ELSE 0 END AS INTEGER) AS boost
  FROM fstate f JOIN (SELECT d.user_id, d.trajectory_delta FROM delta d JOIN twin_latest l USING (user_id, version)) t USING (user_id))"""


@query("r14_routing_and_boost", f"SELECT user_id, model, boost, credit_score, {r('probability_of_default')} AS probability_of_default FROM boosted")
def r14(spark, d):
    t = T.twin(spark, d)
    last = TW.latest(TW.trajectory_delta(t)).select("user_id", "trajectory_delta")
    s = state(spark, d).join(last, "user_id").withColumn("model", R.route(c("data_completeness_score")))
    return R.boosted(s, "risk_score", "trajectory_delta").select(
        "user_id", "model", "boost", "credit_score", rnd("probability_of_default", 4).alias("probability_of_default"))


_SC = "round_even(900 - risk_score * 600, 0)"
_EMI = "CASE WHEN apr <= 0 THEN approved_amount / t ELSE approved_amount * (apr / 1200.0::DOUBLE) * pow(1 + apr / 1200.0::DOUBLE, t) / greatest(pow(1 + apr / 1200.0::DOUBLE, t) - 1, 1e-9) END"
CTES["offers"] = f"""SELECT user_id, version, display_score, risk_band, approved_amount, apr, t AS tenure_months, {r(_EMI, 2)} AS monthly_emi FROM (
  SELECT user_id, version, CAST({_SC} AS INTEGER) AS display_score,
    CASE WHEN risk_score <= 0.30 THEN 'low_risk' WHEN risk_score <= 0.60 THEN 'medium_risk' ELSE 'high_risk' END AS risk_band,
    round_even({r(f"greatest(15000.0, least(150000.0, 20000.0 + ({_SC} - 300) * 120.0)) * (0.85 + {clamp('(5.0 - cash_buffer_days) / 5.0', 0, 1)} * 0.2)", 6)} / 100.0::DOUBLE, 0) * 100.0::DOUBLE AS approved_amount,
    CAST(CASE WHEN {_SC} >= 760 THEN 13.0 WHEN {_SC} >= 680 THEN 16.0 WHEN {_SC} >= 600 THEN 19.5 ELSE 24.0 END AS DOUBLE) AS apr,
    unnest([3, 6, 9, 12]) AS t FROM twin_latest)"""
OFFER = ["user_id", "version", "display_score", "risk_band", "approved_amount", "apr", "tenure_months", "monthly_emi"]


@query("r15_offers", f"SELECT {', '.join(OFFER)} FROM offers")
def r15(spark, d):
    return R.offers(T.twin_latest(spark, d)).select(*OFFER)


_INC = f"greatest(20000.0::DOUBLE, {_SC} * 120.0::DOUBLE)"


@query("r16_restructure", f"""SELECT user_id, tenure_months, {r('nb')} AS projected_burden, {r('least(90.0::DOUBLE, cash_buffer_days + boost)', 2)} AS projected_buffer_days,
  {r(clamp(f"risk_score + {r('(nb - emi_burden_ratio) * 0.28 - boost / 100.0::DOUBLE')}", 0, 1))} AS projected_risk,
  CASE WHEN {r(clamp(f"risk_score + {r('(nb - emi_burden_ratio) * 0.28 - boost / 100.0::DOUBLE')}", 0, 1))} <= 0.30 THEN 'low_risk'
    WHEN {r(clamp(f"risk_score + {r('(nb - emi_burden_ratio) * 0.28 - boost / 100.0::DOUBLE')}", 0, 1))} <= 0.60 THEN 'medium_risk' ELSE 'high_risk' END AS projected_band FROM (
  SELECT *, greatest(0.0::DOUBLE, (emi_burden_ratio - nb) * 14.0) + CASE WHEN mor > 0 THEN least(10.0::DOUBLE, mor / 6.0::DOUBLE) ELSE 0.0 END AS boost FROM (
    SELECT t.*, o.tenure_months, {clamp(f'o.monthly_emi / {_INC}', 0, 2)} AS nb, CASE WHEN o.tenure_months >= 9 THEN 30 ELSE 0 END AS mor
    FROM twin_latest t JOIN offers o USING (user_id)))""")
def r16(spark, d):
    last = T.twin_latest(spark, d)
    props = R.offers(last).select("user_id", "tenure_months", c("monthly_emi").alias("proposed_monthly_emi"),
                                  F.when(c("tenure_months") >= 9, 30).otherwise(0).alias("moratorium_days"))
    return R.restructure(last, props)


CTES["pv"] = """SELECT *, CASE WHEN count(*) OVER w >= 2 THEN first_value(spending_volatility) OVER w END AS pvol FROM twin
  WINDOW w AS (PARTITION BY user_id ORDER BY version ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
_TRIG = [
    ("liquidity_drop", "liquidity_health = 'LOW' OR cash_buffer_days < 10", "CASE WHEN liquidity_health = 'LOW' THEN 0.9 ELSE 0.7 END"),
    ("prequalified_micro_loan_offer", "liquidity_health = 'LOW' AND cash_buffer_days < 7", "least(0.98::DOUBLE, 0.75 + (7.0 - cash_buffer_days) * 0.03)"),
    ("overspend_warning", "spending_volatility > 0.65", "least(0.9::DOUBLE, spending_volatility)"),
    ("emi_at_risk", "emi_burden_ratio > 0.35", "least(0.95::DOUBLE, emi_burden_ratio)"),
    ("lifestyle_inflation", "(spending_volatility - pvol) / greatest(pvol, 0.01::DOUBLE) > 0.25", "0.5"),
    ("savings_opportunity", "cash_buffer_days > 20 AND emi_burden_ratio < 0.25 AND risk_score < 0.35", "0.2"),
    ("fraud_anomaly", "persona = 'shell_circular'", "0.95"),
    ("new_to_credit_guidance", "persona = 'new_to_credit'", "0.1"),
]
CTES["alerts"] = " UNION ALL ".join(
    f"SELECT user_id, version, ts, persona, '{n}' AS trigger_type, '{K.TRIGGERS[n][0]}' AS priority, {r(f'CAST({u} AS DOUBLE)')} AS urgency, "
    f"[{in_list(K.TRIGGERS[n][1])}] AS channels FROM pv WHERE {w}" for n, w, u in _TRIG)


@query("r17_triggers", "SELECT user_id, version, trigger_type, priority, urgency FROM alerts")
def r17(spark, d):
    return R.triggers(snaps(spark, d)).select("user_id", "version", "trigger_type", "priority", "urgency")


# the measure that a trigger's reason names, rounded to the digits that it shows
_MEASURES = {"liquidity_drop": ("cash_buffer_days", 1), "prequalified_micro_loan_offer": ("cash_buffer_days", 1), "overspend_warning": ("spending_volatility", 2),
             "emi_at_risk": ("emi_burden_ratio * 100", 0), "lifestyle_inflation": ("(spending_volatility - pvol) / greatest(pvol, 0.01::DOUBLE) * 100", 0)}


def _reason_sql(n: str) -> str:
    if n not in _MEASURES:
        return f"'{K.TRIGGER_REASONS[n]}'"
    x, places = _MEASURES[n]
    return f"printf('{K.TRIGGER_REASONS[n]}', {r(x, places) if places else f'CAST({r(x, 0)} AS INTEGER)'})"


@query("r17_trigger_texts", " UNION ALL ".join(
    f"SELECT user_id, version, '{n}' AS trigger_type, {_reason_sql(n)} AS reason, '{' | '.join(K.TRIGGER_ACTIONS[n])}' AS suggested_actions FROM pv WHERE {w}" for n, w, _ in _TRIG))
def r17_texts(spark, d):
    """What each alert tells its user: the reason with its measure, and the suggested actions."""
    return R.triggers(snaps(spark, d)).select("user_id", "version", "trigger_type", "reason", F.concat_ws(" | ", "suggested_actions").alias("suggested_actions"))


CTES["sent"] = f"""SELECT user_id, version, ts, trigger_type, priority, relevance, unnest(channels) AS channel FROM (
  SELECT *, {r('0.4 * urgency + 0.3 * 0.9 + 0.2 * 0.8 + 0.1 * 1.0')} AS relevance FROM alerts WHERE NOT (trigger_type = 'fraud_anomaly' AND persona = 'shell_circular'))
  WHERE relevance >= 0.75 AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""


def consent(spark, d):
    return T.table(spark, d, "customer").select(c("c_custkey").alias("user_id"), (c("c_acctbal") >= 0).alias("consent"))


@query("r18_notifications", "SELECT user_id, version, trigger_type, priority, relevance, channel FROM sent")
def r18(spark, d):
    sent, _ = R.notifications(R.triggers(snaps(spark, d)), consent(spark, d), personalization=0.9, acceptance=0.8)
    return sent.select("user_id", "version", "trigger_type", "priority", "relevance", "channel")


@query("t3_priority_order", """SELECT user_id, version, trigger_type, CAST(row_number() OVER (PARTITION BY user_id, version
  ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, urgency DESC, trigger_type) AS INTEGER) AS alert_order FROM alerts""")
def t3(spark, d):
    return R.by_priority(R.triggers(snaps(spark, d))).select("user_id", "version", "trigger_type", "alert_order")


@query("r19_reports", f"""SELECT user_id, version, CAST({_SC} AS INTEGER) AS display_score,
  CASE WHEN {_SC} >= 750 THEN 'Excellent' WHEN {_SC} >= 650 THEN 'Good' WHEN {_SC} >= 550 THEN 'Average' ELSE 'Needs Attention' END AS risk_status,
  CAST(3 + (spending_volatility > 0.65)::INT + (income_stability > 0.75 OR income_stability < 0.4)::INT AS INTEGER) AS insights,
  CASE WHEN a = '' THEN 'Maintain your current healthy financial habits' ELSE a END AS actions FROM (SELECT *, concat_ws('; ',
    CASE WHEN cash_buffer_days < 10 THEN 'Reduce non-essential spend to rebuild cash buffer' END,
    CASE WHEN emi_burden_ratio > 0.35 THEN 'Contact lender to explore EMI restructuring' END,
    CASE WHEN spending_volatility > 0.65 THEN 'Review top spending categories and set a weekly budget' END,
    CASE WHEN income_stability < 0.4 THEN 'Diversify income streams or ensure salary credits are regular' END) AS a FROM twin)""")
def r19(spark, d):
    rep = R.reports(T.twin(spark, d))
    return rep.withColumn("insights", F.size("insights")).withColumn("actions", F.array_join("actions", "; "))


@query("r20_eligibility", f"""SELECT user_id, {r('coalesce(l.loan_amount, o.approved_amount, f.income_30d * m)', 2)} AS wc_eligible,
  {r('coalesce(l.loan_amount, o.approved_amount * 1.4, coalesce(l.loan_amount, o.approved_amount, f.income_30d * m) * 1.6)', 2)} AS term_eligible FROM (
  SELECT *, CASE WHEN risk_score < 0.30 THEN 4.5::DOUBLE WHEN risk_score < 0.60 THEN 3.0 ELSE 1.8 END AS m FROM fstate) f
  LEFT JOIN (SELECT user_id, loan_amount FROM scored WHERE months_active > 24) l USING (user_id)
  LEFT JOIN (SELECT user_id, approved_amount FROM offers WHERE tenure_months = 3 AND risk_band <> 'low_risk') o USING (user_id)""")
def r20(spark, d):
    st = state(spark, d)
    live = scored(st).where("months_active > 24").select("user_id", F.lit(None).cast("double").alias("credit_limit"), "loan_amount")
    off = R.offers(T.twin_latest(spark, d)).where("tenure_months = 3 AND risk_band <> 'low_risk'").select("user_id", "approved_amount")
    return R.eligibility(st.select("user_id", c("income_30d").alias("income_monthly"), "risk_score"), live, off)


_SIM_SQL = f"""
SELECT user_id, {r(clamp('stab', 0, 1))} AS income_stability, {r(clamp('vol', 0, 1))} AS spending_volatility,
  CASE WHEN buf < 5 THEN 'LOW' WHEN buf <= 15 THEN 'MEDIUM' ELSE 'HIGH' END AS liquidity_health, {r(clamp('risk', 0, 1))} AS risk_score,
  {r('greatest(buf, 0.0)')} AS cash_buffer_days, {r('greatest(emi, 1.0)')} AS emi_monthly, CAST(round_even({clamp('fail * 3.0', 0, 3)}, 0) AS INTEGER) AS emi_overdue_count,
  {r(clamp('fail', 0, 1))} AS debit_failure_rate, {r('buf * greatest((ess + disc + emi) / 30.0, 1.0)')} AS cash_balance_current,
  {r(clamp(f"0.45 * {clamp('dep', 0, 1.2)} + 0.35 * {clamp('vol', 0, 1)} + 0.20 * {clamp('fail', 0, 1)}", 0, 1))} AS cascade_susceptibility,
  {r('inc')} AS income_monthly, {r('ess')} AS essential_expense_monthly, {r('disc')} AS discretionary_expense_monthly, {r('greatest(inc * 0.2, 0.0)')} AS overdraft_limit
FROM (SELECT *, CASE WHEN p_emi > 0 THEN p_emi WHEN emi_burden_ratio * inc > 0 AND p_emi IS NULL THEN emi_burden_ratio * inc ELSE greatest(1.0::DOUBLE, inc * 0.18) END AS emi,
    CASE WHEN essential_30d > 0 THEN essential_30d ELSE inc * {clamp('1 - savings_rate - discretionary_ratio', 0.1, 0.9)} END AS ess, discretionary_30d AS disc FROM (
  SELECT f.*, CASE WHEN income_30d > 0 THEN income_30d WHEN coalesce(p_emi, 0) > 0 THEN greatest(10000.0::DOUBLE, p_emi * 1.35) ELSE 50000.0 END AS inc,
    cash_buffer_days AS buf, coalesce(s_stab, income_stability_score) AS stab, coalesce(s_vol, spending_volatility_index) AS vol, coalesce(s_risk, 0.0) AS risk,
    debit_failure_rate_90d AS fail, s_dep AS dep FROM (
    SELECT f.user_id, f.income_30d, f.essential_30d, f.discretionary_30d, f.savings_rate, f.discretionary_ratio, f.emi_burden_ratio, f.cash_buffer_days, f.debit_failure_rate_90d,
      f.income_stability_score, f.spending_volatility_index, CASE WHEN f.months_active > 18 THEN f.emi_30d END AS p_emi,
      t.income_stability AS s_stab, t.spending_volatility AS s_vol, t.risk_score AS s_risk, t.credit_dependency_score AS s_dep
    FROM fv f JOIN twin_latest t USING (user_id)) f))"""


@query("r21_simulation_inputs", _SIM_SQL)
def r21(spark, d):
    t = T.twin_latest(spark, d).select("user_id", *[c(n).alias(f"s_{n}") for n in (
        "income_stability", "spending_volatility", "risk_score", "credit_dependency_score")])
    f = T.feature_table(spark, d).withColumn("p_emi_monthly", F.when(c("months_active") > 18, c("emi_30d")))
    return R.simulation_inputs(f.join(t, "user_id"))


def _like(reg: str) -> str:
    return (f"greatest(1e-10::DOUBLE, p_{reg} * CASE kind WHEN 'income' THEN CASE WHEN value > 0 AND mean_income * {K.REGIME_INCOME_MULTIPLIER[reg]} > 0 "
            f"THEN exp(-0.5 * pow((ln(value) - ln(mean_income * {K.REGIME_INCOME_MULTIPLIER[reg]})) / sigma, 2)) ELSE 0.01 END "
            f"WHEN 'emi_paid' THEN {K.REGIME_INSTALMENT_LIKELIHOOD[reg]} ELSE 1.0 END)")


CTES["regime_obs"] = """SELECT user_id, CASE WHEN months_active % 2 = 0 THEN 'income' ELSE 'emi_paid' END AS kind, income_30d AS value,
  greatest(income_90d * 1.2, 1.0) AS mean_income, 0.3::DOUBLE AS sigma, 0.6::DOUBLE AS p_STABLE, 0.3::DOUBLE AS p_STRESSED, 0.1::DOUBLE AS p_CRISIS FROM fv"""


@query("r22_regime_posterior", " UNION ALL ".join(
    f"SELECT user_id, '{g}' AS regime, {r(f'{_like(g)} / ({_like(K.REGIMES[0])} + {_like(K.REGIMES[1])} + {_like(K.REGIMES[2])})')} AS posterior FROM regime_obs"
    for g in K.REGIMES))
def r22(spark, d):
    obs = T.feature_table(spark, d).select(
        "user_id", F.when(c("months_active") % 2 == 0, "income").otherwise("emi_paid").alias("kind"), c("income_30d").alias("value"),
        F.greatest(c("income_90d") * 1.2, F.lit(1.0)).alias("mean_income"), F.lit(0.3).alias("sigma"),
        F.lit(0.6).alias("p_STABLE"), F.lit(0.3).alias("p_STRESSED"), F.lit(0.1).alias("p_CRISIS"))
    return R.regime_posterior(obs)


@query("r23_display_bands", """SELECT user_id, CASE WHEN risk_score < 0.30 THEN 'LOW RISK' WHEN risk_score < 0.60 THEN 'MEDIUM RISK' ELSE 'HIGH RISK' END AS risk_level,
  CASE WHEN g IS NULL THEN 'limited' WHEN g >= 0.90 THEN 'strong' WHEN g >= 0.70 THEN 'moderate' ELSE 'weak' END AS filing_class
  FROM (SELECT *, CASE WHEN gst_30d_value > 0 THEN gst_filing_compliance_rate END AS g FROM fstate)""")
def r23(spark, d):
    g = F.when(c("gst_30d_value") > 0, c("gst_filing_compliance_rate"))
    return state(spark, d).select("user_id", *R.display_bands(c("risk_score"), g))


CTES["est"] = f"""SELECT *, {r(f'CASE WHEN savings_rate <= 0 AND i > 0 THEN {clamp("(i - e) / greatest(i, 1.0)", -1, 1)} ELSE savings_rate END')} AS savings_est,
  {r(f'CASE WHEN i > 0 THEN {clamp("e / greatest(i, 1.0)", 0, 2)} ELSE 0.0 END')} AS debit_credit_ratio,
  {r(f'{clamp("0.15 + 0.6 * cash_dependency_index", 0.05, 0.95)} * 100')} AS utilisation, {r('i', 2)} AS income_est, {r('e', 2)} AS expense_est FROM (
  SELECT f.*, greatest(0.0, CASE WHEN income_30d > 0 THEN income_30d ELSE coalesce(x.inb, 0.0) END) AS i,
    greatest(0.0, CASE WHEN essential_30d + discretionary_30d > 0 THEN essential_30d + discretionary_30d WHEN x.outb > 0 THEN x.outb ELSE 0.0 END) AS e
  FROM fstate f LEFT JOIN (SELECT user_id, round(sum(amount) FILTER (amount > 0), 2) AS inb, round(sum(-amount) FILTER (amount <= 0), 2) AS outb
    FROM ev WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31' GROUP BY user_id) x USING (user_id))"""


def estimated(spark, d):
    from fintrail.operators.timeline import flow_totals
    return R.estimates(state(spark, d).join(flow_totals(T.ev(spark, d), T.REF), "user_id", "left"))


@query("r25_estimates", "SELECT user_id, income_est, expense_est, savings_est, debit_credit_ratio, utilisation FROM est")
def r25(spark, d):
    return estimated(spark, d).select("user_id", "income_est", "expense_est", "savings_est", "debit_credit_ratio", "utilisation")


def _one(e: str) -> str:
    return clamp(e, 0, 1)


_HEALTH = (f"100.0 * (0.30 * {_one(f'(greatest(300, least(900, {_SC})) - 300.0) / 600.0')}"
           f" + 0.20 * {_one(f'''0.60 * {_one('cash_buffer_days / 30.0')} + 0.40 * liquidity_health_index''')}"
           f" + 0.20 * {_one(f'''0.65 * income_stability_score + 0.35 * (1 - {_one('spending_volatility_index / 1.5')})''')}"
           f" + 0.20 * {_one(f'''0.35 * {_one('(savings_est + 0.10) / 0.60')} + 0.25 * (1 - {_one('emi_burden_ratio / 0.60')}) + 0.20 * (1 - {_one('debit_credit_ratio / 1.20')}) + 0.20 * (1 - {_one('utilisation / 100.0 / 0.90')})''')}"
           f" + 0.10 * (1 - 0.08))")


@query("r24_health_index", f"""SELECT user_id, CAST(h AS INTEGER) AS health_index, CASE WHEN h >= 70 THEN 'low_risk' WHEN h >= 45 THEN 'medium_risk' ELSE 'high_risk' END AS health_band
  FROM (SELECT user_id, greatest(0, least(100, {r(_HEALTH, 0)})) AS h FROM est)""")
def r24(spark, d):
    return R.health_index(estimated(spark, d), F.lit(None).cast("double")).select("user_id", "health_index", "health_band")


_URS = "(1 - least(max_posterior, 1.0)) * (0.3 + 0.7 * (emi_burden_ratio * 0.35 + debit_failure_rate_90d * 0.25 + (1 - income_stability_score) * 0.20 + spending_volatility_index * 0.20))"
_ASK = [("income_contradiction", "layers >= 2", 0.85, 1.5, "income_clarify"), ("emi_burden_ratio", "emi_burden_ratio > 0.40", 0.95, 1.0, "future_commitment"),
        ("lifestyle_inflation_trend", "abs(lifestyle_inflation_trend) > 0.15", 0.70, 1.0, "expense_explain"),
        ("cash_buffer_days", "cash_buffer_days < 10", 0.85, 1.0, "asset_disclosure"),
        ("merchant_category_shift_count", "merchant_category_shift_count > 3", 0.40, 1.0, "behavioral_intent"),
        ("debit_failure_rate_90d", "debit_failure_rate_90d > 0.10", 0.90, 1.0, "future_commitment")]
CTES["asked"] = "SELECT *, l1::INT + l2::INT + (over3 OR under3)::INT AS layers, 0.55::DOUBLE AS max_posterior FROM contra"


@query("w13_question_ranking", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY urs DESC, signal) AS INTEGER) AS rank FROM ("
       + " UNION ALL ".join(f"SELECT user_id, '{n}' AS signal, {r(f'{r(f'{w}::DOUBLE * {_URS}')} * {b}::DOUBLE', 6)} AS urs, '{t}' AS template FROM asked WHERE {cond}"
                            for n, cond, w, b, t in _ASK) + ")) WHERE rank <= 5")
def w13(spark, d):
    f = declared(spark, d)
    layers = R.income_contradiction(f).select("user_id", c("layers_triggered").alias("contradiction_layers"))
    return R.question_ranking(f.join(layers, "user_id").withColumn("max_posterior", F.lit(0.55)))


# ------------------------------------------------------- audit and decisions

AUDIT_KIND = {"INCOME": "twin_updated", "EXPENSE_ESSENTIAL": "trigger_fired", "EXPENSE_DISCRETIONARY": "notification_sent",
              "EMI_PAYMENT": "intervention_sent", "SUBSCRIPTION": "chat_message"}
CTES["audit"] = ("SELECT event_id, user_id, ts, CASE transaction_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AUDIT_KIND.items())
                 + " END AS event_type FROM ev")


def audit(spark, d):
    return T.ev(spark, d).select("event_id", "user_id", "ts", lookup(c("transaction_type"), AUDIT_KIND).alias("event_type"),
                                 F.to_json(F.struct("amount", "status")).alias("payload"))


@query("h4_audit_replay", """SELECT event_id, user_id, ts, event_type FROM audit
  WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND event_type IN ('trigger_fired', 'notification_sent')""")
def h4(spark, d):
    """Append to the log, then replay from it."""
    path = scratch(spark, "audit")
    audit(spark, d).write.mode("append").parquet(path)
    return R.replay(spark.read.parquet(path), datetime(2024, 1, 20), ["trigger_fired", "notification_sent"]).select(
        "event_id", "user_id", "ts", "event_type")


CTES["decisions"] = "SELECT user_id, version, ts, CAST(round_even(900 - risk_score * 600, 0) AS INTEGER) AS credit_score, CASE WHEN risk_score < 0.3 THEN 'approved' WHEN risk_score < 0.5 THEN 'complete' WHEN risk_score < 0.7 THEN 'denied' ELSE 'pending' END AS status FROM twin"
DONE = ["complete", "approved", "denied"]


def decisions(spark, d):
    s = c("risk_score")
    return T.twin(spark, d).select("user_id", "version", "ts", TW.display_score(s).alias("credit_score"),
                                   F.when(s < 0.3, "approved").when(s < 0.5, "complete").when(s < 0.7, "denied").otherwise("pending").alias("status"))


@query("h5_decision_list", f"""SELECT user_id, version, credit_score, status, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, version DESC) AS rn
  FROM decisions WHERE status IN ({in_list(DONE)})) WHERE rn <= 10""")
def h5(spark, d):
    return O.newest(decisions(spark, d), 10, c("status").isin(DONE), tie="version").select("user_id", "version", "credit_score", "status", "rn")


@query("j9_evidence_bundle", f"""SELECT u.user_id, t.snapshots, d.decisions, a.audit FROM (SELECT DISTINCT user_id FROM twin) u
  LEFT JOIN (SELECT user_id, string_agg(CAST(version AS VARCHAR), ',' ORDER BY version) AS snapshots FROM twin GROUP BY 1) t USING (user_id)
  LEFT JOIN (SELECT user_id, string_agg(version || ':' || status, ',' ORDER BY version) AS decisions FROM decisions WHERE status IN ({in_list(DONE)}) GROUP BY 1) d USING (user_id)
  LEFT JOIN (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS audit FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM audit) WHERE rn <= 20 GROUP BY 1) a USING (user_id)""")
def j9(spark, d):
    t = T.twin(spark, d)
    b = J.bundle("user_id", t, snapshots=(t, F.struct("version")),
                 decisions=(decisions(spark, d).where(c("status").isin(DONE)), F.struct("version", "status")),
                 audit=(O.newest(audit(spark, d), 20), F.struct("ts", "event_id")))
    return b.select("user_id", F.array_join(F.transform("snapshots", lambda x: x["version"].cast("string")), ",").alias("snapshots"),
                    F.array_join(F.transform("decisions", lambda x: F.concat_ws(":", x["version"].cast("string"), x["status"])), ",").alias("decisions"),
                    F.array_join(F.transform("audit", lambda x: x["event_id"].cast("string")), ",").alias("audit"))


def _at_sql() -> None:
    """Snapshot on the morning of 16 January and on 31 January, as two scored tables."""
    for name, day in (("before", "2024-01-16"), ("after", "2024-01-31")):
        CTES[f"{name}_v"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM twin WHERE ts <= TIMESTAMP '{day}') WHERE rn = 1"
        CTES[f"{name}_p"] = f"SELECT *, risk_score AS probability_of_default, CAST(greatest(300, least(900, floor(900 - risk_score * 600))) AS INTEGER) AS credit_score FROM {name}_v"
        CTES[f"{name}_s"] = _terms(f"{name}_p")


_at_sql()


def _scored_at(spark, d, day):
    t = T.twin(spark, d).where(c("ts") <= ntz(day))
    return scored(TW.latest(t)).withColumnRenamed("daily_avg_throughput_30d", "throughput")


_RECAL = """FROM after_s n JOIN before_s o USING (user_id) WHERE (o.daily_avg_throughput_30d <= 0
  OR abs(n.daily_avg_throughput_30d - o.daily_avg_throughput_30d) / o.daily_avg_throughput_30d >= 0.15)"""


@query("h6_recalibration", f"SELECT user_id, n.credit_score, n.risk_band, n.loan_amount {_RECAL}")
def h6(spark, d):
    up, _ = R.recalibrate(_scored_at(spark, d, datetime(2024, 1, 16)), _scored_at(spark, d, datetime(2024, 1, 31)))
    return up.select("user_id", "credit_score", "risk_band", "loan_amount")


@query("h6_limit_reduced", f"""SELECT user_id, o.loan_amount AS prev_loan, n.loan_amount AS new_loan, {r('(o.loan_amount - n.loan_amount) / o.loan_amount * 100', 1)} AS reduction_pct
  {_RECAL} AND o.loan_amount > 0 AND n.loan_amount < o.loan_amount * 0.95""")
def h6_reduced(spark, d):
    _, cut = R.recalibrate(_scored_at(spark, d, datetime(2024, 1, 16)), _scored_at(spark, d, datetime(2024, 1, 31)))
    return cut


_parts("px", "ev e JOIN (SELECT TIMESTAMP '2024-01-16' AS ref) g ON e.ts >= g.ref - INTERVAL 90 DAY AND e.ts < g.ref",
       "ev e JOIN (SELECT TIMESTAMP '2024-01-16' AS ref) g ON e.ts < g.ref")
CTES["px"] = _derived_sql("px_base", "px_cv", "px_dip", "px_life", None)
CTES["pstate"] = derive_sql("px")
CTES["pscore"] = "SELECT *, risk_score AS probability_of_default, CAST(greatest(300, least(900, floor(900 - risk_score * 600))) AS INTEGER) AS credit_score FROM pstate"
CTES["pterms"] = _terms("pscore")


@query("h7_point_in_time_rescore", "SELECT user_id, credit_score, risk_band, loan_amount FROM pterms")
def h7(spark, d):
    """Features rebuilt from the events before the moment, then scored."""
    at = datetime(2024, 1, 16)
    past = T.ev(spark, d).where(c("ts") < ntz(at))
    return scored(TW.derive(FT.account_features(past, at))).select("user_id", "credit_score", "risk_band", "loan_amount")


CTES["live_scores"] = """SELECT * FROM (SELECT 'G' || user_id AS id, credit_score, ts AS refreshed_at, user_id FROM decisions WHERE version % 2 = 0
  UNION ALL SELECT 'vpa' || user_id, credit_score, ts, user_id FROM decisions WHERE version % 2 = 1) WHERE credit_score > 500"""


@query("h9_freshest_score", """SELECT p.user_id AS entity, CAST(coalesce(l.s, f.s) AS INTEGER) AS credit_score,
  CASE WHEN l.s IS NOT NULL THEN 'live' WHEN f.s IS NOT NULL THEN 'fallback' END AS source FROM profiles p
  LEFT JOIN (SELECT user_id, arg_max(credit_score, refreshed_at) AS s FROM live_scores GROUP BY 1) l USING (user_id)
  LEFT JOIN (SELECT user_id, 300 + (user_id * 7) % 600 AS s FROM profiles WHERE months_active > 20) f USING (user_id)""")
def h9(spark, d):
    p = T.profiles(spark, d)
    dec = decisions(spark, d).where("credit_score > 500")
    live = dec.select(F.when(c("version") % 2 == 0, F.concat(F.lit("G"), "user_id")).otherwise(F.concat(F.lit("vpa"), "user_id")).alias("id"),
                      "credit_score", c("ts").alias("refreshed_at"))
    back = p.where("months_active > 20").select(F.col("user_id").cast("string").alias("id"),
                                                (300 + (c("user_id") * 7) % 600).cast("int").alias("credit_score"))
    return R.freshest_score(C.alias_ids(p), live, back)
