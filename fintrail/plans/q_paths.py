"""Queries for balance paths and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from fintrail.functions import constants as K
from fintrail.operators import paths as P, risk as R, twin as TW, vigilance as V
from fintrail.plans import tables as T
from fintrail.plans.q_twin import REGIME_SQL
from fintrail.plans.registry import query
from fintrail.plans.sql import CTES, REF, in_list, r

c = F.col
EMI = 3000.0        # half of it is the warning floor of 1,500
CASH = 2000.0
TYPES = {"income": ["INCOME"], "essential": ["EXPENSE_ESSENTIAL"], "discretionary": ["EXPENSE_DISCRETIONARY"], "emi": ["EMI_PAYMENT", "SUBSCRIPTION"]}

CTES["flows"] = f"""SELECT g.path_id, CAST(g.day AS INTEGER) AS day, {', '.join(f'coalesce(x.{n}, 0.0) AS {n}' for n in TYPES)} FROM (
  SELECT path_id, unnest(range((SELECT date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 FROM ev))) AS day FROM (SELECT DISTINCT user_id AS path_id FROM ev)) g
  LEFT JOIN (SELECT user_id AS path_id, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM ev), CAST(ts AS DATE)) AS day,
    {', '.join(f"round(coalesce(sum(abs(amount)) FILTER (transaction_type IN ({in_list(t)})), 0.0), 2) AS {n}" for n, t in TYPES.items())}
    FROM ev GROUP BY 1, 2) x USING (path_id, day)"""
CTES["paths"] = "SELECT path_id, day, round(2000 + sum(income - essential - discretionary - emi) OVER (PARTITION BY path_id ORDER BY day), 2) AS balance FROM flows"
CTES["ews"] = f"SELECT path_id, {', '.join(f'coalesce((min(balance) FILTER (day < {h}) < 1500)::INT, 0) AS b{h}' for h in (7, 14, 30))} FROM paths GROUP BY path_id"


@query("p1_early_warning", f"SELECT {', '.join(f'{r(f'avg(b{h})')} AS ews_{h}d' for h in (7, 14, 30))} FROM ews")
def p1(spark, d):
    return P.early_warning(T.paths(spark, d), EMI)


@query("v8_warning_severity", f"""SELECT path_id, s AS ews_14d, CASE WHEN s >= 0.55 THEN 'RED' WHEN s >= 0.30 THEN 'ORANGE' WHEN s >= 0.15 THEN 'AMBER' ELSE 'GREEN' END AS severity,
  CASE WHEN s >= 0.55 THEN 'IMMEDIATE_INTERVENTION + HUMAN_ESCALATION' WHEN s >= 0.30 THEN 'EMI_AT_RISK_ALERT + MICRO_LOAN_PRE_QUALIFY' WHEN s >= 0.15 THEN 'SOFT_NUDGE' ELSE 'NO_ACTION' END AS recommendation
  FROM (SELECT path_id, {r('avg((balance < 1500)::INT) FILTER (day < 14)')} AS s FROM paths GROUP BY path_id)""")
def v8(spark, d):
    e = P.early_warning_per_path(T.paths(spark, d), EMI)
    return e.select("path_id", "ews_14d", *V.warning_severity(c("ews_14d")))


_AGE = f"floor((epoch_us({REF}) - epoch_us(ts)) / 86400000000)"
_VOL = lambda n: f"CASE WHEN sum(spent) FILTER (age < {n}) > 0 THEN sqrt(greatest(coalesce(sum(spent * spent) FILTER (age < {n}), 0) / {n} - (sum(spent) FILTER (age < {n}) / {n}) ** 2, 0)) / (sum(spent) FILTER (age < {n}) / {n}) END"
CTES["pressure"] = f"""SELECT user_id, coalesce(CASE WHEN v30 > 0 THEN {r('v7 / v30 - 1')} END, 0.0) AS volatility_change, f AS debit_failures_7d FROM (
  SELECT user_id, {_VOL(7)} AS v7, {_VOL(30)} AS v30, CAST(coalesce(sum(failed) FILTER (age < 7), 0) AS BIGINT) AS f FROM (
    SELECT user_id, {_AGE} AS age, round(coalesce(sum(-amount) FILTER (status <> 'FAILED'), 0.0), 2) AS spent, count(*) FILTER (status = 'FAILED') AS failed
    FROM ev WHERE ts <= {REF} AND ts > {REF} - INTERVAL 30 DAY AND amount < 0 GROUP BY 1, 2) GROUP BY user_id)"""
CTES["burn"] = f"""SELECT path_id AS user_id, {r('greatest(coalesce(CASE WHEN n > 0 THEN (b0 - b1) / n END, 0.0), 0.0)', 2)} AS avg_daily_burn FROM (
  SELECT path_id, min_by(balance, day) AS b0, max_by(balance, day) AS b1, max(day) - min(day) AS n FROM paths WHERE day < 30 GROUP BY path_id)"""


@query("v8_leading_indicators", f"""SELECT user_id, v AS volatility_change, f AS debit_failures_7d, b AS avg_daily_burn, CAST({r('v * 100', 0)} AS INTEGER) AS volatility_change_pct,
  CASE WHEN v > 0.10 OR f > 0 OR b > 0 THEN concat_ws(',', CASE WHEN v > 0.10 THEN 'SPENDING_VOLATILITY_UP' END, CASE WHEN f > 0 THEN 'DEBIT_FAILURES' END,
    CASE WHEN b > 0 THEN 'CASH_BUFFER_DECLINING' END) ELSE 'NONE' END AS indicators
  FROM (SELECT user_id, coalesce(volatility_change, 0.0) AS v, CAST(coalesce(debit_failures_7d, 0) AS BIGINT) AS f, coalesce(avg_daily_burn, 0.0) AS b
    FROM pressure FULL JOIN burn USING (user_id))""")
def v8_indicators(spark, d):
    burn = P.daily_burn(T.paths(spark, d)).withColumnRenamed("path_id", "user_id")
    both = V.spend_pressure(T.ev(spark, d), T.REF).join(burn, "user_id", "full")
    zero = {"volatility_change": 0.0, "debit_failures_7d": 0, "avg_daily_burn": 0.0}
    return V.leading_indicators(both.fillna(zero)).withColumn("indicators", F.array_join("indicators", ","))


@query("p2_value_at_risk", f"""SELECT {r('max(loss) FILTER (i = k)', 2)} AS var, {r('avg(loss) FILTER (i >= k)', 2)} AS cvar FROM (
  SELECT loss, row_number() OVER (ORDER BY loss) - 1 AS i, floor(0.95::DOUBLE * count(*) OVER ()) AS k FROM (SELECT {CASH} - min(balance) AS loss FROM paths GROUP BY path_id))""")
def p2(spark, d):
    return P.value_at_risk(T.paths(spark, d), CASH)


CTES["fan"] = "SELECT day, " + ", ".join(f"{r(f'quantile_cont(balance, {p})', 2)} AS {n}" for n, p in P.FAN.items()) + " FROM paths GROUP BY day"


@query("p3_fan_chart", "SELECT day, p10, p25, p50, p75, p90 FROM fan")
def p3(spark, d):
    return P.fan_chart(T.paths(spark, d))


@query("p4_horizon_snapshots", " UNION ALL ".join(
    f"""SELECT {h} AS horizon, {r(f'avg(coalesce((d0 <= {h - 1})::INT, 0))')} AS default_probability, {r(f'nullif(avg(d1) FILTER (d1 <= {h - 1}), 0)', 1)} AS shortage_day_mean, {r(f'avg(b{h})', 2)} AS delta_mean
    FROM (SELECT path_id, min(day) FILTER (balance < 500) AS d0, min(day) FILTER (balance < 1500) AS d1, max(balance) FILTER (day = least({h - 1}, (SELECT max(day) FROM paths))) - {CASH} AS b{h} FROM paths GROUP BY path_id)"""
    for h in (30, 60, 90)))
def p4(spark, d):
    return P.horizon_snapshots(T.paths(spark, d), (30, 60, 90), CASH, EMI, 500.0)


@query("p5_final_delta", f"SELECT {r('avg(x)', 2)} AS mean, " + ", ".join(f"{r(f'quantile_cont(x, {p})', 2)} AS {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
       + f" FROM (SELECT arg_max(balance, day) - {CASH} AS x FROM paths GROUP BY path_id)")
def p5(spark, d):
    return P.final_delta(T.paths(spark, d), CASH)


@query("p5_first_passage", f"SELECT {r('avg(x)', 1)} AS mean, " + ", ".join(f"CAST(floor(round(quantile_cont(x::DOUBLE, {p}), 6)) AS INTEGER) AS {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
       + " FROM (SELECT min(day) AS x FROM paths WHERE balance < 1500 GROUP BY path_id)")
def p5_first(spark, d):
    return P.first_passage(T.paths(spark, d), EMI)


@query("p5_default_share", f"SELECT {r('avg((m <= 0)::INT)')} AS default_probability FROM (SELECT min(balance) AS m FROM paths GROUP BY path_id)")
def p5_default(spark, d):
    return P.default_share(T.paths(spark, d))


@query("p6_regime_shares", "SELECT " + ", ".join(f"{r(f'''avg((regime = '{g}')::INT)''')} AS {g.lower()}" for g in K.REGIMES)
       + f" FROM (SELECT {REGIME_SQL} AS regime FROM twin WHERE ts = TIMESTAMP '2024-01-16')")
def p6(spark, d):
    t = T.twin(spark, d).where(c("ts") == F.lit("2024-01-16").cast("timestamp_ntz"))
    return P.regime_shares(t.select(TW.regime(c("cash_buffer_days"), c("emi_burden_ratio"), c("debit_failure_rate_90d")).alias("regime")))


@query("p6_stage_shares", "SELECT " + ", ".join(f"{r(f'avg((stage >= {s})::INT)')} AS stage{s}" for s in (1, 2, 3, 4))
       + f", {r('avg(stage) / 4.0')} AS stress_score FROM (SELECT least(4, count(*) FILTER (status = 'FAILED')) AS stage FROM ev GROUP BY user_id)")
def p6_stages(spark, d):
    """A path's stage is its number of failed payments, four at most."""
    s = T.ev(spark, d).groupBy("user_id").agg(F.least(F.lit(4), F.count_if(c("status") == "FAILED")).alias("stage"))
    return P.stage_shares(s)


CHOSEN = ["S_INC_RISE_20", "C_JOB_MEDICAL", "CA_FRAUD_SPIRAL"]


def _days_sql() -> str:
    """Scenario days written out from the scenario definitions, one row per part and day."""
    rows = []
    for s in CHOSEN:
        for atomic, off in (K.CASCADING_SCENARIOS.get(s) or [(a, 0) for a in K.COMPOUND_SCENARIOS.get(s, [s])]):
            inc, ess, disc, miss, once, days, _, ramp, target = K.ATOMIC_SCENARIOS[atomic]
            for day in range(off, min(off + days, T.SCENARIO_DAYS)):
                i = inc if ramp < 0 or day < off + ramp else inc + (target - inc) * min((day - off - ramp) / max(days - ramp, 1), 1.0)
                rows.append(f"('{s}', {day}, {i}::DOUBLE, {ess}::DOUBLE, {disc}::DOUBLE, {miss}::DOUBLE, {once if day == off else 0.0}::DOUBLE)")
    pick = lambda n: f"CASE WHEN min({n}) < 1 THEN min({n}) ELSE max({n}) END AS {n}"
    return (f"SELECT scenario, day, {pick('inc')}, {pick('ess')}, {pick('disc')}, sum(miss) AS miss, sum(once) AS once "
            f"FROM (VALUES {', '.join(rows)}) v(scenario, day, inc, ess, disc, miss, once) GROUP BY 1, 2")


CTES["scen_days"] = _days_sql()


@query("j6_scenario_days", f"SELECT scenario, day, {r('inc')} AS income, {r('ess')} AS essential, {r('disc')} AS discretionary, {r('miss')} AS miss, {r('once', 2)} AS once, n AS users FROM scen_days JOIN (SELECT day, count(*) AS n FROM flows GROUP BY day) USING (day)")
def j6(spark, d):
    """Active scenario days joined to the observed calendar."""
    from fintrail.functions.numeric import rnd
    cal = P.scenario_days(P.scenario_intervals(spark, CHOSEN, T.SCENARIO_DAYS))
    seen = T.flows(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("users"))
    j = seen.join(F.broadcast(cal), "day")
    return j.select("scenario", "day", *[rnd(n, 4).alias(n) for n in ("income", "essential", "discretionary", "miss")], rnd("once", 2).alias("once"), "users")


@query("p7_scenario_overlay", f"""SELECT scenario, path_id, day, coalesce(miss, 0.0) AS miss_delta, {r('2000 + sum(net) OVER (PARTITION BY scenario, path_id ORDER BY day)', 2)} AS balance FROM (
  SELECT s.scenario, f.path_id, f.day, x.miss, f.income * coalesce(x.inc, 1.0) - f.essential * coalesce(x.ess, 1.0) - f.discretionary * coalesce(x.disc, 1.0) - f.emi - coalesce(x.once, 0.0) AS net
  FROM flows f CROSS JOIN (SELECT unnest([{in_list(CHOSEN)}]) AS scenario) s LEFT JOIN scen_days x ON x.scenario = s.scenario AND x.day = f.day)""")
def p7(spark, d):
    return P.overlay(T.flows(spark, d), spark, CHOSEN, T.SCENARIO_DAYS, CASH)


@query("p8_reweighted_paths", f"""SELECT path_id, p.day, {r('CASE WHEN p.day >= o.day AND o.inflow > 0 THEN balance * (1 + (o.inflow / 100.0 - 1) * (1 / (1 + (p.day - o.day) * 0.02)) * 0.3) ELSE balance END')} AS balance
  FROM paths p LEFT JOIN (SELECT path_id, arg_max(day, (income, -day)) AS day, max(income) AS inflow FROM flows GROUP BY path_id) o USING (path_id)""")
def p8(spark, d):
    """Each path observed on the day of its largest income, 100 being expected."""
    obs = T.flows(spark, d).groupBy("path_id").agg(F.max_by("day", F.struct("income", -c("day"))).alias("obs_day"), F.max("income").alias("inflow"))
    return P.reweight(T.paths(spark, d), obs.withColumn("expected", F.lit(100.0)))


CTES["overrides"] = """SELECT c_custkey AS user_id, CAST(c_custkey % 25 * 8 - 100 AS DOUBLE) AS income_change_pct, CAST(c_custkey % 7 * 6 AS DOUBLE) AS revenue_change_pct,
  CAST(c_nationkey * 2 AS DOUBLE) AS expense_change_pct, CASE c_mktsegment WHEN 'BUILDING' THEN 'gst_shock' WHEN 'MACHINERY' THEN 'medical' WHEN 'FURNITURE' THEN 'Expansion' ELSE '' END AS scenario_name,
  c_acctbal < 0 AS job_loss, c_acctbal > 9000 AS medical_emergency FROM customer"""
_NAME = "lower(scenario_name)"
_EFF = "CASE WHEN income_change_pct <> 0 THEN income_change_pct ELSE revenue_change_pct END"


@query("p9_override_scenarios", f"""SELECT user_id, s AS components, CASE WHEN s = '' THEN 'baseline' WHEN s NOT LIKE '%,%' THEN 'atomic' ELSE 'compound' END AS scenario_type FROM (SELECT user_id, concat_ws(',',
  CASE WHEN {_EFF} <= -45 THEN 'S_INC_DROP_50' WHEN {_EFF} <= -15 THEN 'S_INC_DROP_20' WHEN {_EFF} >= 15 OR revenue_change_pct >= 25 OR {_NAME} = 'expansion' THEN 'S_INC_RISE_20' END,
  CASE WHEN expense_change_pct >= 25 OR {_NAME} IN ('supply_squeeze', 'gst_shock') THEN 'S_EXP_SURGE_30' END, CASE WHEN {_NAME} = 'gst_shock' THEN 'S_RATE_HIKE' END,
  CASE WHEN job_loss OR {_NAME} = 'job_loss' THEN 'S_JOB_LOSS' END, CASE WHEN medical_emergency OR {_NAME} = 'medical' THEN 'S_MEDICAL' END) AS s FROM overrides)""")
def p9(spark, d):
    k, seg, bal = c("c_custkey"), c("c_mktsegment"), c("c_acctbal")
    o = T.table(spark, d, "customer").select(
        k.alias("user_id"), (k % 25 * 8 - 100).cast("double").alias("income_change_pct"), (k % 7 * 6).cast("double").alias("revenue_change_pct"),
        (c("c_nationkey") * 2).cast("double").alias("expense_change_pct"),
        F.when(seg == "BUILDING", "gst_shock").when(seg == "MACHINERY", "medical").when(seg == "FURNITURE", "Expansion").otherwise("").alias("scenario_name"),
        (bal < 0).alias("job_loss"), (bal > 9000).alias("medical_emergency"))
    return P.scenarios_of_overrides(o).select("user_id", F.array_join("components", ",").alias("components"), "scenario_type")


@query("p10_risk_series", f"""SELECT day, {r('greatest(0.0, least(1.0, 1 - p50 / greatest(abs(f), 1.0)))')} AS risk FROM (SELECT day, p50, first_value(p50) OVER (ORDER BY day) AS f FROM fan) WHERE day < 30""")
def p10(spark, d):
    return P.risk_series(P.fan_chart(T.paths(spark, d)))


@query("r26_distress_gate", f"""SELECT t.user_id, t.liquidity_health, e.s14 AS ews_14d, {r('least(0.99, e.s30)')} AS signal_probability, 'PAYDAY_SHIFT,EMI_STRESS_IMMINENT' AS intent_signals
  FROM twin_latest t JOIN (SELECT path_id AS user_id, {r('avg((balance < 1500)::INT) FILTER (day < 14)')} AS s14, {r('avg((balance < 1500)::INT)')} AS s30 FROM paths GROUP BY 1) e USING (user_id)
  WHERE t.liquidity_health = 'LOW' OR e.s14 >= 0.35""")
def r26(spark, d):
    e = P.early_warning_per_path(T.paths(spark, d), EMI).withColumnRenamed("path_id", "user_id")
    st = T.twin_latest(spark, d).join(e, "user_id").withColumn("intent_signals", F.array(F.lit("PAYDAY_SHIFT")))
    return R.distress(st).select("user_id", "liquidity_health", "ews_14d", "signal_probability", F.array_join("intent_signals", ",").alias("intent_signals"))
