"""Queries for user state, ordered operators and time travel."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fintrail.functions import constants as K
from fintrail.operators import twin as TW
from fintrail.plans import tables as T
from fintrail.plans.registry import query
from fintrail.plans.sql import persona_sql, r

STATE = ["liquidity_health", "liquidity_health_index", "income_stability", "spending_volatility",
         "credit_dependency_score", "peer_deviation_score"]


@query("r1_state_derivation", f"SELECT user_id, {', '.join(STATE)} FROM fstate")
def r1(spark, d):
    return TW.derive(T.feature_table(spark, d)).select("user_id", *STATE)


@query("r2_risk_score", "SELECT user_id, risk_score FROM fstate")
def r2(spark, d):
    return TW.derive(T.feature_table(spark, d)).select("user_id", "risk_score")


@query("r3_scores", """SELECT user_id, CAST(round_even(900 - risk_score * 600, 0) AS INTEGER) AS display_score,
  CAST(greatest(300, least(900, trunc(900 - risk_score * 600))) AS INTEGER) AS bureau_score FROM fstate""")
def r3(spark, d):
    s = TW.derive(T.feature_table(spark, d))
    return s.select("user_id", TW.display_score(F.col("risk_score")).alias("display_score"),
                    TW.bureau_score(F.col("risk_score")).alias("bureau_score"))


def _vector_sql(src: str, keys: str = "user_id", places: int | None = 6) -> str:
    def scaled(k):
        lo, hi = K.VECTOR_RANGES[k]
        return f"greatest(0.0, least(1.0, (CAST({k} AS DOUBLE) - {lo}) / ({hi} - {lo} + 1e-9)))"
    blank = ("top3_merchant_concentration", "peer_cohort_benchmark_deviation") if src == "twin" else ()     # not in snapshots
    xs = ", ".join(f"{scaled(k) if k not in blank else 'greatest(0.0, least(1.0, (0 - %r) / (%r - %r + 1e-9)))' % (K.VECTOR_RANGES[k][0], K.VECTOR_RANGES[k][1], K.VECTOR_RANGES[k][0])} AS x{i}"
                   for i, k in enumerate(K.VECTOR_RANGES))
    full = ", ".join([f"x{i}" for i in range(len(K.VECTOR_RANGES))] + [f"x{i} * x{j}" for i, j in K.VECTOR_PAIRS])
    value = "greatest(0.0, least(1.0, list_dot_product(x, {}::DOUBLE[]) / 32))"
    dots = ", ".join((f"round({value}, {places})" if places else value).format([float(w) for w in row]) for row in TW._matrix())
    return f"SELECT {keys}, [{dots}] AS vector FROM (SELECT {keys}, [{full}] AS x FROM (SELECT {keys}, {xs} FROM {src}))"


@query("r4_behaviour_vector", _vector_sql("fv"))
def r4(spark, d):
    v = TW.behaviour_vector(T.feature_table(spark, d)).select("user_id", "vector")
    return v.select("user_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("r6_persona_candidate",
       f"SELECT user_id, {persona_sql('top3_merchant_concentration')} AS candidate FROM fstate")
def r6(spark, d):
    return T.feature_table(spark, d).select(
        "user_id", TW.persona_candidate(F.col("top3_merchant_concentration")).alias("candidate"))


REGIME_SQL = """CASE WHEN cash_buffer_days < 5 OR emi_burden_ratio > 0.55 THEN 'CRISIS'
  WHEN cash_buffer_days < 15 OR emi_burden_ratio BETWEEN 0.35 AND 0.55 OR debit_failure_rate_90d > 0.08
  THEN 'STRESSED' ELSE 'STABLE' END"""


def regimes(spark, d):
    return T.twin(spark, d).select("user_id", "version", TW.regime(
        F.col("cash_buffer_days"), F.col("emi_burden_ratio"), F.col("debit_failure_rate_90d")).alias("regime"))


@query("r7_regime", f"SELECT user_id, version, {REGIME_SQL} AS regime FROM twin")
def r7(spark, d):
    return regimes(spark, d)


SNAP = ["version", "ts", "risk_score", "liquidity_health", "cash_buffer_days", "emi_burden_ratio",
        "income_stability", "spending_volatility", "persona"]


@query("w4_material_changes", f"""SELECT user_id, {', '.join(SNAP)} FROM (
  SELECT *, (round(risk_score, 4), liquidity_health, round(cash_buffer_days, 2), round(emi_burden_ratio, 4),
    round(income_stability, 4), round(spending_volatility, 4), persona) AS sig,
    lag((round(risk_score, 4), liquidity_health, round(cash_buffer_days, 2), round(emi_burden_ratio, 4),
    round(income_stability, 4), round(spending_volatility, 4), persona)) OVER (PARTITION BY user_id ORDER BY version) AS psig
  FROM twin) WHERE sig IS DISTINCT FROM psig""")
def w4(spark, d):
    return TW.material_changes(T.twin(spark, d)).select("user_id", *SNAP)


@query("w5_latest_per_day", """SELECT user_id, CAST(ts AS DATE) AS day, version, risk_score FROM twin
  QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, version DESC) = 1""")
def w5(spark, d):
    return TW.latest_per_day(T.twin(spark, d)).select("user_id", "day", "version", "risk_score")


@query("w6_histories", f"""SELECT user_id, version, ts,
  list({r('risk_score')}) OVER (PARTITION BY user_id ORDER BY version ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS risk_history,
  array_to_string(list(version || ':' || liquidity_health) OVER (PARTITION BY user_id ORDER BY version
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS feature_history,
  list({r('risk_score')}) OVER (PARTITION BY user_id ORDER BY version ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS trend
  FROM twin""")
def w6(spark, d):
    h = TW.histories(T.twin(spark, d)).withColumn("trend", F.col("trend.risk_score"))
    return h.withColumn("feature_history", F.array_join(F.transform(
        "feature_history", lambda s: F.concat_ws(":", s["version"].cast("string"), s["liquidity_health"])), ","))


@query("w7_persona_carry", "SELECT user_id, version, persona FROM twin")
def w7(spark, d):
    return T.twin(spark, d).select("user_id", "version", "persona")


@query("w8_trajectory_delta", f"""SELECT user_id, version, {r('''CASE WHEN n >= 2 THEN greatest(first_risk - risk_score, 0.0) ELSE 0.0 END''')} AS trajectory_delta
  FROM (SELECT *, count(*) OVER w AS n, first_value(risk_score) OVER w AS first_risk FROM twin
    WINDOW w AS (PARTITION BY user_id ORDER BY version ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def w8(spark, d):
    return TW.trajectory_delta(T.twin(spark, d))


@query("w9_previous_volatility", """SELECT user_id, version, CASE WHEN n >= 2 THEN v END AS previous_volatility
  FROM (SELECT *, count(*) OVER w AS n, first_value(spending_volatility) OVER w AS v FROM twin
    WINDOW w AS (PARTITION BY user_id ORDER BY version ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def w9(spark, d):
    return TW.previous_volatility(T.twin(spark, d)).select("user_id", "version", "previous_volatility")


@query("w14_vector_smoothing", "SELECT user_id, version, [round(z, 6) FOR z IN v] AS vector FROM blend",
       tvec=_vector_sql("twin", "user_id, version, risk_score", None),
       blend="""/*RECURSIVE*/SELECT user_id, version, risk_score, vector AS v FROM tvec WHERE version = 1 UNION ALL
  SELECT t.user_id, t.version, t.risk_score, [greatest(0.0, least(1.0, (1 - greatest(0.15, least(0.65, 0.20 + abs(t.risk_score - b.risk_score) * 1.5))) * b.v[i]
    + greatest(0.15, least(0.65, 0.20 + abs(t.risk_score - b.risk_score) * 1.5)) * t.vector[i])) FOR i IN range(1, 33)]
  FROM blend b JOIN tvec t ON t.user_id = b.user_id AND t.version = b.version + 1""")
def w14(spark, d):
    v = TW.smooth_vectors(TW.behaviour_vector(T.twin(spark, d)).select("user_id", "version", "risk_score", "vector"))
    return v.select("user_id", "version", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def _vol(i: int) -> str:
    return ("CASE persona " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in K.VOLATILITY_PARAMS.items())
            + f" ELSE {K.VOLATILITY_PARAMS['unknown'][i]}::DOUBLE END")


@query("w15_conditional_variance", f"SELECT user_id, version, {r('sqrt(var)', 6)} AS sigma FROM filt",
       shocks=f"""SELECT user_id, version, risk_score - coalesce(lag(risk_score) OVER (PARTITION BY user_id ORDER BY version), risk_score) AS e,
  {_vol(0)} AS w, {_vol(1)} AS a, {_vol(2)} AS b FROM twin""",
       filt="""/*RECURSIVE*/SELECT user_id, version, e, w / (1 - a - b) AS var FROM shocks WHERE version = 1 UNION ALL
  SELECT s.user_id, s.version, s.e, greatest(s.w + s.a * f.e * f.e + s.b * f.var, 1e-10) FROM filt f JOIN shocks s ON s.user_id = f.user_id AND s.version = f.version + 1""")
def w15(spark, d):
    return TW.conditional_variance(T.twin(spark, d), "risk_score")


@query("w16_transition_matrix", f"""SELECT from_regime, to_regime, moves,
  {r('moves / sum(moves) OVER (PARTITION BY from_regime)')} AS share FROM (
  SELECT from_regime, regime AS to_regime, count(*) AS moves FROM (
    SELECT {REGIME_SQL} AS regime, lag({REGIME_SQL}) OVER (PARTITION BY user_id ORDER BY version) AS from_regime FROM twin)
  WHERE from_regime IS NOT NULL GROUP BY 1, 2)""")
def w16(spark, d):
    return TW.transition_matrix(regimes(spark, d))


DIFF = ["cash_buffer_days", "emi_burden_ratio", "savings_rate", "spending_volatility_index", "income_30d"]
STDS = {k: v[1] for k, v in K.FEATURE_NORMS.items()}
_DIFF_SQL = " UNION ALL ".join(
    f"SELECT user_id, version, '{f}' AS feature, lag({f}) OVER (PARTITION BY user_id ORDER BY version) AS previous, {f} AS current FROM twin"
    for f in DIFF)
_STD_SQL = "CASE feature " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STDS.items()) + " ELSE 1.0 END"


@query("j8_snapshot_diff", f"SELECT * FROM ({_DIFF_SQL}) WHERE previous IS NOT NULL")
def j8(spark, d):
    return TW.snapshot_diff(T.twin(spark, d), DIFF)


@query("w12_delta_packet", f"""SELECT * FROM (SELECT user_id, version, feature, {r('previous')} AS previous, {r('current')} AS current,
  {r('z', 3)} AS z_change, CASE WHEN (feature IN ('cash_buffer_days', 'savings_rate', 'income_30d') AND z > 0)
    OR (feature IN ('emi_burden_ratio', 'spending_volatility_index') AND z < 0) THEN 'improved' ELSE 'degraded' END AS direction,
  CAST(row_number() OVER (PARTITION BY user_id, version ORDER BY abs({r('z', 3)}) DESC, feature) AS INTEGER) AS rank
  FROM (SELECT *, (current - previous) / {_STD_SQL} AS z FROM ({_DIFF_SQL}) WHERE previous IS NOT NULL) WHERE abs(z) >= 0.5)
  WHERE rank <= 10""")
def w12(spark, d):
    return TW.changed_features(TW.snapshot_diff(T.twin(spark, d), DIFF), STDS)


# ------------------------------------------------------------ time travel

_ASOF = """SELECT e.event_id, e.user_id, e.ts, t.version AS snap_version, t.risk_score AS snap_risk_score, t.persona AS snap_persona
  FROM ev e ASOF LEFT JOIN twin t ON e.user_id = t.user_id AND e.ts >= t.ts"""


@query("j4_as_of_join", _ASOF)
def j4(spark, d):
    targets = T.ev(spark, d).select("event_id", "user_id", "ts")
    return TW.as_of(targets, T.twin(spark, d), ["version", "risk_score", "persona"])


@query("h1_point_in_time", """SELECT c.user_id, t.version, t.risk_score FROM (SELECT DISTINCT user_id, TIMESTAMP '2024-01-10 12:00:00' AS at FROM ev) c
  ASOF LEFT JOIN twin t ON c.user_id = t.user_id AND c.at >= t.ts""")
def h1(spark, d):
    users = T.ev(spark, d).select("user_id").distinct()
    return TW.at_time(users, T.twin(spark, d), datetime(2024, 1, 10, 12), ["version", "risk_score"])


@query("h2_by_version", "SELECT user_id, version, risk_score, persona FROM twin WHERE version = user_id % 5 + 1")
def h2(spark, d):
    t = T.twin(spark, d)
    want = t.select("user_id", (F.col("user_id") % 5 + 1).cast("int").alias("version")).distinct()
    return TW.at_version(t, want).select("user_id", "version", "risk_score", "persona")


@query("h3_rollback", """SELECT user_id, version, ts, risk_score, min(ts) OVER (PARTITION BY user_id) AS created_at FROM twin
  UNION ALL SELECT user_id, CAST(mv + 1 AS INTEGER), TIMESTAMP '2024-02-15 00:00:00', risk_score, created_at FROM (
    SELECT *, max(version) OVER (PARTITION BY user_id) AS mv, min(ts) OVER (PARTITION BY user_id) AS created_at FROM twin)
  WHERE version = 3""")
def h3(spark, d):
    t = T.twin(spark, d)
    want = t.select("user_id").distinct().withColumn("version", F.lit(3))
    return TW.rollback(t, want, datetime(2024, 2, 15)).select("user_id", "version", "ts", "risk_score", "created_at")


@query("h8_bootstrap", f"SELECT user_id, risk_score, liquidity_health, coalesce({persona_sql('top3_merchant_concentration')}, 'genuine_healthy') AS persona, 1 AS version FROM fstate")
def h8(spark, d):
    s = TW.derive(T.feature_table(spark, d))
    s = s.withColumn("candidate", TW.persona_candidate(F.col("top3_merchant_concentration"))).withColumn("ts", F.col("ref"))
    return TW.versioned(TW.carry_persona(s)).select("user_id", "risk_score", "liquidity_health", "persona", "version")
