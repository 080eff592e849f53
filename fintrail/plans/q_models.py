"""Queries for model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import rnd
from fintrail.operators import models as M, ordered as O, risk as R, twin as TW
from fintrail.plans import tables as T
from fintrail.plans.registry import query
from fintrail.plans.sql import CTES, r

c = F.col


def _col(n: str) -> str:
    flags = ("salary_day_spike_flag", "anomaly_flag")
    return f"CAST({n}::INT AS DOUBLE) AS {n}" if n in flags else f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}"


@query("m1_feature_matrix", "SELECT user_id, " + ", ".join(_col(n) for n in K.FEATURE_COLUMNS) + " FROM fv")
def m1(spark, d):
    return M.feature_matrix(T.feature_table(spark, d))


def _labels(fv):
    return fv.select("user_id", (R.proxy_label() > 0.5).cast("int").alias("label"))


_MODELS: dict = {}


def trained(spark, d):
    """Both classifiers, fitted once per application and data folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        fv = T.processed_features(spark, d)
        labels = _labels(fv)
        _MODELS[key] = (M.train(fv, labels), M.train(fv, labels, K.DISCRETIONARY_COLUMNS))
    return _MODELS[key]


@query("m2_train")
def m2(spark, d):
    """Rows and validation AUC of the two models."""
    (full, a), (income, b) = trained(spark, d)
    fv = T.processed_features(spark, d)
    counts = fv.agg(F.count_if(M.in_training()).alias("train_rows"), F.count_if(~M.in_training()).alias("held_out_rows"))
    items = F.array(F.struct(F.lit("full").alias("model"), F.lit(float(a)).alias("auc")), F.struct(F.lit("income_heavy").alias("model"), F.lit(float(b)).alias("auc")))
    return counts.select("train_rows", "held_out_rows", F.explode(items).alias("m")).select("m.*", "train_rows", "held_out_rows")


@query("m3_batch_score")
def m3(spark, d):
    (full, _), (income, _) = trained(spark, d)
    last = TW.latest(TW.trajectory_delta(T.twin(spark, d))).select("user_id", "trajectory_delta")
    s = M.score(T.processed_features(spark, d), full, income, last)
    return s.select("user_id", "model", "credit_score", "risk_band", rnd("probability_of_default", 4).alias("probability_of_default"),
                    "loan_amount", "tenure_months", "apr", c("rule_trace.emi_burden_check.result").alias("emi_burden_check"))


CTES["ranked_docs"] = "SELECT quality, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)"


@query("m4_auc", f"""SELECT {r('(sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0))', 6)} AS auc,
  count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM (
  SELECT quality, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM ranked_docs)""")
def m4(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", c("n_chars").cast("double").alias("s"))
    return M.auc(T.table(spark, d, "labels").join(docs, "doc_id"), "s", "quality")


# which users lack which of the targets: those with little consignment traffic have no business columns, and two
# slices of users lack their balances or their repayment record
HOLES = [("ewb_30d_value < 20000", ["gst_30d_value", "ewb_30d_value", "gst_filing_compliance_rate", "statutory_payment_regularity_score"]),
         ("user_id % 7 = 0", ["emi_burden_ratio", "debit_failure_rate_90d"]), ("user_id % 11 = 0", ["cash_buffer_days", "savings_rate"])]
CTES["holes"] = "SELECT user_id, " + ", ".join([*K.IMPUTE_REFERENCE, *[f"CASE WHEN NOT ({w}) THEN {n} END AS {n}" for w, ns in HOLES for n in ns]]) + " FROM fv"
_DIST_COLS = [*K.IMPUTE_REFERENCE, *K.IMPUTE_TARGET]
_DIST = (f"sqrt(({' + '.join(f'coalesce(pow(q.{n} - b.{n}, 2), 0.0)' for n in _DIST_COLS)}) * {len(_DIST_COLS)}.0 / "
         f"({' + '.join(f'(q.{n} IS NOT NULL AND b.{n} IS NOT NULL)::INT' for n in _DIST_COLS)}))")
for _i, (_, _names) in enumerate(HOLES):
    CTES[f"filled_{_i}"] = f"""SELECT user_id, {', '.join(f'avg({n}) AS {n}' for n in _names)} FROM (SELECT q.user_id, {', '.join(f'b.{n}' for n in _names)},
      row_number() OVER (PARTITION BY q.user_id ORDER BY {_DIST}, b.user_id) AS rn FROM holes q JOIN holes b ON q.{_names[0]} IS NULL AND b.{_names[0]} IS NOT NULL)
      WHERE rn <= 5 GROUP BY user_id"""


@query("m5_knn_impute", f"""SELECT h.user_id, {', '.join(f"{r(f'coalesce(h.{n}, f{i}.{n})')} AS {n}" for i, (_, ns) in enumerate(HOLES) for n in ns)}
  FROM holes h {' '.join(f'LEFT JOIN filled_{i} f{i} ON f{i}.user_id = h.user_id' for i in range(len(HOLES)))}""")
def m5(spark, d):
    """All eight targets have gaps, in three patterns that overlap."""
    f = T.feature_table(spark, d)
    holes = f.select("user_id", *K.IMPUTE_REFERENCE, *[F.when(~F.expr(w), c(n)).alias(n) for w, ns in HOLES for n in ns])
    return M.knn_impute(holes, K.IMPUTE_REFERENCE, K.IMPUTE_TARGET).select("user_id", *[rnd(n, 4).alias(n) for n in K.IMPUTE_TARGET])


@query("m6_isolation_flags")
def m6(spark, d):
    return M.isolation_flags(T.feature_table(spark, d), K.CADENCE_COLUMNS).withColumn("isolation_score", rnd("isolation_score", 6))


@query("m6_post_processed", f"SELECT user_id, {', '.join(f'{r(n)} AS {n}' for n in K.IMPUTE_TARGET)} FROM fv")
def m6_post(spark, d):
    """The eight sparse columns of the batch as models read them (nothing is missing in these vectors, so they stay)."""
    return T.processed_features(spark, d).select("user_id", *[rnd(n, 4).alias(n) for n in K.IMPUTE_TARGET])


@query("m6_flagged_labels")
def m6_labels(spark, d):
    """Per user: the batch flag and the label probability that it enters."""
    return T.processed_features(spark, d).select("user_id", "temporal_anomaly_flag", rnd(R.proxy_label(), 4).alias("probability"))


WEIGHTS = {"emi_burden_ratio": 0.125, "debit_failure_rate_90d": 0.20, "spending_volatility_index": 0.05, "discretionary_ratio": 0.05,
           "cash_dependency_index": 0.05, "savings_rate": -0.15, "income_stability_score": -0.05}
CTES["contrib"] = " UNION ALL ".join(f"SELECT user_id, '{n}' AS feature, {r(f'{w} * ({n} - avg({n}) OVER ())', 6)} AS value FROM fv" for n, w in WEIGHTS.items())


@query("m7_linear_attribution", "SELECT user_id, feature, value FROM contrib")
def m7(spark, d):
    return M.linear_attribution(T.feature_table(spark, d), WEIGHTS)


_DIR = "CASE WHEN value > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction"


@query("w10_top_attributions", f"""SELECT * FROM (SELECT user_id, feature, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank, {_DIR} FROM contrib) WHERE rank <= 5""")
def w10(spark, d):
    return O.attribution(M.linear_attribution(T.feature_table(spark, d), WEIGHTS), "user_id", k=5)


@query("w10_waterfall", f"""SELECT user_id, feature, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank, {_DIR},
  0.5::DOUBLE AS base_value, {r('0.5 + sum(value) OVER (PARTITION BY user_id)', 6)} AS final_prediction FROM contrib""")
def w10_waterfall(spark, d):
    long = M.linear_attribution(T.feature_table(spark, d), WEIGHTS)
    return O.waterfall(long, "user_id", F.lit(0.5)).withColumn("final_prediction", rnd("final_prediction", 6))
