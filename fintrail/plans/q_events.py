"""Queries for sources, sinks, canonicalisation, classification and joins."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T_

from fintrail.functions import constants as K
from fintrail.functions.numeric import rnd
from fintrail.operators import canonical as C, classify as CL, features as FT, joins as J, neighbours as NN, ordered as O, stateful
from fintrail.plans import tables as T
from fintrail.plans.registry import query
from fintrail.plans.sql import CTES, case_map, first_match_sql, in_list, r
from fintrail.session import scratch
from fintrail.sources import readers as R, wire, writers as WR

# ------------------------------------------------------------------ sources

_BANK = T_.StructType([T_.StructField("event_id", T_.LongType()), T_.StructField("user_id", T_.LongType()),
                       T_.StructField("timestamp", T_.TimestampNTZType()), T_.StructField("amount", T_.DoubleType()),
                       T_.StructField("merchant_name", T_.StringType()), T_.StructField("channel", T_.StringType()),
                       T_.StructField("reference_id", T_.StringType())])


@query("src1_read_source", """SELECT event_id, user_id, ts AS timestamp, amount, merchant_name,
  CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN channel END AS channel,
  CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'R' || event_id END AS reference_id
  FROM ev WHERE source_provenance = 'bank_api'""")
def src1(spark, d):
    """Two chunks, the later without two of the columns."""
    path = scratch(spark, "raw")
    bank = T.raw_sources(spark, d)["bank_transactions"].select(*[f.name for f in _BANK.fields])
    old = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp_ntz")
    bank.where(old).write.parquet(f"{path}/bank_transactions_chunk_0000.parquet")
    bank.where(~old).drop("channel", "reference_id").write.parquet(f"{path}/bank_transactions_chunk_0001.parquet")
    return R.read_source(spark, path, "bank_transactions", _BANK)


STORE = ["income_30d", "cash_buffer_days", "gst_30d_value", "ewb_30d_value"]


@query("src2_read_features", f"""SELECT f.user_id, '2024-01-31' AS run_date, CAST(anomaly_flag AS INTEGER) AS anomaly_flag, {r('income_30d', 1)} AS income_30d,
  {r('CAST(CAST(cash_buffer_days AS FLOAT) AS DOUBLE)', 2)} AS cash_buffer_days, {r('coalesce(CAST(CAST(g.gst AS FLOAT) AS DOUBLE), 0)', 0)} AS gst_30d_value
  FROM fx f LEFT JOIN (SELECT user_id, {r('gst', 2)} AS gst FROM fx_gst WHERE compliance >= 0.3) g USING (user_id)""")
def src2(spark, d):
    """Only reliable filers have the invoice feature; for the others it reads back as 0."""
    path = scratch(spark, "store")
    fv = FT.account_features(T.ev(spark, d), T.REF)
    gst = FT.invoice_features(T.invoices(spark, d)).where("gst_filing_compliance_rate >= 0.3")
    out = fv.select("user_id", "income_30d", "cash_buffer_days", "anomaly_flag").join(
        gst.select("user_id", "gst_30d_value"), "user_id", "left")
    WR.write_features(out, path, "2024-01-31")
    back = R.read_features(spark, path, WR.compact_types(out).withColumn("run_date", F.lit("")).schema, "2024-01-31")
    return back.select("user_id", F.col("run_date").cast("string").alias("run_date"), "anomaly_flag",
                       F.round(F.col("income_30d").cast("double"), 1).alias("income_30d"),
                       rnd(F.col("cash_buffer_days").cast("double"), 2).alias("cash_buffer_days"),
                       F.round(F.col("gst_30d_value").cast("double"), 0).alias("gst_30d_value"))


@query("src3_recent_transactions", """SELECT event_id, user_id, ts, amount FROM ev WHERE user_id IN
  (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) ORDER BY ts DESC, event_id DESC LIMIT 50""")
def src3(spark, d):
    ids = T.profiles(spark, d).where(F.col("income_band") == "low")
    return R.recent_transactions(T.ev(spark, d), ids, 50).select("event_id", "user_id", "ts", "amount")


@query("snk1_write_features", f"""SELECT user_id, run_date, {r('CAST(CAST(cash_buffer_days AS FLOAT) AS DOUBLE)', 2)} AS cash_buffer_days,
  CAST(anomaly_flag AS INTEGER) AS anomaly_flag FROM fx, (VALUES ('2024-01-30'), ('2024-01-31')) v(run_date)""")
def snk1(spark, d):
    """Two appended runs, as they lie in the store."""
    path = scratch(spark, "store")
    fv = FT.account_features(T.ev(spark, d), T.REF)
    for run in ("2024-01-30", "2024-01-31"):
        WR.write_features(fv, path, run)
    return spark.read.parquet(path).select("user_id", F.col("run_date").cast("string").alias("run_date"),
                                           rnd(F.col("cash_buffer_days").cast("double"), 2).alias("cash_buffer_days"), "anomaly_flag")


_COH = [f"{m}_{n}" for n in FT.COHORT_FEATURES.values() for m in ("mean", "std")]


@query("snk2_write_cohorts", f"SELECT cohort_key, n_users, {', '.join(_COH)} FROM cohorts")
def snk2(spark, d):
    path = scratch(spark, "cohorts")
    WR.write_cohorts(FT.cohort_stats(T.feature_table(spark, d)), path)
    return spark.read.parquet(path).select("cohort_key", "n_users", *_COH)


@query("snk3_wire_round_trip", """SELECT event_id, user_id, ts, amount, status, failed FROM
  (SELECT event_id, user_id, ts, amount, status, status = 'FAILED' AS failed FROM ev WHERE k <> 7)""")
def snk3(spark, d):
    """Rows whose amount text is spoilt (k = 7) end in the rejected table."""
    e = T.ev(spark, d).select("event_id", "user_id", "ts", "amount", "status", "k",
                              (F.col("status") == "FAILED").alias("failed"))
    w = wire.encode_wire(e)
    w = w.withColumn("amount", F.when(F.col("k") == "7", "n/a").otherwise(F.col("amount"))).drop("k")
    good, _ = wire.decode_wire(w, e.drop("k").schema, ["event_id", "user_id", "ts"])
    return good


# --------------------------------------------------------- canonicalisation

_CAN = """SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, ts, amount,
  CASE WHEN source_provenance = 'open_banking_aa' THEN 'AA_BALANCE_SNAPSHOT' ELSE merchant_name END AS merchant_name,
  CASE source_provenance WHEN 'bank_api' THEN channel WHEN 'upi_api' THEN 'UPI' WHEN 'emi_statement' THEN 'EMI' ELSE 'OTHER' END AS channel,
  CASE source_provenance WHEN 'bank_api' THEN round(amount + 1000, 2) WHEN 'open_banking_aa' THEN round(amount + 2000, 2) END AS balance_after,
  CASE source_provenance WHEN 'bank_api' THEN 'R' || event_id WHEN 'upi_api' THEN substr(CAST(event_id AS VARCHAR), 1, 8) END AS reference_id,
  source_provenance, status, source_provenance = 'emi_statement' AS recurrence_flag FROM ev"""


@query("can1_canonicalise", _CAN)
def can1(spark, d):
    return (C.canonicalise(T.raw_sources(spark, d)).withColumn("event_id", F.col("event_id").cast("string"))
            .withColumn("balance_after", F.round("balance_after", 2)))


@query("can2_status_map", f"""SELECT event_id, {case_map('lower(raw)', K.STATUS_MAP, "'SUCCESS'")} AS status FROM (
  SELECT event_id, list_extract(['Success', 'PENDING', 'failed', 'Failed_Technical', 'failed_funds', 'ACTIVE', 'paid',
    'Overdue', 'cancelled', 'weird'], k % 10 + 1) AS raw FROM ev)""")
def can2(spark, d):
    raws = ["Success", "PENDING", "failed", "Failed_Technical", "failed_funds", "ACTIVE", "paid", "Overdue", "cancelled", "weird"]
    return T.ev(spark, d).select("event_id", C.status(T._pick(F.col("k"), raws)).alias("status"))


@query("can3_slim_union", """SELECT user_id, ts,
  CASE source_provenance WHEN 'open_banking_aa' THEN 0.0 WHEN 'sms_parser' THEN -1.0 ELSE amount END AS amount,
  CASE source_provenance WHEN 'open_banking_aa' THEN 'AA_BALANCE_SNAPSHOT' WHEN 'sms_parser' THEN 'SMS_FAILURE_ALERT' ELSE merchant_name END AS merchant_name,
  CASE source_provenance WHEN 'open_banking_aa' THEN 'SUCCESS' ELSE status END AS status,
  CASE source_provenance WHEN 'emi_statement' THEN 'EMI_PAYMENT' WHEN 'open_banking_aa' THEN 'OTHER' WHEN 'sms_parser' THEN 'EXPENSE_ESSENTIAL' ELSE '' END AS transaction_type,
  CASE source_provenance WHEN 'emi_statement' THEN 'EMI' ELSE 'OTHER' END AS merchant_category
  FROM ev WHERE source_provenance IN ('bank_api', 'upi_api', 'emi_statement', 'open_banking_aa')
    OR (source_provenance = 'sms_parser' AND status = 'FAILED')""")
def can3(spark, d):
    return C.slim_union(T.raw_sources(spark, d))


@query("can4_fallback_type", """SELECT event_id, CASE WHEN transaction_type <> '' THEN transaction_type WHEN amount > 0 THEN 'INCOME'
  WHEN upper(merchant_name) LIKE '%EMI%' OR upper(merchant_name) LIKE '%LOAN%' THEN 'EMI_PAYMENT' ELSE 'EXPENSE_ESSENTIAL' END AS transaction_type
  FROM (SELECT event_id, amount, merchant_name, CASE WHEN k % 4 = 0 THEN transaction_type ELSE '' END AS transaction_type FROM merchant_ev)""")
def can4(spark, d):
    e = T.merchant_texts(spark, d).withColumn("transaction_type", F.when(F.col("k") % 4 == 0, F.col("transaction_type")).otherwise(""))
    return C.fill_type(e).select("event_id", "transaction_type")


@query("can5_deduplicate", "SELECT event_id, user_id, ts, amount FROM ev")
def can5(spark, d):
    """The whole table with every third event delivered twice."""
    e = T.ev(spark, d)
    return C.deduplicate(e.unionByName(e.where(F.col("k") % 3 == 0))).select("event_id", "user_id", "ts", "amount")


@query("can6_validate", f"""SELECT event_id, k % 11 <> 0 AND k % 13 <> 0 AS valid FROM ev""")
def can6(spark, d):
    """Rows with an unknown status or category go to quarantine."""
    e = (T.ev(spark, d).withColumn("status", F.when(F.col("k") % 11 == 0, "MAYBE").otherwise(F.col("status")))
         .withColumn("merchant_category", F.when(F.col("k") % 13 == 0, "GADGETS").otherwise(F.col("merchant_category"))))
    good, bad = C.validate(e)
    return good.select("event_id", F.lit(True).alias("valid")).unionByName(bad.select("event_id", F.lit(False).alias("valid")))


@query("can7_resolve_entities", """SELECT 'upi' || c_custkey AS identifier, array_to_string(list_sort(
  [CAST(c_custkey AS VARCHAR), 'G' || c_custkey, 'vpa' || c_custkey, 'upi' || c_custkey]), ',') AS ids FROM customer
  UNION ALL SELECT 'x' || c_custkey, 'x' || c_custkey FROM customer""")
def can7(spark, d):
    p = T.profiles(spark, d)
    ask = p.select(F.col("upi_id").alias("identifier")).unionByName(
        p.select(F.concat(F.lit("x"), "user_id").alias("identifier")))
    return C.resolve_entities(ask, p).select("identifier", F.array_join("ids", ",").alias("ids"))


# ----------------------------------------------------------- classification

_CAT = first_match_sql("merchant_name", K.MERCHANT_RULES, "NULL")


@query("cls1_merchant_rules", f"SELECT event_id, {_CAT} AS category FROM merchant_ev")
def cls1(spark, d):
    return T.merchant_texts(spark, d).select("event_id", CL.merchant_category(F.col("merchant_name")).alias("category"))


_TYPE = case_map("coalesce(cat, 'OTHER')", K.CATEGORY_TYPE, "'OTHER'")


@query("cls2_category_type", f"""SELECT event_id, CASE WHEN amount > 0 AND typ NOT IN ({in_list(K.SIGN_KEEPS_TYPE)}) THEN 'INCOME' ELSE typ END AS transaction_type
  FROM (SELECT *, {_TYPE} AS typ FROM (SELECT *, {_CAT} AS cat FROM merchant_ev))""")
def cls2(spark, d):
    return CL.enrich(T.merchant_texts(spark, d)).select("event_id", "transaction_type")


_ANCHOR = """unit AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (
    SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)),
  mean AS (SELECT label, i, avg(x) AS x FROM unit GROUP BY label, i),
  anc AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM mean),
  score AS (SELECT u.vec_id, a.label, sum(u.x * a.x) AS s FROM unit u JOIN anc a USING (i) GROUP BY u.vec_id, a.label)"""


@query("cls3_nearest_anchor", f"""WITH {_ANCHOR} SELECT vec_id, CASE WHEN s >= 0.5 THEN CAST(label AS VARCHAR) ELSE 'OTHER' END AS category,
  CASE WHEN s >= 0.5 THEN {r('s')} ELSE 0.5 END AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) AS rn FROM score) WHERE rn = 1""")
def cls3(spark, d):
    v = T.table(spark, d, "embeddings")
    return CL.nearest_anchor(v, CL.anchors(v), "vec_id")


@query("cls4_recurrence", "SELECT event_id, source_provenance = 'emi_statement' AS recurrence_flag FROM ev")
def cls4(spark, d):
    return T.ev(spark, d).select("event_id", CL.recurring(F.col("source_provenance")).alias("recurrence_flag"))


@query("cls5_intents", f"""SELECT message_id, {first_match_sql('text', K.CHAT_INTENT_RULES, "'general'")} AS chat_intent,
  {first_match_sql('text', K.NEGOTIATION_RULES, "'clarify'")} AS negotiation_intent FROM messages""")
def cls5(spark, d):
    return T.messages(spark, d).select("message_id", CL.chat_intent(F.col("text")).alias("chat_intent"),
                                       CL.negotiation_intent(F.col("text")).alias("negotiation_intent"))


@query("cls6_message_fields", f"""SELECT message_id, CASE WHEN regexp_matches(lower(text), '{K.YES_WORDS}') THEN TRUE
    WHEN regexp_matches(lower(text), '{K.NO_WORDS}') THEN FALSE END AS answer,
  [TRY_CAST(replace(s, ',', '') AS DOUBLE) FOR s IN regexp_extract_all(text, '{K.AMOUNT_PATTERN}', 1)] AS amounts,
  regexp_extract_all(lower(text), '{K.TIME_PATTERN}', 1) AS time_refs FROM messages""")
def cls6(spark, d):
    return T.messages(spark, d).select("message_id", *CL.message_fields(F.col("text")))


# -------------------------------------------------------------------- joins

@query("j1_peer_deviation", "SELECT user_id, peer_cohort_benchmark_deviation FROM fv")
def j1(spark, d):
    fv = T.feature_table(spark, d).drop("peer_cohort_benchmark_deviation")
    return FT.peer_deviation(fv, FT.cohort_stats(fv)).select("user_id", "peer_cohort_benchmark_deviation")


@query("j2_counterparties", """SELECT event_id, user_id, p.c_custkey AS counterparty FROM ev
  JOIN customer p ON 'upi' || (event_id % 150) = 'upi' || p.c_custkey WHERE source_provenance = 'upi_api'""")
def j2(spark, d):
    upi = T.raw_sources(spark, d)["upi_transactions"]
    return J.counterparties(upi, T.profiles(spark, d)).select("event_id", "user_id", "counterparty")


@query("j3_flagged_users", """SELECT event_id, user_id, amount FROM ev WHERE user_id IN
  (SELECT c_custkey FROM customer WHERE c_custkey % 36 <= 6)""")
def j3(spark, d):
    new = T.profiles(spark, d).where("months_active <= 6")
    return J.of_users(T.ev(spark, d), new).select("event_id", "user_id", "amount")


@query("j5_near_income", """SELECT event_id, EXISTS (SELECT 1 FROM inc WHERE inc.user_id = s.user_id
    AND abs(date_diff('day', inc.d, CAST(s.ts AS DATE))) <= 3) AS near_income
  FROM (SELECT * FROM ev WHERE transaction_type = 'EXPENSE_DISCRETIONARY') s""",
       inc="SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM ev WHERE transaction_type = 'INCOME'")
def j5(spark, d):
    e = T.ev(spark, d)
    return J.near_days(e.where("transaction_type = 'EXPENSE_DISCRETIONARY'"), e.where("transaction_type = 'INCOME'")
                       ).select("event_id", "near_income")


@query("j7_calendar", """SELECT c.user_id, CAST(c.day AS DATE) AS day, coalesce(x.n, 0) AS n, coalesce(x.net, 0) AS net FROM (
    SELECT user_id, unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS day FROM ev GROUP BY user_id) c
  LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(amount), 2) AS net FROM ev GROUP BY 1, 2) x
    ON x.user_id = c.user_id AND x.day = CAST(c.day AS DATE)""")
def j7(spark, d):
    daily = T.ev(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("net"))
    return J.calendar(daily, ["user_id"], "day", ["n", "net"])


@query("j10_nearest_vectors", """SELECT q, b, round(s, 4) + 0 AS similarity, CAST(rn AS INTEGER) AS rn FROM (
  SELECT q.vec_id AS q, b.vec_id AS b, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS rn
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id) WHERE rn <= 5""")
def j10(spark, d):
    v = T.table(spark, d, "embeddings")
    top = NN.nearest(v.select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("v")),
                     v.select(F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("v")), 5, exclude_self=True)
    return top.select("q", "b", F.round("similarity", 4).alias("similarity"), "rn")


@query("j10_nearest_probed")
def j10_probed(spark, d):
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    top = NN.nearest_probed(v.withColumnRenamed("vec_id", "q"), v.withColumnRenamed("vec_id", "b"), 5, exclude_self=True)
    return top.select("q", "b", F.round("similarity", 4).alias("similarity"), "rn")


@query("r5_vector_similarity", """SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0 AS cosine,
  round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0 AS euclidean
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def r5(spark, d):
    from fintrail.functions.numeric import cosine, euclidean
    v = T.table(spark, d, "embeddings")
    o = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return v.join(o, "vec_id").select("vec_id", "other", F.round(cosine(F.col("embedding"), F.col("e2")), 4).alias("cosine"),
                                      F.round(euclidean(F.col("embedding"), F.col("e2")), 4).alias("euclidean"))


# ------------------------------------------------------- ordered operators

@query("w1_interval_regularity", f"""SELECT user_id, n AS events, CASE WHEN ok THEN {r('sd / (mean + 1e-9)')} ELSE 1.0 END AS interval_cv,
  CASE WHEN ok THEN {r('sd / (mean + 1e-9)')} < 0.05 ELSE FALSE END AS regular_flag FROM (
  SELECT user_id, count(*) AS n, avg(g) AS mean, stddev_samp(g) AS sd, count(*) >= 5 AND max(g) > 0 AS ok FROM (
    SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS g FROM ev) GROUP BY user_id)""")
def w1(spark, d):
    return O.interval_regularity(T.ev(spark, d))


@query("w2_rolling_flags", """SELECT event_id, user_id, ts, status = 'FAILED' AS failed,
  n >= 10 AND (amt - mu) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END > 3 AS amount_flag, burst > 5 AS burst_flag FROM (
  SELECT event_id, user_id, ts, status, abs(amount) AS amt, count(*) OVER w AS n, avg(abs(amount)) OVER w AS mu,
    stddev_samp(abs(amount)) OVER w AS sd,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS burst
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))""")
def w2(spark, d):
    return O.rolling_flags(T.ev(spark, d))


CTES["in_order"] = "SELECT event_id, user_id, abs(amount) AS amt, epoch_us(ts) AS t, status = 'FAILED' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev"
CTES["checked"] = """/*RECURSIVE*/SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, FALSE AS flag, []::DOUBLE[] AS amts, []::BIGINT[] AS times FROM in_order
  UNION ALL SELECT user_id, n, event_id, flag, CASE WHEN flag THEN amts ELSE list_append(amts, amt)[-200:] END, CASE WHEN flag THEN times ELSE list_append(times, t)[-50:] END FROM (
    SELECT o.user_id, o.n, o.event_id, o.amt, o.t, s.amts, s.times, o.f
      OR (len(s.amts) >= 10 AND (o.amt - list_avg(s.amts)) / CASE WHEN list_stddev_samp(s.amts) > 1e-9 THEN list_stddev_samp(s.amts) ELSE 1.0 END > 3.0)
      OR len([x FOR x IN s.times IF x >= o.t - 3600000000]) > 5 AS flag
    FROM checked s JOIN in_order o ON o.user_id = s.user_id AND o.n = s.n + 1)"""
STATEFUL = "SELECT event_id, user_id, coalesce(flag, FALSE) AS anomaly_flag FROM checked WHERE n > 0"


@query("w3_stateful_flags", STATEFUL)
def w3(spark, d):
    return stateful.stateful_flags(T.ev(spark, d))


_NORM = " UNION ALL ".join(
    f"SELECT user_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {r(f'({f} - {m}) / {s}', 3)} AS z_score FROM fv"
    for f, (m, s) in K.FEATURE_NORMS.items())


@query("w11_most_anomalous", f"""SELECT * FROM (SELECT user_id, feature, value, z_score,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(z_score) DESC, feature) AS INTEGER) AS anomaly_rank
  FROM ({_NORM})) WHERE anomaly_rank <= 5""")
def w11(spark, d):
    return O.most_anomalous(T.feature_table(spark, d), K.FEATURE_NORMS)


# --------------------------------------------------------- sort, top-k, sets

@query("t1_newest_per_user", """SELECT event_id, user_id, ts, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev
  WHERE transaction_type = 'EXPENSE_DISCRETIONARY') WHERE rn <= 5""")
def t1(spark, d):
    return O.newest(T.ev(spark, d), 5, F.col("transaction_type") == "EXPENSE_DISCRETIONARY").select("event_id", "user_id", "ts", "rn")


@query("t2_retention_trim", """SELECT event_id, user_id FROM (SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn <= 50""")
def t2(spark, d):
    return O.newest(T.ev(spark, d), 50).select("event_id", "user_id")


@query("t6_diagonal_union", """SELECT event_id, amount, channel, NULL::DOUBLE AS balance FROM ev WHERE source_provenance = 'bank_api'
  UNION ALL SELECT event_id, amount, NULL, round(amount + 2000, 2) FROM ev WHERE source_provenance = 'open_banking_aa'""")
def t6(spark, d):
    s = T.raw_sources(spark, d)
    a = s["bank_transactions"].select("event_id", "amount", "channel")
    b = s["open_banking"].select("event_id", "amount", F.round("balance_after", 2).alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("t7_symmetric_difference", """SELECT user_id, count(*) AS changed FROM (
  SELECT user_id, merchant_category FROM ev GROUP BY 1, 2
  HAVING bool_or(ts < TIMESTAMP '2024-01-16') <> bool_or(ts >= TIMESTAMP '2024-01-16')) GROUP BY user_id""")
def t7(spark, d):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    g = T.ev(spark, d).groupBy("user_id").agg(
        F.collect_set(F.when(late, F.col("merchant_category"))).alias("a"),
        F.collect_set(F.when(~late, F.col("merchant_category"))).alias("b"))
    n = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    return g.select("user_id", n.cast("long").alias("changed")).where("changed > 0")
