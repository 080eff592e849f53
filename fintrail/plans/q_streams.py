"""Queries that run the streaming operators over the event table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fintrail.operators.trailing import KINDS, event_summaries
from fintrail.plans import tables as T
from fintrail.plans.q_events import STATEFUL
from fintrail.plans.q_risk import consent
from fintrail.plans.registry import query
from fintrail.plans.sql import CTES, _derived_sql, _parts, derive_sql, first_match_sql, in_list, case_map, r
from fintrail.functions import constants as K
from fintrail.functions.numeric import ntz
from fintrail.schemas import EVENTS_TABLE
from fintrail.session import scratch
from fintrail.streaming import streams as S

c = F.col


def raw_stream(spark, d):
    return S.read_stream(spark, d, EVENTS_TABLE, glob="events.parquet")


def ev_stream(spark, d):
    return T.as_events(raw_stream(spark, d))


def collect(spark, stream, name, mode="append"):
    """Runs a stream into a table and reads it back."""
    out = scratch(spark, name)
    S.run_available(stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: S.put(df, f"{out}/t", i)), f"{out}/c")
    return spark.read.parquet(f"{out}/t").drop("batch_id")


@query("st1_ingest", "SELECT event_id, user_id, ts, amount, status FROM ev")
def st1(spark, d):
    out = scratch(spark, "st1")
    S.ingest(ev_stream(spark, d), f"{out}/t", f"{out}/late", f"{out}/c")
    return spark.read.parquet(f"{out}/t").select("event_id", "user_id", "ts", "amount", "status")


@query("st2_deduplicate", "SELECT event_id, user_id, ts, amount FROM ev")
def st2(spark, d):
    """Every event delivered twice."""
    src = scratch(spark, "st2")
    raw = T.table(spark, d, "events")
    raw.unionByName(raw).write.parquet(src)
    s = T.as_events(S.read_stream(spark, src, EVENTS_TABLE))
    return collect(spark, S.deduplicated(s), "st2").select("event_id", "user_id", "ts", "amount")


@query("st3_fan_out", "SELECT source_provenance, count(*) AS events, count(DISTINCT user_id) AS users FROM ev GROUP BY 1")
def st3(spark, d):
    out = scratch(spark, "st3")
    S.fan_out(ev_stream(spark, d), f"{out}/t", f"{out}/c")
    return spark.read.parquet(f"{out}/t").groupBy("source_provenance").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")).withColumn(
        "source_provenance", c("source_provenance").cast("string"))


_CAT = first_match_sql("merchant_name", K.MERCHANT_RULES, "'OTHER'")


@query("st4_enrich", f"""SELECT event_id, cat AS merchant_category, CASE WHEN amount > 0 AND typ NOT IN ({in_list(K.SIGN_KEEPS_TYPE)}) THEN 'INCOME' ELSE typ END AS transaction_type,
  source_provenance = 'emi_statement' AS recurrence_flag FROM (SELECT *, {case_map('cat', K.CATEGORY_TYPE, "'OTHER'")} AS typ FROM (SELECT *, {_CAT} AS cat FROM merchant_ev))""")
def st4(spark, d):
    s = ev_stream(spark, d).withColumn("merchant_name", T._pick(c("k"), T.MERCHANT_TEXTS))
    return collect(spark, S.enriched(s), "st4").select("event_id", "merchant_category", "transaction_type", "recurrence_flag")


def _trail_sql() -> str:
    cols = []
    for w in (7, 30, 90):
        f = f"e.ts >= g.ref - INTERVAL {w} DAY"
        cols.append(f"count(*) FILTER ({f}) AS events_{w}d")
        cols += [f"{r(f'''coalesce(sum(abs(e.amount)) FILTER ({f} AND e.transaction_type = '{t}'), 0.0)''', 2)} AS {n}_{w}d" for n, t in S.KINDS.items()]
    return f"""SELECT e.user_id, CAST(g.ref - INTERVAL 1 DAY AS DATE) AS day, {', '.join(cols)} FROM ev e JOIN dref g ON e.user_id = g.user_id
      AND e.ts < g.ref AND e.ts >= g.ref - INTERVAL 90 DAY GROUP BY e.user_id, g.ref"""


@query("st5_trailing_summary", _trail_sql())
def st5(spark, d):
    out = scratch(spark, "st5")
    S.store_buckets(ev_stream(spark, d), f"{out}/t", f"{out}/c")
    return S.trailing(spark.read.parquet(f"{out}/t"))


def _event_sql(select: str, group: str, size: int) -> str:
    return f"""SELECT {select} FROM ev e JOIN ev g ON g.user_id = e.user_id AND g.ts <= e.ts AND g.ts > e.ts - INTERVAL {size + 1} DAY GROUP BY {group}"""


def _summary_sql() -> str:
    out = []
    for n in (7, 30, 90):
        one = lambda k, x="abs(g.amount)": f"coalesce(sum({x}) FILTER (g.transaction_type = '{k}'), 0.0)"
        income, spent = one("INCOME", "g.amount"), {m: one(k) for m, k in KINDS.items()}
        cols = [f"{r(income, 2)} AS income", *[f"{r(x, 2)} AS {m}" for m, x in spent.items()], f"{r(f'{income} - ' + ' - '.join(spent.values()), 2)} AS net_cashflow",
                "count(*) AS event_count"]
        CTES[f"sum_{n}"] = _event_sql("e.event_id, e.user_id, " + ", ".join(cols), "e.event_id, e.user_id", n)
        out += [f"s{n}.{m} AS {m}_{n}d" for m in ("income", *KINDS, "net_cashflow", "event_count")]
    return f"SELECT s7.event_id, s7.user_id, {', '.join(out)} FROM sum_7 s7 JOIN sum_30 s30 USING (event_id) JOIN sum_90 s90 USING (event_id)"


@query("st5_event_summaries", _summary_sql())
def st5_events(spark, d):
    """The summary as of every event, from a stream of the event table."""
    out = scratch(spark, "st5e")
    S.summary_stream(ev_stream(spark, d), f"{out}/t", f"{out}/s", f"{out}/c")
    rows = spark.read.parquet(f"{out}/t")
    return rows.select("event_id", "user_id", *[f"{m}_{n}d" for n in (7, 30, 90) for m in ("income", *KINDS, "net_cashflow", "event_count")])


def _category_sql(n: int) -> str:
    total = r("sum(abs(g.amount))", 2)
    return "SELECT * FROM (" + _event_sql(f"e.event_id, {n} AS days, g.merchant_category AS category, {total} AS total", "e.event_id, g.merchant_category", n) + ") WHERE total <> 0"


@query("st5_event_categories", " UNION ALL ".join(_category_sql(n) for n in (7, 30, 90)))
def st5_categories(spark, d):
    """The category maps of the summaries as rows, from the stored table."""
    rows = event_summaries(T.ev(spark, d))
    entries = lambda n: F.transform(F.map_entries(f"categories_{n}d"), lambda x: F.struct(
        F.lit(n).alias("days"), x["key"].alias("category"), x["value"].alias("total")))
    each = F.explode(F.flatten(F.array(*[entries(n) for n in (7, 30, 90)])))
    return rows.select("event_id", each.alias("x")).select("event_id", "x.*")


@query("st6_stateful_flags", STATEFUL)
def st6(spark, d):
    out = scratch(spark, "st6")
    S.flag_stream(ev_stream(spark, d), f"{out}/t", f"{out}/s", f"{out}/c")
    return spark.read.parquet(f"{out}/t").drop("batch_id")


# ------------------------------------------- refresh over three deliveries

CUTS = [datetime(2024, 1, 11), datetime(2024, 1, 21), datetime(2024, 1, 31)]
CTES["sref"] = " UNION ALL ".join(f"SELECT DISTINCT user_id, TIMESTAMP '{b}' AS ref FROM ev WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}'"
                                  for a, b in zip([datetime(2024, 1, 1), *CUTS], CUTS))
_parts("sx", "ev e JOIN sref g ON e.user_id = g.user_id AND e.ts >= g.ref - INTERVAL 90 DAY AND e.ts < g.ref", "ev e JOIN sref g ON e.user_id = g.user_id")
CTES["sx"] = _derived_sql("sx_base", "sx_cv", "sx_dip", "sx_life", None)
CTES["sstate"] = derive_sql("sx")


def refreshed(spark, d):
    """Events delivered in three slices, one batch each; the last holds all that is left."""
    def build(s, p):
        out = scratch(s, "refresh")
        raw = T.table(s, p, "events")
        newest = raw.agg(F.max("ts")).first()[0]
        cuts = [*CUTS[:-1], max(CUTS[-1], datetime(newest.year, newest.month, newest.day) + timedelta(days=1)) if newest else CUTS[-1]]
        slices = [raw.where(c("ts") < ntz(cuts[0])),
                  *[raw.where((c("ts") >= ntz(lo)) & (c("ts") < ntz(hi))) for lo, hi in zip(cuts, cuts[1:])]]
        for i, part in enumerate(slices):
            part.write.parquet(f"{out}/src/slice={i}")
            stream = T.as_events(S.read_stream(s, f"{out}/src/*", EVENTS_TABLE, files_per_batch=1_000_000))
            S.refresh(stream, f"{out}/h", f"{out}/f", f"{out}/t", f"{out}/c", lambda high: next(x for x in cuts if x > high))
        return s.read.parquet(f"{out}/t")
    return T.stored(spark, d, "refreshed", build)


@query("st7_feature_refresh", "SELECT user_id, ref AS ts, cash_buffer_days, emi_burden_ratio, income_30d, event_count_90d FROM sx")
def st7(spark, d):
    return refreshed(spark, d).select("user_id", "ts", "cash_buffer_days", "emi_burden_ratio", "income_30d", "event_count_90d")


@query("st8_twin_update", "SELECT user_id, ref AS ts, risk_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ref) AS INTEGER) AS version FROM sstate")
def st8(spark, d):
    return refreshed(spark, d).select("user_id", "ts", "risk_score", "version")


@query("st9_patch", """SELECT user_id, CAST(version + 1 AS INTEGER) AS version, 20.0::DOUBLE AS cash_buffer_days, liquidity_health, 0 AS delivery
  FROM twin_latest WHERE cash_buffer_days > 20
  UNION ALL SELECT user_id, CAST(version + CASE WHEN cash_buffer_days > 20 THEN 2 ELSE 1 END AS INTEGER), CASE WHEN cash_buffer_days > 20 THEN 20.0 ELSE cash_buffer_days END,
    'LOW', 1 FROM twin_latest WHERE liquidity_health <> 'LOW'""")
def st9(spark, d):
    """Two deliveries of patches: buffers are capped at 20 days, then all users are marked LOW. Users whose material fields stay get no version."""
    out = scratch(spark, "st9")
    t = T.twin_latest(spark, d).select("user_id", "version", "cash_buffer_days", "liquidity_health")
    S.seed_latest(t, f"{out}/latest")
    nothing = F.lit(None).cast("string")
    parts = [t.select("user_id", F.lit(0).alias("seq"), F.least("cash_buffer_days", F.lit(20.0)).alias("cash_buffer_days"), nothing.alias("liquidity_health")),
             t.select("user_id", F.lit(1).alias("seq"), F.lit(None).cast("double").alias("cash_buffer_days"), F.lit("LOW").alias("liquidity_health"))]
    for i, part in enumerate(parts):
        part.write.parquet(f"{out}/src/s={i}")
        stream = S.read_stream(spark, f"{out}/src/*", part.schema, files_per_batch=1_000_000)
        S.patch_stream(stream, f"{out}/latest", f"{out}/v", f"{out}/c", ["cash_buffer_days", "liquidity_health"], ["seq"])
    return spark.read.parquet(f"{out}/v").select("user_id", "version", "cash_buffer_days", "liquidity_health", c("batch_id").cast("int").alias("delivery"))


@query("st11_notifications", "SELECT user_id, version, trigger_type, priority, relevance, channel FROM sent")
def st11(spark, d):
    out = scratch(spark, "st11")
    snaps = T.twin(spark, d)
    snaps.write.parquet(f"{out}/src")
    stream = S.read_stream(spark, f"{out}/src", snaps.schema)
    S.notify(stream, consent(spark, d), f"{out}/sent", f"{out}/esc", f"{out}/h", f"{out}/c", personalization=0.9, acceptance=0.8)
    return spark.read.parquet(f"{out}/sent").select("user_id", "version", "trigger_type", "priority", "relevance", "channel")


@query("st12_retention", "SELECT event_id, user_id, ts FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 15 DAY")
def st12(spark, d):
    out = scratch(spark, "st12")
    S.ingest(ev_stream(spark, d), f"{out}/t", f"{out}/late", f"{out}/c")
    S.retain(spark, f"{out}/t", timedelta(days=15))
    return spark.read.parquet(f"{out}/t").select("event_id", "user_id", "ts")
