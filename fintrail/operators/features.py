"""Behavioural features.

Events are reduced once to one row per (user, day); everything that does not
need merchants or categories is computed from those rows. The first shuffle
therefore carries user-days rather than events, partial aggregation absorbs hot
users, and all later windows are bounded by the number of days.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fintrail.session import cut, written
from fintrail.functions.numeric import (DAY_MICROS, LN2, age_days, clip, day_number, decay, micros,
                                        month_index, ntz, ratio, rnd, zsum)

SPEND = ["EXPENSE_ESSENTIAL", "EXPENSE_DISCRETIONARY", "EMI_PAYMENT"]
HALF_LIFE = 30.0


def _months_back(ref: datetime) -> tuple[datetime, datetime]:
    """First of the month before ref's month, and first of the month before that."""
    cur = (ref.replace(day=1, hour=0, minute=0, second=0, microsecond=0) - timedelta(days=1)).replace(day=1)
    prev = (cur - timedelta(days=1)).replace(day=1)
    return cur, prev


def in_window(ts: Column, ref: datetime, days: int, bounded: bool = True) -> Column:
    c = ts >= ntz(ref - timedelta(days=days))
    return c & (ts <= ntz(ref)) if bounded else c


PART_ROWS = 50_000             # events whose users one task of the per-user steps takes


def user_parts(ev: DataFrame) -> int:
    """Into how many parts the users of these events go, so that a task's share stays the same whatever the table's size."""
    rows = ev.count()
    return max(1, -(-rows // PART_ROWS), min(ev.sparkSession.sparkContext.defaultParallelism, rows // 5_000))


def by_user(df: DataFrame, parts: int | None) -> DataFrame:
    """Rows of a user in one of `parts` tasks; without a number, as the next step places them."""
    return df if parts is None else df.repartition(parts, "user_id")


# ---------------------------------------------------------------- user-days

def by_day(ev: DataFrame, parts: int | None) -> DataFrame:
    """Events with their `day`, those of one user and day in one of `parts` tasks.

    The wide sums of a user's days are then made where the narrow events lie: hardly any two rows of a scan share a day,
    so sums made there first would hold nearly all of a split's days at once and pass the shuffle wide.
    """
    e = ev.withColumn("day", F.to_date("ts"))
    return e if parts is None else e.repartition(parts, "user_id", "day")


def user_days(ev: DataFrame, ref: datetime, bounded: bool = True, parts: int | None = None) -> DataFrame:
    """One row per (user, day) with every additive measure the features need."""
    ts, amt, typ, st = F.col("ts"), F.col("amount"), F.col("transaction_type"), F.col("status")
    cur, prev = _months_back(ref)
    floor_ts = min(ref - timedelta(days=90), prev)
    e = ev.where(ts >= ntz(floor_ts))
    if bounded:
        e = e.where(ts <= ntz(ref))
    w = {n: ts >= ntz(ref - timedelta(days=n)) for n in (7, 30, 90)}
    disc = typ == "EXPENSE_DISCRETIONARY"
    sums = []
    for name, t in (("income", "INCOME"), ("essential", "EXPENSE_ESSENTIAL"),
                    ("disc", "EXPENSE_DISCRETIONARY"), ("emi", "EMI_PAYMENT"), ("subs", "SUBSCRIPTION")):
        for n in (7, 30, 90):
            sums.append(F.sum(F.when(w[n] & (typ == t), amt)).alias(f"{name}_{n}"))
    late = F.dayofmonth(ts) >= 25
    kind = F.col("txn_kind") if "txn_kind" in ev.columns else F.lit(None).cast("string")
    moment = _moment()
    return (by_day(e, parts).groupBy("user_id", "day").agg(
        *sums,
        *[F.count_if(w[n]).alias(f"n_{n}") for n in (7, 30, 90)],
        F.sum(F.when(w[30], F.abs(amt) * decay(ts, ref, HALF_LIFE))).alias("decayed"),
        F.sum(F.when(w[30], decay(ts, ref, HALF_LIFE))).alias("decayed_n"),
        F.count_if(w[90] & (amt < 0)).alias("n_out"),
        F.count_if(w[90] & (amt < 0) & (st == "FAILED")).alias("n_out_failed"),
        F.count_if(w[90] & (st == "FAILED")).alias("n_failed"),
        F.sum(F.when(w[90] & (F.col("merchant_category") == "CASH_ATM"), F.abs(amt))).alias("cash"),
        F.sum(F.when(w[90] & (amt < 0), -amt)).alias("outflow"),
        F.count_if(w[90] & (typ == "INCOME")).alias("n_income"),
        F.sum(F.when(w[90] & (typ == "INCOME"), amt * amt)).alias("income_sq"),
        F.count_if(w[30] & (typ == "SUBSCRIPTION")).alias("n_subs"),
        F.count_if(w[90] & (typ == "EMI_PAYMENT")).alias("n_emi"),
        F.sum(F.when(w[90] & typ.isin(SPEND) & (amt < 0), -amt)).alias("spend"),
        F.sum(F.when(w[90] & late, amt)).alias("late_net"),
        F.sum(F.when(w[90] & ~late, amt)).alias("early_net"),
        F.count_if(w[30] & (amt > 0)).alias("n_in"),
        F.count_if(w[30] & (amt > 0) & (kind == "P2M")).alias("n_in_p2m"),
        F.sum(F.when(w[30] & (amt > 0), amt * decay(ts, ref, HALF_LIFE))).alias("in_decayed"),
        F.max_by(F.when(w[90] & disc, F.abs(amt)), F.when(w[90] & disc, moment)).alias("disc_last"),
        F.sum(F.when(disc & (ts >= ntz(cur)) & (ts < ntz(ref)), F.abs(amt))).alias("disc_cur"),
        F.sum(F.when(disc & (ts >= ntz(prev)) & (ts < ntz(cur)), F.abs(amt))).alias("disc_prev"),
    ))


def _moment() -> Column:
    """Order of a day's events: of equal times the largest event_id is last.

    A fixed-width key keeps the aggregation hash-based; a struct would make it sort all events.
    """
    return (F.pmod(micros(F.col("ts")), F.lit(DAY_MICROS)).cast("decimal(12,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)")
            + F.col("event_id").cast("decimal(20,0)")).cast("decimal(38,0)")


def near_income(days: DataFrame, reach: int = 3) -> DataFrame:
    """Marks days within `reach` days of a day with income."""
    w = W.partitionBy("user_id").orderBy("dn").rangeBetween(-reach, reach)
    return (days.withColumn("dn", day_number(F.col("day")))
            .withColumn("near_income", F.max(F.col("n_income") > 0).over(w)))


def _cv(n: Column, mean: Column, std: Column) -> Column:
    return F.when((n < 2) | (mean == 0), F.lit(0.0)).otherwise(std / F.abs(mean))


def stability(n_rows: Column, n: Column, total: Column, sq: Column) -> Column:
    """1 - CV of income amounts from count, sum and sum of squares."""
    mean = total / n
    var = F.greatest(F.lit(0.0), (sq - total * total / n) / (n - 1))
    return (F.when(n_rows == 0, F.lit(0.5)).when(n == 0, F.lit(0.3)).when(n == 1, F.lit(0.8))
            .otherwise(clip(1.0 - _cv(n, mean, F.sqrt(var)), 0.0, 1.0)))


def mean_dip(late: Column, early: Column, month: Column, prefix: str = "") -> list[Column]:
    """Aggregates for the month-end dip.

    A 90-day window touches at most four calendar months, so month index modulo 4
    identifies a month and the two-level grouping becomes conditional sums.
    """
    out = []
    for k in range(4):
        m = month % 4 == k
        out += [F.sum(F.when(m, late)).alias(f"{prefix}late{k}"),
                F.sum(F.when(m, early)).alias(f"{prefix}early{k}")]
    return out


def dip_value(prefix: str = "") -> Column:
    both, total = F.lit(0), F.lit(0.0)
    for k in range(4):
        l, e = F.col(f"{prefix}late{k}"), F.col(f"{prefix}early{k}")
        ok = l.isNotNull() & e.isNotNull()
        both = both + ok.cast("int")
        total = total + F.when(ok, l - e).otherwise(0.0)
    return F.when(both > 0, total / both).otherwise(0.0)


def account_features(ev: DataFrame, ref: datetime, bounded: bool = True, parts: int | None = None) -> DataFrame:
    """All scalar features that need neither merchants nor categories."""
    return _of_days(by_user(user_days(ev, ref, bounded, parts), parts))


def _of_days(days: DataFrame) -> DataFrame:
    d = near_income(days)
    keys = [f"{n}_{w}" for n in ("income", "essential", "disc", "emi", "subs") for w in (7, 30, 90)]
    near, far = F.col("near_income"), ~F.col("near_income")
    u = d.groupBy("user_id").agg(
        *[rnd(F.abs(zsum(F.col(k))), 2).alias(k) for k in keys],
        *[F.sum(c).alias(c) for c in ("n_7", "n_30", "n_90", "n_out", "n_out_failed", "n_failed",
                                      "n_income", "n_subs", "n_emi", "n_in", "n_in_p2m")],
        F.sum("in_decayed").alias("inbound_decayed"),
        *[zsum(F.col(c)).alias(c) for c in ("decayed", "decayed_n", "income_sq")],
        *[rnd(zsum(F.col(c)), 2).alias(c) for c in ("cash", "outflow", "disc_cur", "disc_prev")],
        F.count("spend").alias("spend_days"), F.avg("spend").alias("spend_mean"),
        F.stddev_samp("spend").alias("spend_std"),
        F.avg(F.when(near, F.col("disc_last"))).alias("spike_near"),
        F.avg(F.when(far, F.col("disc_last"))).alias("spike_far"),
        *mean_dip(F.col("late_net"), F.col("early_net"), month_index(F.col("day"))),
    )
    share = rnd(ratio(F.col("n_in_p2m"), F.col("n_in")), 4).alias("upi_p2m_ratio_30d")
    return u.select("user_id", *_scalars(), F.col("n_90").alias("event_count_90d"), share, "inbound_decayed")


# ------------------------------------------- the same from a state of days

_MONEY = {"income": "INCOME", "essential": "EXPENSE_ESSENTIAL", "disc": "EXPENSE_DISCRETIONARY", "emi": "EMI_PAYMENT",
          "subs": "SUBSCRIPTION"}
_SUMS = [*_MONEY, "faded", "faded_n", "cash", "outflow", "income_sq", "spend", "net", "in_faded", "disc_abs"]
_COUNTS = ["n", "n_out", "n_out_failed", "n_failed", "n_income", "n_subs", "n_emi", "n_in", "n_in_p2m"]


def day_state(ev: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per (user, day) that does not depend on a reference time: what a refresh keeps instead of events.

    Weights fade to the end of the day, so that a later reference time only scales them.
    """
    ts, amt, typ, st = F.col("ts"), F.col("amount"), F.col("transaction_type"), F.col("status")
    kind = F.col("txn_kind") if "txn_kind" in ev.columns else F.lit(None).cast("string")
    fade, disc, inbound = _fade(ts, _day_end(ts)), typ == "EXPENSE_DISCRETIONARY", amt > 0
    return by_day(ev, parts).groupBy("user_id", "day").agg(
        *[F.sum(F.when(typ == t, amt)).alias(n) for n, t in _MONEY.items()],
        F.sum(F.abs(amt) * fade).alias("faded"), F.sum(fade).alias("faded_n"),
        F.sum(F.when(F.col("merchant_category") == "CASH_ATM", F.abs(amt))).alias("cash"),
        F.sum(F.when(amt < 0, -amt)).alias("outflow"), F.sum(F.when(typ == "INCOME", amt * amt)).alias("income_sq"),
        F.sum(F.when(typ.isin(SPEND) & (amt < 0), -amt)).alias("spend"), F.sum(amt).alias("net"),
        F.sum(F.when(inbound, amt * fade)).alias("in_faded"), F.sum(F.when(disc, F.abs(amt))).alias("disc_abs"),
        F.count(F.lit(1)).alias("n"), F.count_if(amt < 0).alias("n_out"),
        F.count_if((amt < 0) & (st == "FAILED")).alias("n_out_failed"), F.count_if(st == "FAILED").alias("n_failed"),
        F.count_if(typ == "INCOME").alias("n_income"), F.count_if(typ == "SUBSCRIPTION").alias("n_subs"),
        F.count_if(typ == "EMI_PAYMENT").alias("n_emi"), F.count_if(inbound).alias("n_in"),
        F.count_if(inbound & (kind == "P2M")).alias("n_in_p2m"),
        F.max_by(F.when(disc, F.abs(amt)), F.when(disc, _moment())).alias("disc_last"),
        F.max(F.when(disc, _moment())).alias("disc_at"), F.max("ts").alias("high"))


def merged_days(days: DataFrame) -> DataFrame:
    """Rows of one (user, day) from several deliveries, added up."""
    return days.groupBy("user_id", "day").agg(
        *[F.sum(x).alias(x) for x in (*_SUMS, *_COUNTS)], F.max_by("disc_last", "disc_at").alias("disc_last"),
        F.max("disc_at").alias("disc_at"), F.max("high").alias("high"))


def first_day_needed(ref: datetime) -> datetime:
    """Days before this one have left every window of `ref` and of later reference times."""
    return min(ref - timedelta(days=90), _months_back(ref)[1])


def account_features_of_days(days: DataFrame, ref: datetime) -> DataFrame:
    """`account_features` at a midnight, from rows of `day_state`."""
    if ref != ref.replace(hour=0, minute=0, second=0, microsecond=0):
        raise ValueError("days can only be taken out whole: the reference time must be a midnight")
    day, c = F.col("day").cast("timestamp_ntz"), F.col
    cur, prev = _months_back(ref)
    w = {n: day >= ntz(ref - timedelta(days=n)) for n in (7, 30, 90)}
    d = days.where((day >= ntz(first_day_needed(ref))) & (day < ntz(ref)))
    in_w = lambda n, x: F.when(w[n], c(x))                              # noqa: E731
    count = lambda n, x: F.when(w[n], c(x)).otherwise(F.lit(0))         # noqa: E731
    later = _fade(_day_end(day), ntz(ref))
    late = F.dayofmonth("day") >= 25
    return _of_days(d.select(
        "user_id", "day", *[in_w(n, m).alias(f"{m}_{n}") for m in _MONEY for n in (7, 30, 90)],
        *[count(n, "n").alias(f"n_{n}") for n in (7, 30, 90)],
        (in_w(30, "faded") * later).alias("decayed"), (in_w(30, "faded_n") * later).alias("decayed_n"),
        *[count(90, x).alias(x) for x in ("n_out", "n_out_failed", "n_failed", "n_income", "n_emi")],
        *[count(30, x).alias(x) for x in ("n_subs", "n_in", "n_in_p2m")],
        *[in_w(90, x).alias(x) for x in ("cash", "outflow", "income_sq", "spend", "disc_last")],
        F.when(w[90] & late, c("net")).alias("late_net"), F.when(w[90] & ~late, c("net")).alias("early_net"),
        (in_w(30, "in_faded") * later).alias("in_decayed"),
        F.when(day >= ntz(cur), c("disc_abs")).alias("disc_cur"),
        F.when((day >= ntz(prev)) & (day < ntz(cur)), c("disc_abs")).alias("disc_prev")))


def _scalars() -> list[Column]:
    c = F.col
    out30 = c("essential_30") + c("disc_30") + c("emi_30") + c("subs_30")
    spend90 = c("essential_90") + c("disc_90") + c("emi_90")
    burden = emi_burden()
    r = lambda e, n, name: rnd(e, n).alias(name)
    return [
        r(c("decayed") / 30.0, 4, "daily_avg_throughput_30d"),
        r(c("decayed_n"), 4, "decayed_count_30d"),
        r(F.when(out30 > 0, F.least(c("income_30") / (out30 / 30.0), F.lit(90.0))).otherwise(90.0),
          4, "cash_buffer_days"),
        r(ratio(c("n_out_failed"), c("n_out")), 4, "debit_failure_rate_90d"),
        r(dip_value(), 4, "end_of_month_liquidity_dip"),
        burden.alias("raw_emi_burden"),
        r(clip(burden, 0.0, 5.0), 4, "emi_burden_ratio"),
        r(clip(ratio(c("income_30") - c("essential_30") - c("disc_30"), c("income_30")), -1.0, 1.0),
          4, "savings_rate"),
        r(stability(c("n_90"), c("n_income"), c("income_90"), c("income_sq")), 4, "income_stability_score"),
        r(F.coalesce(_cv(c("spend_days"), c("spend_mean"), c("spend_std")), F.lit(0.0)),
          4, "spending_volatility_index"),
        r(clip(ratio(c("disc_90"), spend90), 0.0, 1.0), 4, "discretionary_ratio"),
        r(clip(ratio(c("cash"), c("outflow")), 0.0, 1.0), 4, "cash_dependency_index"),
        c("n_subs").alias("subscription_count_30d"),
        c("n_emi").alias("emi_payment_count_90d"),
        (F.coalesce(ratio(c("spike_near") - c("spike_far"), c("spike_far"), 0.0), F.lit(0.0)) > 0.25)
        .alias("salary_day_spike_flag"),
        r(clip(F.when(c("disc_prev") == 0, F.lit(0.0))
               .otherwise((c("disc_cur") - c("disc_prev")) / c("disc_prev")), -1.0, 5.0),
          4, "lifestyle_inflation_trend"),
        (c("n_failed") > 2).alias("anomaly_flag"),
        *[r(c(f"{a}_{n}"), 2, f"{b}_{n}d") for a, b in
          (("income", "income"), ("essential", "essential"), ("disc", "discretionary")) for n in (7, 30, 90)],
        r(c("emi_30"), 2, "emi_30d"), r(c("emi_90"), 2, "emi_90d"), r(c("subs_30"), 2, "subscription_30d"),
        r(c("income_7") - c("essential_7") - c("disc_7"), 2, "net_cashflow_7d"),
        r(c("income_30") - c("essential_30") - c("disc_30") - c("emi_30") - c("subs_30"),
          2, "net_cashflow_30d"),
        r(c("income_90") - c("essential_90") - c("disc_90") - c("emi_90"), 2, "net_cashflow_90d"),
        r(((c("n_7") > 0).cast("int") + (c("n_30") > 0).cast("int") + (c("n_90") > 0).cast("int")) / 3.0,
          4, "data_completeness_score"),
    ]


def emi_burden() -> Column:
    c = F.col
    income = F.when(c("income_30") > 0, c("income_30")).otherwise(
        F.greatest(c("income_90") / 3.0, F.lit(1.0)))
    return (c("emi_30") + c("subs_30")) / income


# ------------------------------------------------- merchants and categories

def top_merchants(ev: DataFrame, ref: datetime, n: int = 3, parts: int | None = None) -> DataFrame:
    """Sum of squared shares of the n largest merchants by outflow."""
    m = by_user(ev.where(in_window(F.col("ts"), ref, 90) & (F.col("amount") < 0))
                .groupBy("user_id", "merchant_name").agg(F.sum(-F.col("amount")).alias("total")), parts)
    rank = W.partitionBy("user_id").orderBy(F.desc("total"), "merchant_name")
    top = m.select("user_id", "total", F.row_number().over(rank).alias("rn"), F.sum("total").over(W.partitionBy("user_id")).alias("whole"))
    share = F.col("total") / F.col("whole")
    return (top.where((F.col("rn") <= n) & (F.col("whole") > 0) & F.col("user_id").isNotNull()).groupBy("user_id")
            .agg(rnd(clip(F.sum(share * share), 0.0, 1.0), 4).alias("top3_merchant_concentration")))


def category_shift(ev: DataFrame, ref: datetime, n: int = 5, parts: int | None = None) -> DataFrame:
    """How many top-n categories changed between the two latest 30-day buckets."""
    ts = F.col("ts")
    mid, lo = ref - timedelta(days=30), ref - timedelta(days=60)
    e = (ev.where((ts >= ntz(lo)) & (ts < ntz(ref)))
         .withColumn("current", ts >= ntz(mid)))
    spent = ~F.col("transaction_type").isin("INCOME", "TRANSFER")
    cat = by_user(e.groupBy("user_id", "current", "merchant_category")
                  .agg(F.sum(F.when(spent, F.abs("amount"))).alias("total")), parts)
    rank = W.partitionBy("user_id", "current").orderBy(F.desc_nulls_last("total"), "merchant_category")
    top = (cat.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= n)
           .groupBy("user_id").agg(
               F.collect_set(F.when(F.col("current") & F.col("total").isNotNull(), F.col("merchant_category"))).alias("a"),
               F.collect_set(F.when(~F.col("current") & F.col("total").isNotNull(), F.col("merchant_category"))).alias("b"),
               F.bool_or("current").alias("has_a"), F.bool_or(~F.col("current")).alias("has_b")))
    diff = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    return top.select("user_id", F.when(F.col("has_a") & F.col("has_b"), diff).otherwise(0)
                      .alias("merchant_category_shift_count"))


# ------------------------------------------------------- business features

def invoice_features(invoices: DataFrame, parts: int | None = None) -> DataFrame:
    """Decayed invoice value anchored at each user's latest invoice, and filing habits."""
    # values decay to the end of their day, day sums to the user's latest invoice: no weight exceeds 1
    per_day = invoices.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max("ts").alias("hi"),
        F.sum(F.col("taxable_value") * _fade(F.col("ts"), _day_end(F.col("ts")))).alias("faded"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("filing_status") == "ontime").alias("ontime"),
        F.sum("filing_delay_days").alias("delay"))
    per_day = by_user(per_day, parts).withColumn("last", F.max("hi").over(W.partitionBy("user_id")))
    return per_day.groupBy("user_id").agg(
        rnd(F.sum(F.col("faded") * _fade(_day_end(F.col("hi")), F.col("last"))), 2).alias("gst_30d_value"),
        rnd(F.sum("ontime") / F.sum("n"), 4).alias("gst_filing_compliance_rate"),
        F.count_distinct(F.trunc("day", "month")).cast("int").alias("months_active_gst"),
        rnd(F.greatest(F.lit(0.0), 1.0 - F.least(F.sum("delay") / F.sum("n") / 30.0, F.lit(1.0))), 4)
        .alias("statutory_payment_regularity_score"))


def _day_end(ts: Column) -> Column:
    return F.date_add(F.to_date(ts), 1).cast("timestamp_ntz")


def _fade(ts: Column, anchor: Column) -> Column:
    """Decay weight of `ts` as seen from `anchor`."""
    return F.exp(F.lit(LN2 / HALF_LIFE) * (micros(ts) - micros(anchor)) / F.lit(float(DAY_MICROS)))


def eway_features(eway: DataFrame, parts: int | None = None) -> DataFrame:
    """Decayed consignment value and entropy of commodity codes."""
    user = W.partitionBy("user_id")
    per_day = eway.where("user_id is not null").groupBy("user_id", "main_hsn_code", F.to_date("ts").alias("day")).agg(
        F.max("ts").alias("hi"), F.sum(F.col("tot_inv_value") * _fade(F.col("ts"), _day_end(F.col("ts")))).alias("faded"),
        F.count(F.lit(1)).alias("n"))
    per_day = by_user(per_day, parts).withColumn("last", F.max("hi").over(user))
    by_code = per_day.groupBy("user_id", "main_hsn_code").agg(
        F.sum("n").alias("n"), F.sum(F.col("faded") * _fade(_day_end(F.col("hi")), F.col("last"))).alias("value"))
    p = F.col("n") / F.col("rows")
    return by_code.withColumn("rows", F.sum("n").over(user)).groupBy("user_id").agg(
        rnd(F.sum("value"), 2).alias("ewb_30d_value"),
        rnd(-F.sum(p * F.log(p + 1e-9)), 4).alias("hsn_entropy_90d"))


def receivables_gap(invoiced: Column, inbound: Column) -> Column:
    return F.when((invoiced > 0) & inbound.isNotNull(), rnd((invoiced - inbound) / invoiced, 4)).otherwise(0.0)


# ------------------------------------------------------------------ cohorts

def income_band(income_90d: Column) -> Column:
    return F.when(income_90d > 100_000, "high").when(income_90d > 30_000, "mid").otherwise("low")


COHORT = ["income_band", "city_tier", "age_group"]
COHORT_FEATURES = {"emi_burden_ratio": "emi_burden", "savings_rate": "savings_rate",
                   "spending_volatility_index": "spending_volatility",
                   "cash_buffer_days": "cash_buffer", "income_stability_score": "income_stability"}


def cohort_stats(fv: DataFrame) -> DataFrame:
    aggs = []
    for col, name in COHORT_FEATURES.items():
        aggs.append(rnd(F.avg(col), 4).alias(f"mean_{name}"))
        std = F.coalesce(F.stddev_samp(col), F.lit(1.0))
        aggs.append(rnd(F.greatest(std, F.lit(1e-6)), 4).alias(f"std_{name}"))
    return (fv.groupBy(*COHORT).agg(F.count(F.lit(1)).alias("n_users"), *aggs)
            .withColumn("cohort_key", F.concat_ws("_", *COHORT)))


def peer_deviation(fv: DataFrame, cohorts: DataFrame, value: str = "raw_emi_burden") -> DataFrame:
    """z-score of the instalment burden in the user's cohort; 0.0 where none applies.

    The cohort table holds one row per (band, tier, age) - at most a few hundred
    rows by construction of its key - so it is broadcast.
    """
    c = cohorts.select(*COHORT, "mean_emi_burden", "std_emi_burden")
    z = (F.col(value) - F.col("mean_emi_burden")) / F.col("std_emi_burden")
    return (fv.join(F.broadcast(c), COHORT, "left")
            .withColumn("peer_cohort_benchmark_deviation",
                        F.when(F.col("std_emi_burden") > 0, rnd(z, 4)).otherwise(0.0))
            .drop("mean_emi_burden", "std_emi_burden"))


# ------------------------------------------------------------- full vectors

DEFAULTS = {
    "top3_merchant_concentration": 0.0, "merchant_category_shift_count": 0,
    "gst_30d_value": 0.0, "gst_filing_compliance_rate": 0.0, "months_active_gst": 0,
    "statutory_payment_regularity_score": 0.0, "ewb_30d_value": 0.0, "hsn_entropy_90d": 0.0,
}


def features(ev: DataFrame, ref: datetime, *, invoices: DataFrame | None = None,
             eway: DataFrame | None = None, profiles: DataFrame | None = None,
             cohorts: DataFrame | None = None) -> DataFrame:
    """One wide row per user at `ref`.

    Every part is keyed by user_id and one row per user, and is stored before the
    parts are joined over tasks whose number grows with the events: in one stage
    the sorts and hash tables of all parts would hold memory at the same time.
    Invoices and consignments of users without events enter no vector and are left
    out before they are grouped. Cohort statistics are taken from the vectors
    themselves unless given.
    """
    parts, users = user_parts(ev), ev.select("user_id").distinct()
    fv = by_user(written(account_features(ev, ref, parts=parts), "part"), parts)
    sides = [top_merchants(ev, ref, parts=parts), category_shift(ev, ref, parts=parts)]
    if invoices is not None:
        sides.append(invoice_features(invoices.join(users, "user_id", "left_semi"), parts))
    if eway is not None:
        sides.append(eway_features(eway.join(users, "user_id", "left_semi"), parts))
    for side in sides:
        fv = fv.join(by_user(written(side, "part"), parts), "user_id", "left")
    filled = [(F.coalesce(F.col(n), F.lit(v)) if n in fv.columns else F.lit(v)).alias(n) for n, v in DEFAULTS.items()]
    plain = [c for c in fv.columns if c not in DEFAULTS and c != "inbound_decayed"]
    gap = (receivables_gap(F.col("gst_30d_value"), F.col("inbound_decayed")) if invoices is not None else F.lit(0.0))
    fv = fv.select(*plain, *filled, gap.alias("gst_upi_receivables_gap"),
                   F.lit(0.0).alias("temporal_anomaly_flag"), ntz(ref).alias("ref"))
    if profiles is not None:
        fv = fv.join(profiles, "user_id", "left")
        if cohorts is None:
            # read twice below; one row per user, so writing it beats scanning the events again
            fv = cut(fv)
            cohorts = cohort_stats(fv)
        fv = peer_deviation(fv, cohorts)
    return fv


# ------------------------------------------------------ one vector per day

def daily_features(ev: DataFrame) -> DataFrame:
    """Feature vectors at the end of every active day of every user.

    A vector's window is taken over user-day rows, so no event is repeated for
    the 90 days it counts in.
    """
    ts, amt, typ, st = F.col("ts"), F.col("amount"), F.col("transaction_type"), F.col("status")
    day = F.to_date("ts")
    types = (("income", "INCOME"), ("essential", "EXPENSE_ESSENTIAL"), ("disc", "EXPENSE_DISCRETIONARY"),
             ("emi", "EMI_PAYMENT"), ("subs", "SUBSCRIPTION"))
    late = F.dayofmonth(ts) >= 25
    d = ev.groupBy("user_id", day.alias("day")).agg(
        *[F.sum(F.when(typ == t, amt)).alias(n) for n, t in types],
        F.sum(F.abs(amt) * _fade(ts, _day_end(ts))).alias("faded"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(amt < 0).alias("out"), F.count_if((amt < 0) & (st == "FAILED")).alias("out_failed"),
        F.count_if(st == "FAILED").alias("failed"),
        F.sum(F.when(F.col("merchant_category") == "CASH_ATM", F.abs(amt))).alias("cash_amt"),
        F.sum(F.when(amt < 0, -amt)).alias("out_amt"),
        F.count_if(typ == "INCOME").alias("inc_n"),
        F.sum(F.when(typ == "INCOME", amt * amt)).alias("inc_sq"),
        F.count_if(typ == "SUBSCRIPTION").alias("subs_n"), F.count_if(typ == "EMI_PAYMENT").alias("emi_n"),
        F.sum(F.when(typ.isin(SPEND) & (amt < 0), -amt)).alias("spend"),
        F.sum(F.when(late, amt)).alias("late_net"), F.sum(F.when(~late, amt)).alias("early_net"),
        F.sum(F.when(typ == "EXPENSE_DISCRETIONARY", F.abs(amt))).alias("disc_abs"),
    ).withColumn("dn", day_number(F.col("day"))).withColumn("mi", month_index(F.col("day")))

    # A trailing sum is the difference of two growing sums, each of constant cost per row;
    # a sliding frame would add up its 90 days again for every row and measure.
    for k in range(4):
        m = F.col("mi") % 4 == k
        d = d.withColumns({f"late_{k}": F.when(m, F.col("late_net")), f"early_{k}": F.when(m, F.col("early_net")),
                           f"late_n_{k}": (m & F.col("late_net").isNotNull()).cast("int"),
                           f"early_n_{k}": (m & F.col("early_net").isNotNull()).cast("int")})
    # Half-lives of days are numbered, and values grow within theirs only: no weight passes 2, whatever the date.
    # The 30 days before a day lie in at most two neighbouring half-lives, told apart by their parity.
    part = F.floor(F.col("dn") / int(HALF_LIFE))
    grown = F.col("faded") * F.pow(F.lit(2.0), F.pmod(F.col("dn"), F.lit(int(HALF_LIFE))) / HALF_LIFE)
    d = d.withColumns({"odd": F.pmod(part, F.lit(2)) == 1})
    d = d.withColumns({"grown_odd": F.when(F.col("odd"), grown).otherwise(0.0), "grown_even": F.when(F.col("odd"), 0.0).otherwise(grown)})
    d = d.withColumns({"spend_n": F.col("spend").isNotNull().cast("int"), "spend_sq": F.col("spend") * F.col("spend")})
    months = [f"{x}_{k}" for k in range(4) for x in ("late", "early", "late_n", "early_n")]
    need = {7: [n for n, _ in types] + ["n"], 30: [n for n, _ in types] + ["n", "subs_n"],
            90: [n for n, _ in types] + ["n", "out", "out_failed", "failed", "cash_amt", "out_amt", "inc_n", "inc_sq", "emi_n",
                                         "spend", "spend_n", "spend_sq", *months]}
    user = W.partitionBy("user_id").orderBy("dn")
    grow = lambda c, to: F.coalesce(F.sum(c).over(user.rangeBetween(W.unboundedPreceding, to)), F.lit(0))
    every = sorted({c for cs in need.values() for c in cs})
    month = W.partitionBy("user_id").orderBy("mi")
    month_total = lambda back: F.coalesce(F.sum("disc_abs").over(month.rangeBetween(-back, -back)), F.lit(0.0))
    running = F.coalesce(F.sum("disc_abs").over(
        W.partitionBy("user_id", "mi").orderBy("dn").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    d = d.select("user_id", "day", "mi", *[grow(c, 0).alias(f"{c}@0") for c in every],
                 *[grow(c, -n).alias(f"{c}@{n}") for n, cs in need.items() for c in cs],
                 *[F.sum(x).over(user.rangeBetween(-29, 0)).alias(x) for x in ("grown_odd", "grown_even")], "dn", "odd",
                 month_total(0).alias("m0"), month_total(1).alias("m1"), month_total(2).alias("m2"), running.alias("run"))
    tot = lambda c, n: F.col(f"`{c}@0`") - F.col(f"`{c}@{n}`")
    rolls = month_index(F.date_add("day", 1)) != F.col("mi")
    cents = lambda c, n: rnd(tot(c, n), 2)
    n_sp, s_sp = tot("spend_n", 90), cents("spend", 90)
    var = F.greatest(F.lit(0.0), (tot("spend_sq", 90) - s_sp * s_sp / n_sp) / (n_sp - 1))
    cols = [rnd(F.abs(tot(n, w)), 2).alias(f"{n}_{w}") for n, _ in types for w in (7, 30, 90)]
    cols += [tot("n", w).alias(f"n_{w}") for w in (7, 30, 90)]
    same = F.when(F.col("odd"), F.col("grown_odd")).otherwise(F.col("grown_even"))
    before = F.when(F.col("odd"), F.col("grown_even")).otherwise(F.col("grown_odd"))
    decayed = (same + before / 2.0) / F.pow(F.lit(2.0), F.pmod(F.col("dn"), F.lit(int(HALF_LIFE))) / HALF_LIFE)
    cols += [decayed.alias("decayed"), F.lit(0.0).alias("decayed_n"),
             tot("out", 90).alias("n_out"), tot("out_failed", 90).alias("n_out_failed"), tot("failed", 90).alias("n_failed"),
             cents("cash_amt", 90).alias("cash"), cents("out_amt", 90).alias("outflow"), tot("inc_n", 90).alias("n_income"),
             tot("inc_sq", 90).alias("income_sq"), tot("subs_n", 30).alias("n_subs"), tot("emi_n", 90).alias("n_emi"),
             n_sp.alias("spend_days"), F.when(n_sp > 0, s_sp / n_sp).alias("spend_mean"), F.when(n_sp > 1, F.sqrt(var)).alias("spend_std"),
             F.lit(None).cast("double").alias("spike_near"), F.lit(None).cast("double").alias("spike_far"),
             rnd(F.when(rolls, F.col("m0")).otherwise(F.col("m1") + F.col("run")), 2).alias("disc_cur"),
             rnd(F.when(rolls, F.col("m1")).otherwise(F.col("m2")), 2).alias("disc_prev")]
    for k in range(4):
        cols += [F.when(tot(f"{x}_n_{k}", 90) > 0, cents(f"{x}_{k}", 90)).alias(f"{x}{k}") for x in ("late", "early")]
    return (d.select("user_id", "day", *cols)
            .select("user_id", F.date_add("day", 1).cast("timestamp_ntz").alias("ts"), *_scalars())
            .drop("salary_day_spike_flag", "decayed_count_30d"))


# -------------------------------------------------- stand-alone operators

def decayed_count(ev: DataFrame, ref: datetime, half_life: float = HALF_LIFE, days: int = 30) -> DataFrame:
    e = ev.where(in_window(F.col("ts"), ref, days))
    return e.groupBy("user_id").agg(
        rnd(F.sum(decay(F.col("ts"), ref, half_life)), 4).alias("decayed_count"))


def window_summary(ev: DataFrame, ref: datetime) -> DataFrame:
    """Trailing 7/30/90-day summaries by whole-day age, with a map of category totals."""
    age = F.floor(age_days(F.col("ts"), ref))
    e = ev.where((F.col("ts") <= ntz(ref)) & (age <= 90)).withColumn("age", age)
    typ, amt = F.col("transaction_type"), F.col("amount")
    by_cat = e.groupBy("user_id", "merchant_category").agg(
        *[F.sum(F.when((F.col("age") <= w) & (typ == t), amt if t == "INCOME" else F.abs(amt))).alias(f"{n}_{w}")
          for n, t in _SUMMARY for w in (7, 30, 90)],
        *[F.count_if(F.col("age") <= w).alias(f"n_{w}") for w in (7, 30, 90)],
        *[F.sum(F.when(F.col("age") <= w, F.abs(amt))).alias(f"abs_{w}") for w in (7, 30, 90)])
    cols = []
    for w in (7, 30, 90):
        parts = {n: zsum(F.col(f"{n}_{w}")) for n, _ in _SUMMARY}
        cols += [rnd(parts[n], 2).alias(f"{n}_{w}d") for n in parts]
        cols.append(rnd(parts["total_income"] - parts["total_essential"] - parts["total_discretionary"]
                            - parts["emi"] - parts["subscription"], 2).alias(f"net_cashflow_{w}d"))
        cols.append(F.sum(f"n_{w}").alias(f"event_count_{w}d"))
        cols.append(F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col(f"n_{w}") > 0, F.struct("merchant_category", rnd(f"abs_{w}", 2).alias("v"))))))
            .alias(f"category_breakdown_{w}d"))
    return by_cat.groupBy("user_id").agg(*cols)


_SUMMARY = (("total_income", "INCOME"), ("total_essential", "EXPENSE_ESSENTIAL"),
            ("total_discretionary", "EXPENSE_DISCRETIONARY"), ("emi", "EMI_PAYMENT"),
            ("subscription", "SUBSCRIPTION"))


def spend_mix(ev: DataFrame, ref: datetime, categories: list[str]) -> DataFrame:
    """Share of spend per category over 30 and 90 days, one column each."""
    e = ev.where(in_window(F.col("ts"), ref, 90) & (F.col("amount") < 0))
    w30 = F.col("ts") >= ntz(ref - timedelta(days=30))
    sums = []
    for c in categories:
        hit = F.col("merchant_category") == c
        sums += [zsum(F.when(hit & w30, -F.col("amount"))).alias(f"a_{c}"),
                 zsum(F.when(hit, -F.col("amount"))).alias(f"b_{c}")]
    t = e.groupBy("user_id").agg(*sums, zsum(F.when(w30, -F.col("amount"))).alias("ta"),
                                 F.sum(-F.col("amount")).alias("tb"))
    return t.select("user_id", *[ratio(F.col(f"a_{c}"), F.col("ta")).alias(f"mix30_{c}") for c in categories],
                    *[ratio(F.col(f"b_{c}"), F.col("tb")).alias(f"mix90_{c}") for c in categories])
