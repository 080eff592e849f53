"""Outcome statistics of balance paths: any long table (path_id, day, balance)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fintrail.functions import constants as K
from fintrail.functions.keyed import order_statistics, quantiles
from fintrail.functions.numeric import clip, rnd

c = F.col


def early_warning(paths: DataFrame, monthly_emi: float, horizons: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Share of paths that fall below half the monthly instalment before each horizon."""
    theta = 0.5 * monthly_emi
    per = paths.groupBy("path_id").agg(*[F.min(F.when(c("day") < h, c("balance"))).alias(f"m{h}") for h in horizons])
    hit = lambda h: F.avg(F.coalesce((c(f"m{h}") < theta).cast("int"), F.lit(0)))
    return per.agg(*[rnd(hit(h), 4).alias(f"ews_{h}d") for h in horizons])


def early_warning_per_path(paths: DataFrame, monthly_emi: float, horizons: Sequence[int] = (14, 30)) -> DataFrame:
    """Share of days below the threshold before each horizon, per path."""
    theta = 0.5 * monthly_emi
    return paths.groupBy("path_id").agg(*[
        rnd(F.coalesce(F.avg(F.when(c("day") < h, (c("balance") < theta).cast("int"))), F.lit(0.0)), 4).alias(f"ews_{h}d") for h in horizons])


def daily_burn(paths: DataFrame, days: int = 30) -> DataFrame:
    """Mean fall of the balance a day over the first days of each path; 0.0 where it rises or has one day."""
    ends = paths.where(c("day") < days).groupBy("path_id").agg(
        F.min_by("balance", "day").alias("b0"), F.max_by("balance", "day").alias("b1"), (F.max("day") - F.min("day")).alias("n"))
    fall = F.when(c("n") > 0, (c("b0") - c("b1")) / c("n"))
    return ends.select("path_id", rnd(F.greatest(F.coalesce(fall, F.lit(0.0)), F.lit(0.0)), 2).alias("avg_daily_burn"))


def value_at_risk(paths: DataFrame, cash0: float, confidence: float = 0.95) -> DataFrame:
    """Order statistic of the largest drawdown, and the mean from there on."""
    loss = paths.groupBy("path_id").agg((F.lit(cash0) - F.min("balance")).alias("loss"))
    stat = order_statistics(loss, [], "loss", {"var": F.floor(F.lit(confidence) * c("n"))})
    above = loss.crossJoin(F.broadcast(stat)).agg(                       # one row
        F.first("n").alias("n"), F.first("var").alias("var"), F.count_if(c("loss") > c("var")).alias("k"),
        F.coalesce(F.sum(F.when(c("loss") > c("var"), c("loss"))), F.lit(0.0)).alias("s"))
    tail = c("n") - F.floor(F.lit(confidence) * c("n"))
    return above.select(rnd("var", 2).alias("var"), rnd((c("s") + c("var") * (tail - c("k"))) / tail, 2).alias("cvar"))


FAN = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def fan_chart(paths: DataFrame, approximate: bool = False) -> DataFrame:
    """Percentiles of the balance per day, exact unless asked otherwise."""
    if approximate:
        q = paths.groupBy("day").agg(F.percentile_approx("balance", list(FAN.values()), 10_000).alias("q"))
        return q.select("day", *[rnd(c("q")[i], 2).alias(n) for i, n in enumerate(FAN)])
    q = quantiles(paths, ["day"], "balance", FAN)
    return q.select("day", *[rnd(n, 2).alias(n) for n in FAN])


def horizon_snapshots(paths: DataFrame, days: Sequence[int], cash0: float, monthly_emi: float, threshold: float) -> DataFrame:
    """At each horizon: share defaulted so far, mean day of first shortage, mean change.

    A horizon beyond the table's last day looks at that day. The mean day is null where no path falls short, and also
    where all of them do on day 0.
    """
    theta = 0.5 * monthly_emi
    last = paths.agg(F.max("day").alias("last"))                                    # one row
    spot = lambda x: F.least(F.lit(x - 1), c("last"))
    per = paths.crossJoin(F.broadcast(last)).groupBy("path_id").agg(
        F.min(F.when(c("balance") < threshold, c("day"))).alias("d0"), F.min(F.when(c("balance") < theta, c("day"))).alias("d1"),
        *[F.max(F.when(c("day") == spot(x), c("balance"))).alias(f"at_{x}") for x in days])
    out = None
    for x in days:
        r = per.agg(F.lit(x).alias("horizon"),
                    rnd(F.avg(F.coalesce((c("d0") <= x - 1).cast("int"), F.lit(0))), 4).alias("default_probability"),
                    rnd(F.nullif(F.avg(F.when(c("d1") <= x - 1, c("d1"))), F.lit(0.0)), 1).alias("shortage_day_mean"),
                    rnd(F.avg(c(f"at_{x}") - cash0), 2).alias("delta_mean"))
        out = r if out is None else out.unionByName(r)
    return out


def final_delta(paths: DataFrame, cash0: float) -> DataFrame:
    last = paths.groupBy("path_id").agg((F.max_by("balance", "day") - cash0).alias("delta"))
    q = quantiles(last, [], "delta", {"p10": 0.10, "p50": 0.50, "p90": 0.90})
    return (q.crossJoin(F.broadcast(last.agg(F.avg("delta").alias("mean"))))       # one row
            .select(rnd("mean", 2).alias("mean"), *[rnd(n, 2).alias(n) for n in ("p10", "p50", "p90")]))


def first_passage(paths: DataFrame, monthly_emi: float) -> DataFrame:
    """Days until the balance first falls short: mean and whole-day percentiles."""
    hit = (paths.where(c("balance") < 0.5 * monthly_emi).groupBy("path_id").agg(F.min("day").cast("double").alias("d")))
    q = quantiles(hit, [], "d", {"p10": 0.10, "p50": 0.50, "p90": 0.90})
    return (q.crossJoin(F.broadcast(hit.agg(F.avg("d").alias("mean"))))            # one row
            .select(rnd("mean", 1).alias("mean"), *[F.floor(rnd(n, 6)).cast("int").alias(n) for n in ("p10", "p50", "p90")]))


def default_share(paths: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Share of paths that ever reach the threshold (equality counts)."""
    per = paths.groupBy("path_id").agg(F.min("balance").alias("m"))
    return per.agg(rnd(F.avg((c("m") <= threshold).cast("int")), 4).alias("default_probability"))


def regime_shares(regimes: DataFrame) -> DataFrame:
    return regimes.agg(*[rnd(F.avg((c("regime") == r).cast("int")), 4).alias(r.lower()) for r in K.REGIMES])


def stage_shares(stages: DataFrame, due_dates: int = 1) -> DataFrame:
    """Share of paths reaching each stage, and the scaled mean stage."""
    return stages.agg(*[rnd(F.avg((c("stage") >= s).cast("int")), 4).alias(f"stage{s}") for s in (1, 2, 3, 4)],
                      rnd(F.avg("stage") / (4.0 * max(due_dates, 1)), 4).alias("stress_score"))


def risk_series(fan: DataFrame, days: int = 30) -> DataFrame:
    """Projected risk: how far the median has fallen from its first value."""
    w = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)     # one row per day
    first = F.first("p50").over(w)
    start = F.when(first > 0, first)
    return (fan.withColumn("risk", rnd(clip(1.0 - c("p50") / F.greatest(F.abs(start), F.lit(1.0)), 0, 1), 4))
            .withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("day"))).where(c("_i") <= days)
            .select("day", "risk"))


def reweight(paths: DataFrame, observations: DataFrame) -> DataFrame:
    """Balances after an observed inflow, damped towards it.

    observations(path_id, obs_day, inflow, expected).
    """
    j = paths.join(observations, "path_id", "left")
    fade = 1.0 / (1.0 + (c("day") - c("obs_day")) * 0.02)
    factor = 1.0 + (c("inflow") / c("expected") - 1.0) * fade * 0.3
    on = (c("day") >= c("obs_day")) & (c("inflow") > 0) & (c("expected") > 0)
    return j.select("path_id", "day", rnd(F.when(on, c("balance") * factor).otherwise(c("balance")), 4).alias("balance"))


# ---------------------------------------------------------------- scenarios

def scenario_intervals(spark: SparkSession, chosen: Sequence[str], horizon: int, start_day: int = 0) -> DataFrame:
    """Active intervals of atomic, compound and cascading scenarios. A few rows per scenario."""
    rows = []
    for s in chosen:
        parts = (K.CASCADING_SCENARIOS.get(s) or [(a, 0) for a in K.COMPOUND_SCENARIOS.get(s, [s])])
        for order, (atomic, offset) in enumerate(parts):
            inc, ess, disc, miss, once, days, permanent, ramp, target = K.ATOMIC_SCENARIOS[atomic]
            lo = start_day + offset
            hi = min(horizon if permanent else lo + days, horizon)
            rows.append((s, order, lo, hi, days, float(inc), float(ess), float(disc), float(miss), float(once), ramp, float(target)))
    return spark.createDataFrame(rows, "scenario string, part int, start_day int, end_day int, days int, income double, essential double, "
                                       "discretionary double, miss double, once double, ramp int, target double")


def scenario_days(intervals: DataFrame) -> DataFrame:
    """Multipliers per scenario and day: reductions take the minimum, uplifts the maximum."""
    spread = intervals.where("end_day > start_day").withColumn("day", F.explode(F.sequence(c("start_day"), c("end_day") - 1)))
    since = c("day") - c("start_day") - c("ramp")
    ramped = c("income") + (c("target") - c("income")) * F.least(since / F.greatest(c("days") - c("ramp"), F.lit(1)), F.lit(1.0))
    spread = spread.withColumn("income", F.when((c("ramp") >= 0) & (since >= 0), ramped).otherwise(c("income")))

    def fold(n):
        # at most one entry per scenario part
        items = F.array_sort(F.collect_list(F.struct("part", c(n).alias("m"))))
        return F.aggregate(items, F.lit(1.0), lambda a, x: F.when(F.abs(x["m"] - 1.0) <= 1e-9, a)
                           .when(x["m"] >= 1.0, F.greatest(a, x["m"])).otherwise(F.least(a, x["m"]))).alias(n)
    return spread.groupBy("scenario", "day").agg(
        fold("income"), fold("essential"), fold("discretionary"), F.sum("miss").alias("miss"),
        F.sum(F.when(c("day") == c("start_day"), c("once")).otherwise(0.0)).alias("once"))


def overlay(flows: DataFrame, spark: SparkSession, chosen: Sequence[str], horizon: int, cash0: float) -> DataFrame:
    """Balances of observed daily flows under each scenario.

    flows(path_id, day, income, essential, discretionary, emi). The scenario
    calendar has at most one row per scenario and day of the horizon.
    """
    cal = scenario_days(scenario_intervals(spark, chosen, horizon)).select(
        "scenario", "day", *[c(n).alias(f"x_{n}") for n in ("income", "essential", "discretionary", "miss", "once")])
    grid = flows.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in chosen])))
    one = lambda n: F.coalesce(c(f"x_{n}"), F.lit(1.0))
    net = (c("income") * one("income") - c("essential") * one("essential") - c("discretionary") * one("discretionary")
           - c("emi") - F.coalesce("x_once", F.lit(0.0)))
    w = W.partitionBy("scenario", "path_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    j = grid.join(F.broadcast(cal), ["scenario", "day"], "left").withColumn("net", net)
    return j.select("scenario", "path_id", "day", F.coalesce("x_miss", F.lit(0.0)).alias("miss_delta"),
                    rnd(F.lit(cash0) + F.sum("net").over(w), 2).alias("balance"))


def scenarios_of_overrides(o: DataFrame) -> DataFrame:
    """Scenario set implied by override columns, and how it combines."""
    inc = F.when(c("income_change_pct") != 0, c("income_change_pct")).otherwise(c("revenue_change_pct"))
    name = F.lower(F.coalesce("scenario_name", F.lit("")))
    first = (F.when(inc <= -45, "S_INC_DROP_50").when(inc <= -15, "S_INC_DROP_20")
             .when((inc >= 15) | (c("revenue_change_pct") >= 25) | (name == "expansion"), "S_INC_RISE_20"))
    items = F.array(first, F.when((c("expense_change_pct") >= 25) | name.isin("supply_squeeze", "gst_shock"), "S_EXP_SURGE_30"),
                    F.when(name == "gst_shock", "S_RATE_HIKE"), F.when(c("job_loss") | (name == "job_loss"), "S_JOB_LOSS"),
                    F.when(c("medical_emergency") | (name == "medical"), "S_MEDICAL"))
    out = o.withColumn("components", F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    return out.withColumn("scenario_type", F.when(F.size("components") == 0, "baseline").when(F.size("components") == 1, "atomic").otherwise("compound"))
