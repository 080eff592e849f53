"""Versioned user state: derivation, snapshots, time travel."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fintrail.functions import constants as K
from fintrail.functions.keyed import carry_forward
from fintrail.functions.numeric import DAY_MICROS, clip, micros, ntz, rnd, sigmoid
from fintrail.operators.features import daily_features
from fintrail.session import cut

MATERIAL = ["risk_score", "liquidity_health", "liquidity_health_index", "income_stability",
            "spending_volatility", "cash_buffer_days", "emi_burden_ratio",
            "credit_dependency_score", "peer_deviation_score", "persona"]


# ---------------------------------------------------------------- derivation

def liquidity(buffer: Column) -> Column:
    return F.when(buffer < 5, "LOW").when(buffer <= 15, "MEDIUM").otherwise("HIGH")


def liquidity_index(buffer: Column, failure: Column) -> Column:
    return clip(0.8 * clip(buffer / 30.0, 0, 1) + 0.2 * (1.0 - clip(failure, 0, 1)), 0, 1)


def income_stability(score: Column, volatility: Column) -> Column:
    return clip(0.6 * score + 0.4 * (1.0 - F.least(volatility, F.lit(1.0))), 0, 1)


def credit_dependency(burden: Column, cash: Column, subs: Column) -> Column:
    return clip(0.45 * F.least(burden, F.lit(1.2)) / 1.2 + 0.35 * clip(cash, 0, 1)
                + 0.20 * F.least(subs / 12.0, F.lit(1.0)), 0, 1)


def risk_score() -> Column:
    """Eight weighted terms, squashed to (0, 1)."""
    c = F.col
    raw = (0.25 * F.least(c("emi_burden_ratio"), F.lit(2.0)) / 2.0
           + 0.20 * c("debit_failure_rate_90d")
           + 0.15 * F.least(c("spending_volatility_index"), F.lit(3.0)) / 3.0
           + 0.10 * F.least(c("end_of_month_liquidity_dip"), F.lit(50_000.0)) / 50_000.0
           + 0.05 * c("discretionary_ratio") + 0.05 * c("cash_dependency_index")
           - 0.15 * F.greatest(c("savings_rate"), F.lit(0.0)) - 0.05 * c("income_stability_score"))
    return rnd(sigmoid(clip(raw * 6.0 - 3.0, -6, 6)), 6)


def derive(fv: DataFrame) -> DataFrame:
    """State columns of a feature table."""
    c = F.col
    peer = c("peer_cohort_benchmark_deviation") if "peer_cohort_benchmark_deviation" in fv.columns else F.lit(0.0)
    return fv.withColumns({
        "liquidity_health": liquidity(c("cash_buffer_days")),
        "liquidity_health_index": rnd(liquidity_index(c("cash_buffer_days"), c("debit_failure_rate_90d")), 6),
        "income_stability": rnd(income_stability(c("income_stability_score"), c("spending_volatility_index")), 6),
        "spending_volatility": F.least(c("spending_volatility_index"), F.lit(1.0)),
        "risk_score": risk_score(),
        "credit_dependency_score": rnd(credit_dependency(c("emi_burden_ratio"), c("cash_dependency_index"),
                                                         c("subscription_count_30d")), 6),
        "peer_deviation_score": clip(peer, -3, 3),
    })


def display_score(risk: Column) -> Column:
    """300-900 score, rounding halves to even."""
    return F.bround(900 - risk * 600, 0).cast("int")


def bureau_score(p: Column) -> Column:
    return clip(F.floor(900 - p * 600), 300, 900).cast("int")


def persona_candidate(top3: Column) -> Column:
    """Persona of the first conclusive rule, null where none is."""
    c = F.col
    return (F.when((top3 > 0.80) & (c("debit_failure_rate_90d") > 0.30)
                   & (c("daily_avg_throughput_30d") > 100_000), "shell_circular")
            .when((c("spending_volatility_index") > 1.5) & (c("daily_avg_throughput_30d") > 50_000)
                  & (c("income_stability_score") < 0.4), "paper_trader")
            .when((c("income_90d") < 30_000) & (c("emi_payment_count_90d") == 0)
                  & (c("daily_avg_throughput_30d") < 2_000), "new_to_credit")
            .when((c("emi_burden_ratio") > 0.55) & (c("savings_rate") < 0.05), "genuine_struggling"))


def carry_persona(snaps: DataFrame, candidate: str = "candidate") -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return snaps.withColumn("persona", F.coalesce(F.last(candidate, ignorenulls=True).over(w),
                                                  F.lit("genuine_healthy")))


def _gated_top3(ev: DataFrame, snaps: DataFrame) -> DataFrame:
    """Merchant concentration for the few snapshots whose persona depends on it.

    Events meet only snapshots whose 90 days reach into their stretch of 90 days, so
    about every other joined pair passes the time filter, however long the history is.
    """
    stretch = lambda ts: F.floor(micros(ts) / (90 * DAY_MICROS))
    gate = snaps.where((F.col("debit_failure_rate_90d") > 0.30)
                       & (F.col("daily_avg_throughput_30d") > 100_000)).select("user_id", F.col("ts").alias("ref"))
    last = stretch(F.col("ref"))
    gate = gate.withColumn("stretch", F.explode(F.array(last - 1, last)))
    m = (ev.where("amount < 0").select("user_id", "ts", "merchant_name", "amount", stretch(F.col("ts")).alias("stretch")).join(gate, ["user_id", "stretch"])
         .where((F.col("ts") < F.col("ref")) & (F.col("ts") >= F.col("ref") - F.expr("INTERVAL 90 DAYS")))
         .groupBy("user_id", "ref", "merchant_name").agg(F.sum(-F.col("amount")).alias("t")))
    w = W.partitionBy("user_id", "ref").orderBy(F.desc("t"), "merchant_name")
    top = m.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    whole = m.groupBy("user_id", "ref").agg(F.sum("t").alias("whole"))
    s = F.col("t") / F.col("whole")
    return (top.join(whole, ["user_id", "ref"]).groupBy("user_id", F.col("ref").alias("ts"))
            .agg(F.sum(s * s).alias("top3")))


def snapshots(ev: DataFrame) -> DataFrame:
    """One state version per active user-day."""
    # read twice below; a row per user-day is far smaller than the events behind it
    s = cut(derive(daily_features(ev)))
    s = s.join(_gated_top3(ev, s), ["user_id", "ts"], "left")
    s = s.withColumn("candidate", persona_candidate(F.coalesce("top3", F.lit(0.0)))).drop("top3")
    return versioned(carry_persona(s).drop("candidate"))


def versioned(snaps: DataFrame) -> DataFrame:
    return snaps.withColumn("version", F.row_number().over(W.partitionBy("user_id").orderBy("ts")))


def regime(buffer: Column, burden: Column, failure: Column, overdue: Column | None = None) -> Column:
    od = overdue if overdue is not None else F.lit(0)
    return (F.when((buffer < 5) | (burden > 0.55) | (od >= 2), "CRISIS")
            .when((buffer < 15) | burden.between(0.35, 0.55) | (failure > 0.08), "STRESSED")
            .otherwise("STABLE"))


# ---------------------------------------------------------- behaviour vector

def _matrix() -> np.ndarray:
    n = len(K.VECTOR_RANGES) + len(K.VECTOR_PAIRS)
    return np.random.default_rng(K.VECTOR_SEED).uniform(0.5, 1.5, size=(K.VECTOR_DIM, n)).astype(np.float32)


def behaviour_vector(fv: DataFrame, name: str = "vector") -> DataFrame:
    """32-d vector: range-normalised features and products, projected by a fixed matrix."""
    def scaled(key: str) -> Column:
        lo, hi = K.VECTOR_RANGES[key]
        value = F.coalesce(F.col(key).cast("double"), F.lit(0.0)) if key in fv.columns else F.lit(0.0)
        return clip((value - lo) / (hi - lo + 1e-9), 0, 1)

    x = fv.withColumn("_x", F.array(*[scaled(k) for k in K.VECTOR_RANGES]))
    return x.withColumn(name, _project(_matrix(), K.VECTOR_PAIRS)(F.col("_x"))).drop("_x")


def _project(matrix: np.ndarray, pairs: list[tuple[int, int]]):
    """Matrix product per Arrow batch; as column arithmetic its code is too large to compile."""
    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=object)
        x = np.stack(xs.to_numpy())
        full = np.hstack([x, *[(x[:, i] * x[:, j])[:, None] for i, j in pairs]])
        out = np.clip(full @ matrix.T.astype(float) / full.shape[1], 0.0, 1.0)
        return pd.Series(list(out))
    return run


def smooth_vectors(snaps: DataFrame, vec: str = "vector") -> DataFrame:
    """Each version's vector blended with the previous blend; faster when risk moves.

    The fold reads each user's rows in order and keeps one blend.
    """
    user = dict(snaps.dtypes)["user_id"]
    rows = snaps.select("user_id", "version", "risk_score", vec).repartition("user_id").sortWithinPartitions(
        "user_id", "version", "risk_score", vec)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, risk, blend = object(), None, None
        for b in batches:
            out = []
            for key, now, v in zip(b.column("user_id").to_pylist(), b.column("risk_score").to_pylist(), b.column(vec).to_pandas()):
                if key != of or blend is None or v is None:
                    blend = v
                elif now is None or risk is None or isinstance(blend, list):
                    blend = [None] * len(v)                                   # nothing is known from here on
                else:
                    # like the columns' own order, NaN is above every number
                    move = abs(now - risk) * 1.5
                    alpha = 0.65 if math.isnan(move) else max(0.15, min(0.20 + move, 0.65))
                    mix = (1.0 - alpha) * blend + alpha * v
                    blend = np.where(np.isnan(mix), 1.0, np.clip(mix, 0.0, 1.0))
                of, risk = key, now
                out.append(blend)
            yield pa.RecordBatch.from_arrays([b.column("user_id"), b.column("version"), pa.array(out, pa.list_(pa.float64()))],
                                             names=["user_id", "version", "vector"])

    return rows.mapInArrow(fold, f"user_id {user}, version int, vector array<double>")


# ------------------------------------------------------------ ordered state

def material_changes(snaps: DataFrame) -> DataFrame:
    """Snapshots whose rounded signature differs from the one before."""
    sig = F.struct(F.round("risk_score", 4), "liquidity_health", F.round("cash_buffer_days", 2),
                   F.round("emi_burden_ratio", 4), F.round("income_stability", 4),
                   F.round("spending_volatility", 4), "persona")
    w = W.partitionBy("user_id").orderBy("version")
    return (snaps.withColumn("_sig", sig).withColumn("_prev", F.lag("_sig").over(w))
            .where(~F.col("_sig").eqNullSafe(F.col("_prev"))).drop("_sig", "_prev"))


def latest_per_day(snaps: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("version"))
    return (snaps.withColumn("day", F.to_date("ts")).withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn"))


def histories(snaps: DataFrame, risks: int = 20, summaries: int = 10, points: int = 365) -> DataFrame:
    """Trailing histories of each version, capped by row count as a feature: the newest risks, summaries and trend points."""
    w = W.partitionBy("user_id").orderBy("version")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    return snaps.select(
        "user_id", "version", "ts",
        F.collect_list(rnd("risk_score", 4)).over(last(risks)).alias("risk_history"),
        F.collect_list(F.struct("version", "liquidity_health")).over(last(summaries)).alias("feature_history"),
        F.collect_list(F.struct("ts", rnd("risk_score", 4).alias("risk_score"))).over(last(points)).alias("trend"))


def trajectory_delta(snaps: DataFrame, size: int = 20, sign: int = -1) -> DataFrame:
    """Risk movement over the stored history, floored at 0.

    sign=-1 counts falling risk as positive (the documented meaning), sign=+1
    counts rising risk.
    """
    w = W.partitionBy("user_id").orderBy("version").rowsBetween(-(size - 1), 0)
    move = sign * (F.col("risk_score") - F.first("risk_score").over(w))
    return snaps.select("user_id", "version", rnd(F.when(F.count(F.lit(1)).over(w) >= 2,
                        F.greatest(move, F.lit(0.0))).otherwise(0.0), 4).alias("trajectory_delta"))


def previous_volatility(snaps: DataFrame) -> DataFrame:
    """Oldest volatility among the last five snapshots; null on a user's first."""
    w = W.partitionBy("user_id").orderBy("version").rowsBetween(-4, 0)
    return snaps.withColumn("previous_volatility", F.when(
        F.count(F.lit(1)).over(w) >= 2, F.first("spending_volatility").over(w)))


def latest(snaps: DataFrame) -> DataFrame:
    """Newest version of every user; a task hands on one row per user.

    Rows are ranked, not put into an aggregate: a struct with texts has no fixed width, so Spark would sort for it all the
    same and then copy the whole struct for every row.
    """
    w = W.partitionBy("user_id").orderBy(F.desc("version"))
    cols = [c for c in snaps.columns if c != "user_id"]
    return snaps.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("user_id", *cols)


# -------------------------------------------------------------- time travel

def as_of(targets: DataFrame, snaps: DataFrame, cols: list[str], at: str = "ts") -> DataFrame:
    """Latest snapshot at or before each target, as columns; null before the first.

    Targets and snapshots are unioned and carried forward by (user, day), so a
    user with very many targets is spread over their days.
    """
    s = snaps.select("user_id", F.col("ts").alias(at), F.struct(*cols).alias("_snap"), F.lit(0).alias("_side"))
    t = targets.withColumn("_side", F.lit(1)).withColumn("_snap", F.lit(None).cast(s.schema["_snap"].dataType))
    u = t.unionByName(s, allowMissingColumns=True)
    c = carry_forward(u, ["user_id"], F.to_date(at), [F.col(at), F.col("_side")], "_snap", "_found")
    return (c.where("_side = 1").drop("_side", "_snap")
            .select(*targets.columns, *[F.col(f"_found.{n}").alias(f"snap_{n}") for n in cols]))


def at_time(users: DataFrame, snaps: DataFrame, at: datetime, cols: list[str]) -> DataFrame:
    """Each user's latest snapshot up to one moment; nulls for users that have none yet."""
    last = snaps.where(F.col("ts") <= ntz(at)).groupBy("user_id").agg(
        F.max_by(F.struct(*cols), F.struct("ts", "version")).alias("_s"))
    return users.join(last, "user_id", "left").select(*users.columns, *[F.col(f"_s.{n}").alias(n) for n in cols])


def at_version(snaps: DataFrame, requests: DataFrame) -> DataFrame:
    return snaps.join(requests, ["user_id", "version"], "left_semi")


def rollback(snaps: DataFrame, requests: DataFrame, now: datetime) -> DataFrame:
    """Appends a copy of each requested version as the user's next version."""
    top = snaps.groupBy("user_id").agg(F.max("version").alias("_top"), F.min("ts").alias("_created"))
    first = snaps.withColumn("created_at", F.min("ts").over(W.partitionBy("user_id")))
    copies = (at_version(snaps, requests).join(top, "user_id")
              .withColumn("version", (F.col("_top") + 1).cast("int"))
              .withColumn("created_at", F.col("_created"))
              .withColumn("ts", ntz(now)).drop("_top", "_created"))
    return first.unionByName(copies)


# ------------------------------------------------------------ snapshot diffs

def snapshot_diff(snaps: DataFrame, features: list[str]) -> DataFrame:
    """Long table of each feature's previous and current value per version."""
    w = W.partitionBy("user_id").orderBy("version")
    prev = snaps.select("user_id", "version", *features, F.lag(F.struct(*features)).over(w).alias("_p"))
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_p.{f}").cast("double").alias("previous"),
                                 F.col(f).cast("double").alias("current")) for f in features])
    return (prev.where(F.col("_p").isNotNull()).select("user_id", "version", F.explode(entries).alias("e"))
            .select("user_id", "version", "e.*"))


def changed_features(diff: DataFrame, stds: dict[str, float], top: int = 10, least: float = 0.5) -> DataFrame:
    """Features that moved by at least half a deviation, strongest first."""
    from fintrail.functions.rules import lookup
    std = lookup(F.col("feature"), stds, 1.0)
    z = (F.col("current") - F.col("previous")) / F.greatest(std, F.lit(1e-9))
    better = (F.col("feature").isin(K.HIGHER_IS_BETTER) & (F.col("z") > 0)) | \
             (F.col("feature").isin(K.LOWER_IS_BETTER) & (F.col("z") < 0))
    w = W.partitionBy("user_id", "version").orderBy(F.desc(F.abs("z_change")), "feature")
    return (diff.withColumn("z", z).where(F.abs("z") >= least)
            .select("user_id", "version", "feature", rnd("previous", 4).alias("previous"),
                    rnd("current", 4).alias("current"), rnd("z", 3).alias("z_change"),
                    F.when(better, "improved").otherwise("degraded").alias("direction"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))


# --------------------------------------------------- volatility and regimes

def conditional_variance(snaps: DataFrame, value: str, persona: str = "persona") -> DataFrame:
    """Recursive variance filter over each user's observed daily changes of `value`.

    The recursion is a fold over at most one row per user-day; parameters follow
    the persona of the row.
    """
    from fintrail.functions.rules import lookup
    w = W.partitionBy("user_id").orderBy("version")
    p = lambda i: lookup(F.col(persona), {k: v[i] for k, v in K.VOLATILITY_PARAMS.items()},
                         K.VOLATILITY_PARAMS["unknown"][i])
    rows = snaps.select("user_id", "version", (F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value))).alias("e"),
                        p(0).alias("w"), p(1).alias("a"), p(2).alias("b"))
    per = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("version", "e", "w", "a", "b"))).alias("s"))
    zero = F.struct(F.lit(None).cast("double").alias("var"), F.lit(0.0).alias("eps"),
                    F.expr("cast(array() as array<struct<version:int,sigma:double>>)").alias("out"))

    def step(acc, s):
        long_run = s["w"] / (1.0 - s["a"] - s["b"])
        var = F.when(acc["var"].isNull(), long_run).otherwise(
            F.greatest(s["w"] + s["a"] * acc["eps"] * acc["eps"] + s["b"] * acc["var"], F.lit(1e-10)))
        return F.struct(var.alias("var"), s["e"].alias("eps"), F.concat(acc["out"], F.array(F.struct(
            s["version"].alias("version"), F.sqrt(var).alias("sigma")))).alias("out"))

    return (per.withColumn("o", F.explode(F.aggregate("s", zero, step)["out"]))
            .select("user_id", F.col("o.version").alias("version"), rnd(F.col("o.sigma"), 6).alias("sigma")))


def transition_matrix(regimes: DataFrame) -> DataFrame:
    """Observed share of moves between consecutive regimes."""
    w = W.partitionBy("user_id").orderBy("version")
    moves = (regimes.select(F.lag("regime").over(w).alias("from_regime"), F.col("regime").alias("to_regime"))
             .where(F.col("from_regime").isNotNull()).groupBy("from_regime", "to_regime")
             .agg(F.count(F.lit(1)).alias("moves")))
    total = F.sum("moves").over(W.partitionBy("from_regime"))       # three regimes: nine rows at most
    return moves.withColumn("share", rnd(F.col("moves") / total, 4))
