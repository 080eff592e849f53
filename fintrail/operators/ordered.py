"""Operators over each user's events in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fintrail.functions.keyed import gap_moments, with_halo, with_position
from fintrail.functions.numeric import micros, rnd
from fintrail.operators.stateful import BURST, CHUNK, HISTORY, SIGMAS, WARM


def interval_regularity(df: DataFrame, key: str = "user_id", threshold: float = 0.05, least: int = 5) -> DataFrame:
    """Coefficient of variation of the gaps between events; very regular gaps are flagged.

    Moments of the gaps are added up per (key, hour), so a busy key is spread out.
    """
    s = df.select(key, (micros(F.col("ts")) / 1e6).alias("t"))
    m = gap_moments(s, [key], F.floor(F.col("t") / 3600), "t")
    mean = F.col("gap_sum") / F.col("gaps")
    var = F.greatest(F.lit(0.0), (F.col("gap_sq") - F.col("gap_sum") * mean) / (F.col("gaps") - 1))
    ok = (F.col("rows") >= least) & (F.col("gap_sum") > 0)
    cv = F.when(ok, rnd(F.sqrt(var) / (mean + 1e-9), 4)).otherwise(1.0)
    return m.select(key, F.col("rows").alias("events"), cv.alias("interval_cv"), (cv < threshold).alias("regular_flag"))


def rolling_flags(ev: DataFrame) -> DataFrame:
    """Amount far above the prior 200, and bursts of more than 5 events in an hour.

    The window form counts every earlier event. Rows are numbered per user without
    sorting a user in one task, then cut into chunks that carry the 200 rows
    before them, so the frames are exact.
    """
    e = ev.select("event_id", "user_id", "ts", "status", F.abs("amount").alias("amt"), micros(F.col("ts")).alias("t"))
    p = with_position(e, ["user_id"], F.floor(F.col("t") / 3_600_000_000), [F.col("ts"), F.col("event_id")])
    h = with_halo(p, "pos", CHUNK, HISTORY)
    w = W.partitionBy("user_id", "chunk").orderBy("pos")
    prior = w.rowsBetween(-HISTORY, -1)
    mu, sd, n = F.avg("amt").over(prior), F.stddev_samp("amt").over(prior), F.count(F.lit(1)).over(prior)
    sixth = F.lag("t", BURST + 1).over(w)
    r = h.select("event_id", "user_id", "ts", "status", "is_halo", "amt", n.alias("n"), mu.alias("mu"), sd.alias("sd"),
                 (F.col("t") - sixth).alias("span")).where(~F.col("is_halo"))
    sigma = F.when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0)
    z = (F.col("n") >= WARM) & ((F.col("amt") - F.col("mu")) / sigma > SIGMAS)
    burst = F.coalesce(F.col("span") <= 3_600_000_000, F.lit(False))
    failed = F.col("status") == "FAILED"
    return r.select("event_id", "user_id", "ts", failed.alias("failed"), F.coalesce(z, F.lit(False)).alias("amount_flag"),
                    burst.alias("burst_flag"))


# ----------------------------------------------------------- top-k reports

def newest(df: DataFrame, n: int, kind: Column | None = None, key: str = "user_id", at: str = "ts",
           tie: str = "event_id") -> DataFrame:
    """The newest n rows per key, filtered by type first."""
    d = df.where(kind) if kind is not None else df
    w = W.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def attribution(long: DataFrame, key: str, feature: str = "feature", value: str = "value", k: int | None = None) -> DataFrame:
    """Contributions per row by size, with direction, and the prediction they add up to."""
    w = W.partitionBy(key).orderBy(F.desc(F.abs(F.col(value))), feature)
    r = long.withColumn("rank", F.row_number().over(w))
    r = r.withColumn("direction", F.when(F.col(value) > 0, "increases_risk").otherwise("decreases_risk"))
    return r.where(F.col("rank") <= k) if k else r


def waterfall(long: DataFrame, key: str, base: Column) -> DataFrame:
    total = long.groupBy(key).agg(F.sum("value").alias("_sum"))
    r = attribution(long, key).join(total, key)
    return r.withColumn("base_value", base).withColumn("final_prediction", F.col("base_value") + F.col("_sum")).drop("_sum")


def most_anomalous(fv: DataFrame, norms: dict[str, tuple[float, float]], n: int = 5) -> DataFrame:
    """The n features of each row furthest from their norms."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                               rnd((F.col(f) - m) / max(s, 1e-9), 3).alias("z_score")) for f, (m, s) in norms.items()])
    w = W.partitionBy("user_id").orderBy(F.desc(F.abs("z_score")), "feature")
    return (fv.select("user_id", F.explode(items).alias("i")).select("user_id", "i.*").where("value IS NOT NULL")
            .withColumn("anomaly_rank", F.row_number().over(w)).where(F.col("anomaly_rank") <= n))


