"""Join operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fintrail.functions.numeric import day_number


def counterparties(transfers: DataFrame, profiles: DataFrame, handle: str = "counterparty_upi") -> DataFrame:
    """Adds the user behind each counterparty handle; unknown handles are dropped."""
    p = profiles.select(F.col("upi_id").alias(handle), F.col("user_id").alias("counterparty"))
    return transfers.join(p, handle, "inner")


def of_users(ev: DataFrame, users: DataFrame) -> DataFrame:
    return ev.join(users.select("user_id"), "user_id", "left_semi")


def near_days(spend: DataFrame, income: DataFrame, reach: int = 3) -> DataFrame:
    """Marks spend rows within `reach` days of an income day of the same user.

    Income days are made distinct and widened, which turns the band join into an
    equi-join on (user, day).
    """
    days = income.select("user_id", day_number(F.col("ts")).alias("dn")).distinct()
    wide = (days.select("user_id", F.explode(F.sequence(F.col("dn") - reach, F.col("dn") + reach)).alias("dn"))
            .distinct().withColumn("_near", F.lit(True)))
    return (spend.withColumn("dn", day_number(F.col("ts"))).join(wide, ["user_id", "dn"], "left")
            .withColumn("near_income", F.coalesce("_near", F.lit(False))).drop("_near", "dn"))


def calendar(daily: DataFrame, keys: list[str], day: str, measures: list[str]) -> DataFrame:
    """Fills the days missing between each key's first and last day with zeros."""
    span = daily.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    days = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(day))
    out = days.join(daily, [*keys, day], "left")
    return out.select(*keys, day, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def overlay(intervals: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """(interval columns, day) for every day an interval [start_day, end_day) is active."""
    lo, hi = F.col("start_day"), F.col("end_day") - 1
    spread = intervals.where(hi >= lo).withColumn(day, F.explode(F.sequence(lo, hi)))
    return days.join(spread, day)


def bundle(key: str, spine: DataFrame, **sources: tuple[DataFrame, Column]) -> DataFrame:
    """One row per key with an ordered array of structs per source.

    Sources are (table, struct to collect); each is grouped before it is joined.
    """
    out = spine.select(key).distinct()
    for name, (df, item) in sources.items():
        part = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
        out = out.join(part, key, "left")
    return out


def last_rows(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows per key in the given order, as a feature (newest n, worst n)."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
