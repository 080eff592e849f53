"""Ordered computations that stay distributed when one key holds most rows.

A plain window partitioned by a hot key sorts that key in one task. These
helpers split every key into ordered buckets, do the row-level work per
(key, bucket), and combine bucket summaries - one small row per bucket - across
the key. Results are exact; nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SPLITS = 256


def with_position(df: DataFrame, keys: Sequence[str], bucket: Column,
                  order: Sequence[Column], name: str = "pos") -> DataFrame:
    """1-based row number per key in `order`; `bucket` must not decrease along it."""
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    return (b.join(offsets, [*keys, "_b"])
            .withColumn(name, F.col("_off") + F.row_number().over(inside))
            .drop("_b", "_off"))


def with_halo(df: DataFrame, pos: str, size: int, halo: int) -> DataFrame:
    """Cut positions into chunks of `size`, each led by the `halo` rows before it.

    Adds `chunk` and `is_halo`; windows partitioned by (key, chunk) then see the
    same preceding rows as a window over the whole key would.
    """
    own = F.floor((F.col(pos) - 1) / size)
    last = F.floor((F.col(pos) - 1 + halo) / size)
    return (df.withColumn("chunk", F.explode(F.sequence(own, last)))
            .withColumn("is_halo", F.col("chunk") != own))


def carry_forward(df: DataFrame, keys: Sequence[str], bucket: Column,
                  order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Latest non-null `value` at or before each row."""
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rank = F.struct(*[o for o in order])
    tails = (b.where(F.col(value).isNotNull()).groupBy(*keys, "_b")
             .agg(F.max_by(F.col(value), rank).alias("_tail")))
    marks = b.select(*keys, "_b").distinct().join(tails, [*keys, "_b"], "left")
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.select(*keys, "_b", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return (b.withColumn("_here", F.last(F.col(value), ignorenulls=True).over(inside))
            .join(carried, [*keys, "_b"])
            .withColumn(name, F.coalesce("_here", "_carry"))
            .drop("_b", "_here", "_carry"))


def gap_moments(df: DataFrame, keys: Sequence[str], bucket: Column, at: str) -> DataFrame:
    """Per key: row count, and count, sum and sum of squares of gaps between rows."""
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    inside = W.partitionBy(*keys, "_b").orderBy(at)
    part = (b.select(*keys, "_b", at, (F.col(at) - F.lag(at).over(inside)).alias("_g"))
            .groupBy(*keys, "_b")
            .agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"),
                 F.coalesce(F.sum(F.col("_g") * F.col("_g")), F.lit(0.0)).alias("_sq")))
    between = F.col("_lo") - F.lag("_hi").over(W.partitionBy(*keys).orderBy("_b"))
    return (part.withColumn("_x", between).groupBy(*keys)
            .agg(F.sum("_n").alias("rows"),
                 (F.max("_hi") - F.min("_lo")).alias("gap_sum"),
                 (F.sum("_sq") + F.coalesce(F.sum(F.col("_x") * F.col("_x")), F.lit(0.0))).alias("gap_sq"))
            .withColumn("gaps", F.col("rows") - 1))


def _value_buckets(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values with counts, cut into ordered buckets by approximate splitters."""
    groups = list(groups)
    probs = [i / SPLITS for i in range(1, SPLITS)]
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = df.groupBy(*groups).agg(F.percentile_approx(value, probs, 2000).alias("_cuts"))
    counts = (counts.join(cuts, groups) if groups else counts.crossJoin(F.broadcast(cuts)))
    return counts.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def running_totals(df: DataFrame, groups: Sequence[str], order: str,
                   measures: dict[str, Column]) -> DataFrame:
    """Per distinct `order` value: each measure, and its total over smaller values.

    The sums before a value are named `<measure>_before`.
    """
    groups = list(groups)
    probs = [i / SPLITS for i in range(1, SPLITS)]
    per = df.groupBy(*groups, order).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    cuts = df.groupBy(*groups).agg(F.percentile_approx(order, probs, 2000).alias("_cuts"))
    per = per.join(cuts, groups) if groups else per.crossJoin(F.broadcast(cuts))
    per = per.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = per.groupBy(*groups, "_b").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    for m in measures:
        offs = offs.withColumn(f"_o_{m}", F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0))).drop(f"_s_{m}")
    inside = (W.partitionBy(*groups, "_b").orderBy(order)
              .rowsBetween(W.unboundedPreceding, -1))
    out = per.join(offs, [*groups, "_b"])
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)))
    return out.drop("_b", *[f"_o_{m}" for m in measures])


def order_statistics(df: DataFrame, groups: Sequence[str], value: str,
                     ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics by 0-based rank, `ranks` written over the count `n`.

    Equal values are counted before the shuffle and only the value buckets that
    hold a wanted rank are ranked row by row, so no task sees a whole group.
    Returns groups, n, one column per rank.
    """
    groups = list(groups)
    vals = _value_buckets(df, groups, value)
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    buckets = (vals.groupBy(*groups, "_b").agg(F.sum("_n").alias("_bn"))
               .withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
               .withColumn("n", F.sum("_bn").over(whole)))
    wanted = buckets.withColumn("_want", F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), e.cast("long").alias("r")) for k, e in ranks.items()]),
        lambda w: (w["r"] >= F.col("_off")) & (w["r"] < F.col("_off") + F.col("_bn")))
    ).where(F.size("_want") > 0)
    upto = W.partitionBy(*groups, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = (vals.join(wanted, [*groups, "_b"])
              .withColumn("_hi", F.col("_off") + F.sum("_n").over(upto))
              .withColumn("_lo", F.col("_hi") - F.col("_n"))
              .withColumn("_w", F.explode("_want"))
              .where((F.col("_w.r") >= F.col("_lo")) & (F.col("_w.r") < F.col("_hi"))))
    return placed.groupBy(*groups).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_w.k") == k, F.col(value))).alias(k) for k in ranks])


def quantiles(df: DataFrame, groups: Sequence[str], value: str,
              probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, by distributed order statistics."""
    ranks, spots = {}, {}
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("n") - 1)
        spots[name] = spot
        ranks[f"_l_{name}"] = F.floor(spot)
        ranks[f"_h_{name}"] = F.ceil(spot)
    stats = order_statistics(df, groups, value, ranks)
    cols = []
    for name, spot in spots.items():
        lo, hi = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        cols.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return stats.select(*groups, "n", *cols)
