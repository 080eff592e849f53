"""Daily series, calendars and business aggregates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window as W, functions as F

from fintrail.functions.keyed import quantiles
from fintrail.functions.numeric import ntz, rnd, zsum
from fintrail.operators.joins import calendar

MEASURES = ["daily_volume", "daily_count", "daily_ewb_volume", "daily_ewb_count"]


def daily_series(transfers: DataFrame, consignments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Volume and count per day from two event families, amounts cut to whole units."""
    keys = keys or []
    day = F.to_date("ts").alias("day")
    a = transfers.groupBy(*keys, day).agg(F.sum("amount").alias("v"), F.count(F.lit(1)).alias("c"))
    b = consignments.groupBy(*keys, day).agg(F.sum(F.abs("tot_inv_value")).alias("w"), F.count(F.lit(1)).alias("e"))
    both = a.unionByName(b, allowMissingColumns=True)
    whole = lambda c: rnd(zsum(F.col(c)), 2).cast("long")
    return both.groupBy(*keys, "day").agg(
        whole("v").alias("daily_volume"), F.coalesce(F.sum("c"), F.lit(0)).alias("daily_count"),
        whole("w").alias("daily_ewb_volume"), F.coalesce(F.sum("e"), F.lit(0)).alias("daily_ewb_count"))


def filled_series(daily: DataFrame, keys: list[str]) -> DataFrame:
    return calendar(daily, keys, "day", MEASURES)


def trailing_summaries(series: DataFrame, keys: list[str], sizes: tuple[int, ...] = (30, 60, 90, 365)) -> DataFrame:
    """Sums over the last n calendar rows, all sizes in one pass."""
    w = W.partitionBy(*keys).orderBy(F.desc("day"))
    r = series.withColumn("rn", F.row_number().over(w))
    cols = []
    for n in sizes:
        on = F.col("rn") <= n
        vol = F.sum(F.when(on, F.col("daily_volume")))
        cols += [vol.alias(f"upi_volume_{n}"), F.sum(F.when(on, F.col("daily_count"))).alias(f"upi_count_{n}"),
                 F.sum(F.when(on, F.col("daily_ewb_volume"))).alias(f"ewb_volume_{n}"),
                 F.sum(F.when(on, F.col("daily_ewb_count"))).alias(f"ewb_count_{n}"),
                 F.expr(f"cast(sum(case when rn <= {n} then daily_volume end) / greatest(1, count_if(rn <= {n})) as bigint)")
                 .alias(f"avg_daily_upi_{n}")]
    return r.groupBy(*keys).agg(*cols)


def maturity(series: DataFrame, keys: list[str]) -> DataFrame:
    """Months with any volume, at least 1."""
    live = (F.col("daily_volume") > 0) | (F.col("daily_ewb_volume") > 0)
    months = F.count_distinct(F.when(live, F.trunc("day", "month")))
    return series.groupBy(*keys).agg(F.greatest(months, F.lit(1)).cast("int").alias("data_maturity_months"))


BUCKETS = [(0, 10_000, "0-10k"), (10_000, 20_000, "10k-20k"), (20_000, 30_000, "20k-30k"),
           (30_000, 40_000, "30k-40k"), (40_000, 45_000, "40k-45k"), (45_000, 50_000, "45k-49.9k"),
           (50_000, 70_000, "50k-70k")]


def value_histogram(consignments: DataFrame) -> DataFrame:
    """Counts per value range; the band just below 50,000 is marked, with its share."""
    v = F.col("tot_inv_value")
    label = None
    for lo, hi, name in BUCKETS:
        hit = (v >= lo) & (v < hi)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    g = consignments.groupBy(label.otherwise("70k+").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(W.partitionBy())      # eight rows
    return g.select("bucket", "rows", (F.col("bucket") == "45k-49.9k").alias("below_threshold"),
                    rnd(F.col("rows") / total, 4).alias("share"))


def receivables_by_month(invoices: DataFrame, inbound: DataFrame) -> DataFrame:
    """Invoiced against received per month, and the gap."""
    a = invoices.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("taxable_value").alias("i"))
    b = inbound.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("amount").alias("r"))
    i, r = F.coalesce("i", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    return a.join(b, "month", "full").select("month", rnd(i, 2).alias("invoiced"), rnd(r, 2).alias("received"),
                                             rnd(i - r, 2).alias("gap"))


def cohort_medians(fv: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Exact medians per cohort."""
    out = None
    for c in cols:
        m = quantiles(fv, keys, c, {"m": 0.5}).select(*keys, rnd("m", 4).alias(f"median_{c}"))
        out = m if out is None else out.join(m, keys)
    return out


def income_posterior(income: DataFrame, prior: DataFrame, noise: float = 0.10) -> DataFrame:
    """Log-normal income belief after all observations.

    Sequential conjugate updates commute, so the posterior needs only the count
    and the sum of logs. prior(user_id, income_mean, stability).
    """
    seen = (income.where(F.col("amount") > 0).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("amount")).alias("logs")))
    s0 = F.greatest((1.0 - F.col("stability")) * 0.5 + 0.05, F.lit(0.05))
    mu0 = F.log(F.greatest(F.col("income_mean"), F.lit(1.0)))
    p0, pn = 1.0 / (s0 * s0), 1.0 / (noise * noise)
    n, logs = F.coalesce("n", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    prec = p0 + n * pn
    return (prior.join(seen, "user_id", "left")
            .select("user_id", ((p0 * mu0 + pn * logs) / prec).alias("mu"), F.sqrt(1.0 / prec).alias("sigma"))
            .withColumn("mean_income", F.exp(F.col("mu") + 0.5 * F.col("sigma") * F.col("sigma"))))


def flow_concentration(edges: DataFrame) -> DataFrame:
    """Share of each sender's largest receiver, and how many senders pay into it."""
    pair = edges.groupBy("src", "dst").agg(F.sum("amount").alias("amount"))
    out = pair.groupBy(F.col("src").alias("node")).agg(F.max("amount").alias("top"), F.sum("amount").alias("total_outflow"))
    inn = pair.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inflow_sources"),
                                                       F.sum("amount").alias("total_inflow"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.join(inn, "node", "full").select(
        "node", rnd(z("total_outflow"), 2).alias("total_outflow"), rnd(z("total_inflow"), 2).alias("total_inflow"),
        F.coalesce("inflow_sources", F.lit(0)).alias("inflow_sources"),
        rnd(F.coalesce(F.col("top") / (F.col("total_outflow") + 1e-9), F.lit(0.0)), 4).alias("top_receiver_share"))


def flow_totals(ev: DataFrame, ref: datetime) -> DataFrame:
    """30-day totals in and out."""
    e = ev.where((F.col("ts") >= ntz(ref - timedelta(days=30))) & (F.col("ts") <= ntz(ref)))
    inn = F.col("amount") > 0
    return e.groupBy("user_id").agg(
        rnd(zsum(F.when(inn, F.col("amount"))), 2).alias("inbound_30d"),
        rnd(zsum(F.when(~inn, -F.col("amount"))), 2).alias("outbound_30d"),
        F.count(F.lit(1)).alias("transactions_30d"))


def top_categories(ev: DataFrame, ref: datetime, n: int = 5) -> DataFrame:
    """The n largest outbound categories of the last 30 days with their share in percent."""
    e = ev.where((F.col("ts") >= ntz(ref - timedelta(days=30))) & (F.col("ts") <= ntz(ref)) & (F.col("amount") <= 0))
    cat = F.coalesce(F.when(F.trim("merchant_category") != "", F.trim("merchant_category")), F.lit("Others"))
    g = e.groupBy("user_id", cat.alias("category")).agg(rnd(F.sum(-F.col("amount")), 2).alias("spend"))
    total = g.groupBy("user_id").agg(rnd(F.sum("spend"), 2).alias("total"))
    w = W.partitionBy("user_id").orderBy(F.desc("spend"), "category")
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(total, "user_id")
            .where("total > 0").select("user_id", "category", "rank", rnd(F.col("spend") / F.col("total") * 100, 1).alias("pct")))


def income_trend(inflow: DataFrame, ref: datetime) -> DataFrame:
    """Later against earlier half of the last six months with inflow; needs four."""
    e = inflow.where((F.col("ts") >= ntz(ref - timedelta(days=180))) & (F.col("ts") <= ntz(ref)))
    m = e.groupBy("user_id", F.trunc("ts", "month").alias("month")).agg(rnd(F.sum("amount"), 2).alias("v"))
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("month")))
    six = m.withColumn("back", back).where("back <= 6")
    n = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    six = six.withColumn("n", n).withColumn("left", F.col("n") - F.col("back") < F.floor(F.col("n") / 2))
    h = six.groupBy("user_id").agg(F.max("n").alias("n"), F.avg(F.when(F.col("left"), F.col("v"))).alias("l"),
                                   F.avg(F.when(~F.col("left"), F.col("v"))).alias("r"))
    delta = (F.col("r") - F.col("l")) / F.greatest(F.col("l"), F.lit(1.0))
    trend = F.when((F.col("n") >= 4) & (delta > 0.06), "rising").when((F.col("n") >= 4) & (delta < -0.06), "declining")
    return h.select("user_id", F.col("n").cast("int").alias("months"), trend.otherwise("stable").alias("income_trend"))


def source_volumes(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_provenance").agg(F.count(F.lit(1)).alias("events"))


def unclassified_lag(raw: DataFrame, typed: DataFrame) -> DataFrame:
    """Per source: raw rows, typed rows, and how far typing lags."""
    a = raw.groupBy("source_provenance").agg(F.count(F.lit(1)).alias("raw"))
    b = typed.groupBy("source_provenance").agg(F.count(F.lit(1)).alias("typed"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, "source_provenance", "left").select(
        "source_provenance", "raw", z("typed").alias("typed"), F.greatest(z("raw") - z("typed"), F.lit(0)).alias("lag"))


def winsorised_trend(series: DataFrame, keys: list[str], value: str = "daily_volume", q: float = 0.9) -> DataFrame:
    """Values capped at the nearest-rank quantile of positives, then a 3-row mean.

    A key's series has one row per calendar day, so its windows stay small.
    """
    w = W.partitionBy(*keys)
    pos = series.where(F.col(value) > 0).select(*keys, value)
    ranked = (pos.withColumn("rn", F.row_number().over(w.orderBy(value)))
              .withColumn("n", F.count(F.lit(1)).over(w)))
    cut = (ranked.where(F.col("rn") - 1 == F.floor((F.col("n") - 1) * F.lit(q)))
           .select(*keys, F.col(value).cast("double").alias("_cut")))
    capped = series.join(cut, keys, "left").withColumn(
        "_v", F.least(F.col(value).cast("double"), F.greatest(F.coalesce("_cut", F.lit(1.0)), F.lit(1.0))))
    three = w.orderBy("day").rowsBetween(-2, 0)
    return capped.select(*keys, "day", F.col(value).alias("raw_value"), rnd(F.avg("_v").over(three), 4).alias("trend_value"))


def downsample(series: DataFrame, keys: list[str], points: int = 60, last: int | None = None) -> DataFrame:
    """Every ceil(n / points)-th row of each series, after an optional last-n slice."""
    w = W.partitionBy(*keys)
    s = series
    if last:
        s = s.withColumn("_b", F.row_number().over(w.orderBy(F.desc("day")))).where(F.col("_b") <= last).drop("_b")
    s = s.withColumn("_i", F.row_number().over(w.orderBy("day")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.ceil(F.col("_n") / points), F.lit(1))
    return s.where(F.col("_i") % step == 0).drop("_i", "_n")
