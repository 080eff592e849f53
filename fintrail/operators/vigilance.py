"""Scam, mule, stress and deception scoring over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import LN2, clip, level, micros, rnd, sigmoid
from fintrail.functions.rules import hits, lookup

c = F.col
TIERS = ((0.75, "CRITICAL"), (0.50, "HIGH"), (0.25, "MEDIUM"))


def _saturating(k: Column, rate: float) -> Column:
    return rnd(1.0 - F.exp(F.lit(-rate) * k), 4)


def message_scores(messages: DataFrame) -> DataFrame:
    """Urgency, authority and code-request scores of each message; reads the whole text.

    Patterns are counted once each. A bare six-digit number counts only next to
    urgency, and a registered sender id softens the authority score.
    """
    m = messages.withColumn("_u", hits(c("text"), K.URGENCY_PATTERNS)).withColumn("_a", hits(c("text"), K.AUTHORITY_PATTERNS))
    bare = c("text").rlike(K.BARE_CODE_PATTERN) & (c("_u") > 0)
    m = m.withColumn("_o", hits(c("text"), K.CODE_REQUEST_PATTERNS) + bare.cast("int"))
    legit = F.coalesce(F.trim("sender_id").rlike("(?i)" + K.REGISTERED_SENDER_PATTERN), F.lit(False))
    authority = (1.0 - F.exp(-0.5 * c("_a"))) * F.when(legit, 0.3).otherwise(1.0)
    return m.withColumns({"urgency_score": _saturating(c("_u"), 0.45), "authority_score": rnd(authority, 4),
                          "otp_score": _saturating(c("_o"), 0.8)}).drop("_u", "_a", "_o")


def message_evidence(messages: DataFrame) -> DataFrame:
    """What the scores of `message_scores` rest on: a row per message and pattern found.

    Columns: message_id, signal, pattern (its number in the signal's list, the bare
    six-digit number last), matched_text (its first occurrence), confidence (the
    signal's score to three digits) and severity. Every pattern found gives a row.
    Messages without a hit and null texts give none; repeated messages repeat their rows.
    """
    def found(patterns, first=1):
        cells = [F.struct(F.lit(i).alias("pattern"), F.regexp_extract("text", "(?i)" + p, 0).alias("matched_text"))
                 for i, p in enumerate(patterns, first)]
        return F.filter(F.array(*cells), lambda x: x.matched_text != "")

    bare = found([K.BARE_CODE_PATTERN], len(K.CODE_REQUEST_PATTERNS) + 1)
    m = messages.select("message_id", "text", "sender_id", found(K.URGENCY_PATTERNS).alias("u"), found(K.AUTHORITY_PATTERNS).alias("a"),
                        found(K.CODE_REQUEST_PATTERNS).alias("o"))
    m = m.withColumn("o", F.when(F.size("u") > 0, F.concat("o", bare)).otherwise(c("o")))
    legit = F.coalesce(F.trim("sender_id").rlike("(?i)" + K.REGISTERED_SENDER_PATTERN), F.lit(False))
    score = {"u": 1.0 - F.exp(-0.45 * F.size("u")), "o": 1.0 - F.exp(-0.8 * F.size("o")),
             "a": (1.0 - F.exp(-0.5 * F.size("a"))) * F.when(legit, 0.3).otherwise(1.0)}
    severity = {"u": F.when(score["u"] > 0.6, "HIGH").otherwise("MEDIUM"), "a": F.when(score["a"] > 0.6, "CRITICAL").otherwise("HIGH"),
                "o": F.lit("CRITICAL")}

    def rows(name, signal):
        return F.transform(name, lambda x: F.struct(F.lit(signal).alias("signal"), x.pattern.alias("pattern"), x.matched_text.alias("matched_text"),
                                                    rnd(score[name], 3).alias("confidence"), severity[name].alias("severity")))

    items = F.concat(*[rows(n, s) for n, s in zip("uao", K.MESSAGE_SIGNALS)])
    return m.select("message_id", F.inline(items))


def scam_probability(scores: DataFrame, prior: float = 0.05) -> DataFrame:
    """Naive-Bayes log-odds over the scores that are present; tier and alert."""
    import math
    odds = F.lit(math.log(prior / (1 - prior + 1e-9)))
    names = ("urgency_score", "authority_score", "otp_score")
    for n in names:
        lr = (0.85 * c(n) + 0.05) / (0.10 * c(n) + 0.02 + 1e-9)
        odds = odds + F.when(c(n) > 1e-4, F.log(lr + 1e-9)).otherwise(0.0)
    none = (c(names[0]) == 0) & (c(names[1]) == 0) & (c(names[2]) == 0)
    s = scores.withColumn("scam_probability", F.when(none, 0.0).otherwise(rnd(sigmoid(odds), 4)))
    return s.withColumn("scam_risk", level(c("scam_probability"), *TIERS, default="LOW")).withColumn(
        "is_scam_alert", c("scam_probability") >= 0.5)


def worst_message(scored: DataFrame) -> DataFrame:
    """Most suspicious of each user's messages; of equal ones the oldest."""
    best = F.struct((-c("scam_probability")).alias("p"), "ts", "message_id")
    return scored.groupBy("user_id").agg(F.min_by(F.struct("message_id", "scam_probability", "scam_risk"), best).alias("m")).select("user_id", "m.*")


# -------------------------------------------------------------------- mules

def mule_score() -> Column:
    t = c("daily_avg_throughput_30d")
    v = F.when(t > 200_000, F.least((t - 200_000) / 200_000.0, F.lit(1.0)) * 0.4).otherwise(0.0)
    s = (v + F.when(c("discretionary_ratio") <= 0.02, 0.35).otherwise(0.0) + F.when(c("cash_buffer_days") < 2, 0.15).otherwise(0.0)
         + F.when(c("debit_failure_rate_90d") < 0.01, 0.10).otherwise(0.0))
    return rnd(F.least(s, F.lit(1.0)), 4)


def hub_score(share: Column, sources: Column, outflow: Column, rank: Column) -> Column:
    s = (F.when(share >= 0.80, 0.6).otherwise(0.0) + F.when((sources > 5) & (share > 0.6), 0.25).otherwise(0.0)
         + F.when(rank >= 0.10, 0.15).otherwise(0.0))
    return F.when(F.coalesce(outflow, F.lit(0.0)) == 0, 0.0).otherwise(rnd(F.least(s, F.lit(1.0)), 4))


def bot_scores(df: DataFrame) -> DataFrame:
    """Composite of regular timing, hub shape and mule profile.

    Needs regular_flag, top_receiver_share, inflow_sources, total_outflow, pagerank and the features.
    """
    d = df.withColumn("mule_score", mule_score()).withColumn(
        "hub_score", hub_score(c("top_receiver_share"), c("inflow_sources"), c("total_outflow"), c("pagerank")))
    precision = F.when(c("regular_flag"), 0.8).otherwise(0.0)
    d = d.withColumn("consistency_score", rnd(F.least(precision * 0.35 + c("hub_score") * 0.40 + c("mule_score") * 0.25, F.lit(1.0)), 4))
    return d.withColumns({
        "is_bot": c("regular_flag") & (c("consistency_score") > 0.5),
        "is_mule": (c("mule_score") > 0.6) | ((c("hub_score") > 0.5) & (c("mule_score") > 0.35)),
        "bot_risk": level(c("consistency_score"), (0.7, "CRITICAL"), (0.45, "HIGH"), (0.2, "MEDIUM"), default="LOW")})


# ------------------------------------------------------------------- stress

def stress(df: DataFrame) -> DataFrame:
    """Logistic stress score from six normalised inputs, with trend labels."""
    one = lambda x: F.least(x, F.lit(1.0))
    fail, buf, dip = c("debit_failure_rate_90d"), c("cash_buffer_days"), F.abs("end_of_month_liquidity_dip")
    x = (F.lit(-4.5) + 3.5 * one(fail / 0.5) + 2.8 * F.greatest(F.lit(0.0), 1.0 - buf / 90.0) + 1.5 * one(dip / 50_000.0)
         + 2.2 * one(c("emi_burden_ratio") / 0.8) + 1.0 * one(c("spending_volatility_index") / 2.0)
         + 2.5 * F.greatest(F.lit(0.0), 1.0 - c("income_stability_score")))
    d = df.withColumn("stress_score", rnd(sigmoid(x), 4))
    return d.withColumns({
        "velocity_spike": (fail > 0.10) & (dip > 10_000),
        "buffer_trend": F.when(buf < 5, "critical").when(buf < 10, "declining").when(buf < 20, "stable").otherwise("improving"),
        "failure_trend": F.when(fail > 0.15, "critical").when(fail > 0.07, "declining").otherwise("stable"),
        "stress_risk": level(c("stress_score"), (0.70, "CRITICAL"), (0.45, "HIGH"), (0.20, "MEDIUM"), default="LOW")})


def underreporting(df: DataFrame) -> DataFrame:
    """Observed against declared income on the cohort's scale.

    Needs declared_income, cohort_mean_income and cohort_std_income.
    """
    p2p = F.least(c("cash_dependency_index") * 1.5, F.lit(0.9))
    seen = F.greatest(c("income_90d") / 3.0 * (1.0 - p2p), F.lit(0.0))
    declared = F.when(c("declared_income") > 0, c("declared_income")).otherwise(
        F.coalesce(F.when(c("cohort_mean_income") != 0, c("cohort_mean_income")), F.lit(1.0)))
    d = df.withColumn("_d", declared)
    std = F.when(c("cohort_std_income") > 100, c("cohort_std_income")).otherwise(F.greatest(c("_d") * 0.3, F.lit(1000.0)))
    z = (seen - c("_d")) / (std + 1e-9)
    d = d.withColumns({"observed_income": rnd(seen, 2), "income_z": rnd(z, 4), "underreport_score": rnd(sigmoid(clip(z, -700, 700)), 4)}).drop("_d")
    return d.withColumn("is_underreporting", c("underreport_score") >= 0.65).withColumn(
        "underreport_risk", level(c("underreport_score"), (0.80, "CRITICAL"), (0.65, "HIGH"), (0.50, "MEDIUM"), default="LOW"))


def js_divergence(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon divergence of two mixes, scaled to [0, 1]."""
    def kl(a, m):
        return F.when((a > 1e-10) & (m > 1e-10), a * F.log(a / m)).otherwise(0.0)
    total = F.lit(0.0)
    for a, b in zip(p, q):
        m = (a + b) / 2.0
        total = total + 0.5 * kl(a, m) + 0.5 * kl(b, m)
    return rnd(F.least(total / LN2, F.lit(1.0)), 4)


def identity_shift(df: DataFrame, categories: list[str]) -> DataFrame:
    """Change of spending identity; reads mix30_* and mix90_* next to the features.

    Without a mix the number of shifted categories, out of ten, stands for the divergence.
    """
    js = js_divergence([c(f"mix30_{x}") for x in categories], [c(f"mix90_{x}") for x in categories])
    none = F.coalesce(*[c(f"{m}_{x}") for m in ("mix30", "mix90") for x in categories]).isNull()
    js = F.when(none, rnd(F.least(c("merchant_category_shift_count") / 10.0, F.lit(1.0)), 4)).otherwise(js)
    change = F.least(F.abs(c("discretionary_30d") - c("discretionary_90d")) / F.greatest(c("discretionary_90d"), F.lit(1.0)), F.lit(1.0))
    infl = F.least(F.abs("lifestyle_inflation_trend"), F.lit(1.0))
    d = df.withColumn("js_divergence", js).withColumn("disc_change", rnd(change, 4))
    d = d.withColumn("identity_score", rnd(F.least(c("js_divergence") * 0.45 + change * 0.30 + infl * 0.25, F.lit(1.0)), 4))
    return d.withColumns({"drift_score": rnd(c("js_divergence") * 0.5 + change * 0.5, 4), "is_shifted": c("identity_score") >= 0.45,
                          "identity_risk": level(c("identity_score"), (0.70, "CRITICAL"), (0.45, "HIGH"), (0.25, "MEDIUM"), default="LOW")})


# ---------------------------------------------------------------- composite

def worst(*levels: Column) -> Column:
    """Highest of several risk labels."""
    rank = {n: i for i, n in enumerate(K.RISK_LEVELS)}
    top = F.greatest(*[F.coalesce(lookup(x, rank), F.lit(0)) for x in levels])
    return F.element_at(F.array(*[F.lit(n) for n in K.RISK_LEVELS]), top + 1)


def deception(df: DataFrame) -> DataFrame:
    """Weighted composite of all modules and the worst of their levels."""
    z = lambda n: F.coalesce(c(n), F.lit(0.0))
    s = (z("fraud_confidence") * 0.30 + z("scam_probability") * 0.20 + z("consistency_score") * 0.20 + z("stress_score") * 0.10
         + z("underreport_score") * 0.10 + z("identity_score") * 0.10)
    return df.withColumn("deception_score", rnd(F.least(s, F.lit(1.0)), 4)).withColumn(
        "overall_risk", worst(c("ring_risk"), c("scam_risk"), c("bot_risk"), c("stress_risk"), c("underreport_risk"), c("identity_risk")))


def vigilance_events(result: DataFrame) -> DataFrame:
    """Zero to three stream events per scored user."""
    ring, scam = c("fraud_ring_flag"), c("scam_probability") >= 0.5
    ev = lambda when, name, score: F.when(when, F.struct(F.lit(name).alias("event"), score.cast("double").alias("score")))
    items = F.array(ev(F.lit(True), "vigilance_completed", c("deception_score")), ev(ring, "fraud_ring_flagged", c("fraud_confidence")),
                    ev(scam, "scam_alert", c("scam_probability")))
    return result.select("user_id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("e")).select("user_id", "e.*")


def warning_severity(share: Column) -> list[Column]:
    sev = level(share, (0.55, "RED"), (0.30, "ORANGE"), (0.15, "AMBER"), default="GREEN")
    advice = {"GREEN": "NO_ACTION", "AMBER": "SOFT_NUDGE", "ORANGE": "EMI_AT_RISK_ALERT + MICRO_LOAN_PRE_QUALIFY",
              "RED": "IMMEDIATE_INTERVENTION + HUMAN_ESCALATION"}
    return [sev.alias("severity"), lookup(sev, advice).alias("recommendation")]


def spend_pressure(events: DataFrame, ref) -> DataFrame:
    """Change of spending volatility and failed debits before ref, per user.

    Volatility is deviation over mean of the daily successful outflow, days without
    any included; volatility_change sets the last 7 days against the last 30 (0.0
    where either has no outflow). debit_failures_7d counts failed outflows. Null
    amounts and times do not count; users without an event in 30 days have no row.
    """
    at = F.lit(ref).cast("timestamp_ntz")
    e = events.where((c("ts") <= at) & (c("ts") > at - F.expr("INTERVAL 30 DAYS")) & (c("amount") < 0))
    ok = F.coalesce(c("status") != "FAILED", F.lit(True))
    days = e.groupBy("user_id", F.floor((micros(at) - micros(c("ts"))) / 86_400_000_000).alias("age")).agg(
        F.round(F.coalesce(F.sum(F.when(ok, -c("amount"))), F.lit(0.0)), 2).alias("spent"), F.count_if(~ok).alias("failed"))

    def volatility(n):
        x = F.when(c("age") < n, c("spent")).otherwise(0.0)
        mean = F.sum(x) / n
        return F.when(mean > 0, F.sqrt(F.greatest(F.sum(x * x) / n - mean * mean, F.lit(0.0))) / mean)

    u = days.groupBy("user_id").agg(volatility(7).alias("v7"), volatility(30).alias("v30"),
                                    F.sum(F.when(c("age") < 7, c("failed")).otherwise(0)).alias("debit_failures_7d"))
    change = F.when(c("v30") > 0, rnd(c("v7") / c("v30") - 1.0, 4))
    return u.select("user_id", F.coalesce(change, F.lit(0.0)).alias("volatility_change"), "debit_failures_7d")


def leading_indicators(df: DataFrame) -> DataFrame:
    """Coded warnings beside the early-warning share, as an array `indicators`, and the change in whole percent.

    Needs volatility_change, debit_failures_7d and avg_daily_burn; a null counts as 0.
    The figures that a text would name stay in their columns.
    """
    z = {n: F.coalesce(c(n), F.lit(0)) for n in ("volatility_change", "debit_failures_7d", "avg_daily_burn")}
    codes = F.array_compact(F.array(F.when(z["volatility_change"] > 0.10, "SPENDING_VOLATILITY_UP"),
                                    F.when(z["debit_failures_7d"] > 0, "DEBIT_FAILURES"),
                                    F.when(z["avg_daily_burn"] > 0, "CASH_BUFFER_DECLINING")))
    return df.withColumns({"volatility_change_pct": rnd(z["volatility_change"] * 100.0, 0).cast("int"),
                           "indicators": F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("NONE")))})
