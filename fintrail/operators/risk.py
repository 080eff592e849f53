"""Row-wise risk, credit and intervention rules as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import clip, instalment, level, ntz, ratio, rnd
from fintrail.functions.rules import lookup
from fintrail.operators.twin import bureau_score, display_score

c = F.col


def even(x: Column, step: float = 1.0) -> Column:
    """Round to a multiple of step, halves to even."""
    return F.bround(x / step, 0) * step


# ------------------------------------------------------ situation, concerns

def situation() -> Column:
    emi, cash, fail, sav = c("emi_burden_ratio"), c("cash_buffer_days"), c("debit_failure_rate_90d"), c("savings_rate")
    return (F.when((emi > 0.55) | (fail > 0.15) | (cash < 5), "STRESSED_CRITICAL")
            .when((emi > 0.40) | (sav < 0.05), "STRESSED_RECOVERABLE")
            .when((sav > 0.15) & (emi < 0.30) & (cash > 20), "STABLE_IMPROVING").otherwise("STABLE_FLAT"))


def concern_flags() -> Column:
    def item(when, kind, severity, confidence):
        return F.when(when, F.struct(F.lit(kind).alias("flag_type"), F.lit(severity).alias("severity"),
                                     F.lit(confidence).alias("confidence")))
    return F.filter(F.array(item(c("emi_burden_ratio") > 0.55, "EMI_OVERLOAD", "HIGH", 0.9),
                            item(c("cash_buffer_days") < 7, "LIQUIDITY_CRISIS", "CRITICAL", 0.95)),
                    lambda x: x.isNotNull())


def income_contradiction(fv: DataFrame) -> DataFrame:
    """Declared income against observed months, income sources and lifestyle.

    Needs declared_income and p2p_income_fraction next to the features.
    """
    months = F.filter(F.array(c("income_7d"), F.greatest(c("income_30d") - c("income_7d"), F.lit(0.0)),
                              F.greatest(c("income_90d") - c("income_30d"), F.lit(0.0))), lambda m: m > 0)
    f = fv.withColumn("_m", months).withColumn("_n", F.size("_m"))
    mean = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x) / c("_n")
    f = f.withColumn("_mu", F.when(c("_n") > 0, mean))
    sq = F.aggregate("_m", F.lit(0.0), lambda a, x: a + (x - c("_mu")) * (x - c("_mu")))
    f = f.withColumn("_sd", F.when(c("_n") > 1, F.sqrt(sq / (c("_n") - 1))))
    z = F.when((c("_n") > 1) & (c("_sd") > 0), (c("declared_income") - c("_mu")) / (c("_sd") / F.sqrt(c("_n"))))
    f = f.withColumn("_z", F.coalesce(z, F.lit(0.0)))
    limit = F.when(c("income_stability_score") < 0.5, 2.5).otherwise(2.0)
    lci = ratio(c("discretionary_30d"), c("declared_income"))
    over = (c("layer3_lci") > 0.45) & (c("declared_income") > 50_000)
    under = (c("layer3_lci") < 0.05) & (c("declared_income") < 30_000) & (c("cash_dependency_index") > 0.25)
    f = (f.withColumn("layer1_flag", F.abs("_z") > limit)
         .withColumn("layer2_flag", c("p2p_income_fraction") > 0.40)
         .withColumn("layer3_lci", rnd(lci, 4)).withColumn("layer3_flag", over | under)
         .withColumn("layers_triggered", c("layer1_flag").cast("int") + c("layer2_flag").cast("int") + c("layer3_flag").cast("int")))
    direction = (F.when(c("layer1_flag"), F.when(c("_z") > 0, "over_reported").otherwise("under_reported"))
                 .when(over, "over_reported").when(under, "under_reported").otherwise("consistent"))
    return f.select(
        "user_id", rnd(F.coalesce("_mu", F.lit(0.0)), 2).alias("observed_mean_income"), rnd("_z", 4).alias("z_score"),
        "layer1_flag", "layer2_flag", "layer3_lci", "layer3_flag", "layers_triggered", direction.alias("direction"),
        F.when(c("layers_triggered") <= 1, "LOW").when(c("layers_triggered") == 2, "MEDIUM").otherwise("HIGH").alias("severity"),
        rnd(c("layers_triggered") / 3.0 * 0.7 + F.least(F.abs("_z") / 3.0, F.lit(1.0)) * 0.3, 4).alias("confidence"))


def follow_up_reason(low_confidence: Column, layers: Column, first_run: Column) -> Column:
    return (F.when(low_confidence, "low_posterior_confidence")
            .when(layers >= 2, "income_contradiction_multi_layer")
            .when((c("debit_failure_rate_90d") > 0.12) & c("anomaly_flag"), "stress_anomaly_combined")
            .when(c("merchant_category_shift_count") > 3, "sudden_behavioral_shift")
            .when(first_run, "first_run_baseline").otherwise(""))


def proxy_label(noise: Column | None = None) -> Column:
    """Additive threshold score in [0.05, 0.95]; all rules that hold are added."""
    s = F.lit(K.LABEL_BASE)
    for col, op, bound, inc in K.LABEL_RULES:
        x = c(col).cast("double")
        hit = {">": x > bound, "<": x < bound, "=": x == bound, "0<x<": (x > 0) & (x < bound)}[op]
        s = s + F.when(hit, inc).otherwise(0.0)
    floor, inc = K.LABEL_SHORT_TERM
    s = s + F.when((c("income_7d") < c("discretionary_7d")) & (c("discretionary_7d") > floor), inc).otherwise(0.0)
    return rnd(clip(s + noise if noise is not None else s, *K.LABEL_RANGE), 4)


# ------------------------------------------------------------------- credit

def credit_band(score: Column) -> Column:
    out = None
    for name, cfg in K.CREDIT_BANDS.items():
        hit = score.between(cfg[0], cfg[1])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("high_risk")


def _band(col: int, band: Column) -> Column:
    return lookup(band, {k: v[col] for k, v in K.CREDIT_BANDS.items()})


def loan_terms(df: DataFrame, score: str = "credit_score", p: str = "probability_of_default") -> DataFrame:
    """Band, loan limit by expected loss, tenure and rate."""
    d = df.withColumn("risk_band", credit_band(c(score)))
    lo, hi = _band(4, c("risk_band")), _band(5, c("risk_band"))
    cap = K.MAX_EXPECTED_LOSS / (F.greatest(c(p), F.lit(1e-4)) * K.LOSS_GIVEN_DEFAULT)
    return d.withColumns({
        "loan_amount": rnd(F.least(cap, _band(2, c("risk_band")) * 100_000.0), 2),
        "tenure_months": _band(3, c("risk_band")),
        "apr": rnd(lo + (hi - lo) * F.least(c(p), F.lit(1.0)), 2),
        "guarantee_eligible": _band(6, c("risk_band")),
    })


def rule_trace() -> Column:
    """One struct per rule: value, threshold, result."""
    def rule(name, value, threshold, ok, na=None):
        res = F.when(ok, "PASSED")
        if na is not None:
            res = res.when(na, "N/A")
        return F.struct(value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"),
                        res.otherwise("FAILED").alias("result")).alias(name)
    no_gst = c("gstin").isNull()
    return F.struct(
        rule("emi_burden_check", rnd("emi_burden_ratio", 3), 0.5, c("emi_burden_ratio") <= 0.5),
        rule("savings_rate_check", rnd("savings_rate", 3), 0.0, c("savings_rate") >= 0),
        rule("cash_buffer_check", rnd("cash_buffer_days", 1), 15.0, c("cash_buffer_days") >= 15),
        rule("debit_failure_check", rnd("debit_failure_rate_90d", 3), 0.1, c("debit_failure_rate_90d") <= 0.1),
        rule("income_stability_check", rnd("income_stability_score", 3), 0.5, c("income_stability_score") >= 0.5),
        rule("anomaly_check", c("anomaly_flag").cast("int"), 0.0, ~c("anomaly_flag")),
        rule("net_cashflow_check", rnd("net_cashflow_30d", 2), 0.0, c("net_cashflow_30d") >= 0),
        rule("msme_gst_check", rnd("gst_filing_compliance_rate", 3), 0.8, c("gst_filing_compliance_rate") >= 0.8, no_gst),
        rule("msme_receivables_gap_check", rnd("gst_upi_receivables_gap", 3), 0.4, c("gst_upi_receivables_gap") <= 0.4, no_gst),
    )


TRACE = ["emi_burden_check", "savings_rate_check", "cash_buffer_check", "debit_failure_check", "income_stability_check",
         "anomaly_check", "net_cashflow_check", "msme_gst_check", "msme_receivables_gap_check"]


def route(completeness: Column) -> Column:
    return F.when(completeness < 0.7, "income_heavy").otherwise("full")


def boosted(df: DataFrame, p: str, delta: str) -> DataFrame:
    """Score from p, lifted for an improving trajectory; p follows the lifted score."""
    d = df.withColumn("_s", bureau_score(c(p)))
    d = d.withColumn("boost", F.when(c(delta) > 0, F.least(F.bround(c(delta) * 50, 0), F.lit(75.0))).otherwise(0.0).cast("int"))
    d = d.withColumn("credit_score", F.when(c(delta) > 0, F.least(F.greatest(c("_s") + c("boost"), F.lit(300)), F.lit(900))).otherwise(c("_s")))
    return d.withColumn("probability_of_default", F.when(c(delta) > 0, (900 - c("credit_score")) / 600.0).otherwise(c(p))).drop("_s")


# ------------------------------------------------------------------- offers

def short_band(risk: Column) -> Column:
    return F.when(risk <= 0.30, "low_risk").when(risk <= 0.60, "medium_risk").otherwise("high_risk")


TENURES = [3, 6, 9, 12]


def offers(state: DataFrame, floor_days: float = 5.0) -> DataFrame:
    """Pre-qualified amount and rate, one row per tenure with its instalment."""
    stress = clip((floor_days - c("cash_buffer_days")) / 5.0, 0, 1)
    score = display_score(c("risk_score"))
    base = F.greatest(F.lit(15_000.0), F.least(F.lit(150_000.0), 20_000.0 + (score - 300) * 120.0))
    apr = F.when(score >= 760, 13.0).when(score >= 680, 16.0).when(score >= 600, 19.5).otherwise(24.0)
    return (state.select("user_id", "version", score.alias("display_score"), short_band(c("risk_score")).alias("risk_band"),
                         even(rnd(base * (0.85 + stress * 0.2), 6), 100.0).alias("approved_amount"), apr.alias("apr"))
            .withColumn("tenure_months", F.explode(F.array(*[F.lit(t) for t in TENURES])))
            .withColumn("monthly_emi", rnd(instalment(c("approved_amount"), c("apr"), c("tenure_months")), 2)))


def restructure(state: DataFrame, proposals: DataFrame) -> DataFrame:
    """Projected state under proposals(user_id, proposed_monthly_emi, moratorium_days)."""
    j = state.join(proposals, "user_id")
    income = F.greatest(F.lit(20_000.0), display_score(c("risk_score")) * 120.0)
    burden = clip(c("proposed_monthly_emi") / income, 0, 2)
    boost = (F.greatest(F.lit(0.0), (c("emi_burden_ratio") - burden) * 14.0)
             + F.when(c("moratorium_days") > 0, F.least(F.lit(10.0), c("moratorium_days") / 6.0)).otherwise(0.0))
    delta = rnd((burden - c("emi_burden_ratio")) * 0.28 - boost / 100.0, 4)
    risk = rnd(clip(c("risk_score") + delta, 0, 1), 4)
    return j.select("user_id", "tenure_months", rnd(burden, 4).alias("projected_burden"),
                    rnd(F.least(F.lit(90.0), c("cash_buffer_days") + boost), 2).alias("projected_buffer_days"),
                    risk.alias("projected_risk"), short_band(risk).alias("projected_band"))


# ----------------------------------------------------------------- triggers

def triggers(state: DataFrame) -> DataFrame:
    """Zero to many alert rows per state row; needs previous_volatility."""
    low = c("liquidity_health") == "LOW"
    buf, vol, emi = c("cash_buffer_days"), c("spending_volatility"), c("emi_burden_ratio")
    prev = c("previous_volatility")
    growth = (vol - prev) / F.greatest(prev, F.lit(0.01))

    def alert(name, when, urgency, measure=None):
        priority, channels = K.TRIGGERS[name]
        text = K.TRIGGER_REASONS[name]
        texts = lambda xs: F.array(*[F.lit(x) for x in xs])
        return F.when(when, F.struct(F.lit(name).alias("trigger_type"), F.lit(priority).alias("priority"), rnd(urgency, 4).alias("urgency"),
                                     texts(channels).alias("channels"), (F.lit(text) if measure is None else F.format_string(text, measure)).alias("reason"),
                                     texts(K.TRIGGER_ACTIONS[name]).alias("suggested_actions")))
    pct = lambda x: rnd(x * 100, 0).cast("int")
    alerts = F.array(
        alert("liquidity_drop", low | (buf < 10), F.when(low, 0.9).otherwise(0.7), rnd(buf, 1)),
        alert("prequalified_micro_loan_offer", low & (buf < 7), F.least(F.lit(0.98), 0.75 + (7.0 - buf) * 0.03), rnd(buf, 1)),
        alert("overspend_warning", vol > 0.65, F.least(F.lit(0.9), vol), rnd(vol, 2)),
        alert("emi_at_risk", emi > 0.35, F.least(F.lit(0.95), emi), pct(emi)),
        alert("lifestyle_inflation", prev.isNotNull() & (growth > 0.25), F.lit(0.5), pct(F.coalesce(growth, F.lit(0.0)))),
        alert("savings_opportunity", (buf > 20) & (emi < 0.25) & (c("risk_score") < 0.35), F.lit(0.2)),
        alert("fraud_anomaly", c("persona") == "shell_circular", F.lit(0.95)),
        alert("new_to_credit_guidance", c("persona") == "new_to_credit", F.lit(0.1)),
    )
    return (state.select("user_id", "version", "ts", "persona",
                         F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("a"))
            .select("user_id", "version", "ts", "persona", "a.*"))


def by_priority(alerts: DataFrame) -> DataFrame:
    """Order of alerts within one state: priority, then urgency."""
    w = W.partitionBy("user_id", "version").orderBy(lookup(c("priority"), K.PRIORITY_ORDER), F.desc("urgency"), "trigger_type")
    return alerts.withColumn("alert_order", F.row_number().over(w))


def relevance(urgency: Column, personalization: float | Column = 0.5, acceptance: float | Column = 0.5,
              safety: float | Column = 1.0) -> Column:
    as_c = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return rnd(0.4 * urgency + 0.3 * as_c(personalization) + 0.2 * as_c(acceptance) + 0.1 * as_c(safety), 4)


def notifications(alerts: DataFrame, consent: DataFrame, threshold: float = 0.75, personalization: float = 0.7,
                  acceptance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(messages to send per channel, alerts escalated to a person).

    Fraud alerts are never sent to the user. consent(user_id, consent).
    """
    fraud = (c("trigger_type") == "fraud_anomaly") & (c("persona") == "shell_circular")
    rel = relevance(c("urgency"), personalization, acceptance)
    ready = alerts.where(~fraud).withColumn("relevance", rel).where(c("relevance") >= threshold)
    ok = ready.join(consent.where("consent").select("user_id"), "user_id", "left_semi")
    sent = ok.select("user_id", "version", "ts", "trigger_type", "priority", "relevance", F.explode("channels").alias("channel"),
                     lookup(c("trigger_type"), K.ALERT_TITLES, K.OTHER_ALERT).alias("title"), c("reason").alias("body"))
    return sent, alerts.where(fraud)


def reports(state: DataFrame) -> DataFrame:
    """Daily report row: status label, insight lines and actions."""
    score = display_score(c("risk_score"))
    buf, emi, vol, stab = c("cash_buffer_days"), c("emi_burden_ratio"), c("spending_volatility"), c("income_stability")
    pct = lambda x: F.round(x * 100, 0).cast("int").cast("string")
    line = lambda when, *parts: F.when(when, F.concat(*parts))
    yes = F.lit(True)
    days = F.round(buf, 1).cast("string")
    insights = F.array(
        line(yes, F.lit("display_score="), score.cast("string")),
        line(yes, F.lit("cash_buffer_days="), days, F.lit(" ("), c("liquidity_health"), F.lit(")")),
        line(yes, F.lit("emi_burden_percent="), pct(emi), F.when(emi > 0.35, " (over 35)").otherwise("")),
        line(vol > 0.65, F.lit("spending_volatility_percent="), pct(vol), F.lit(" (over 65)")),
        line((stab > 0.75) | (stab < 0.4), F.lit("income_stability_percent="), pct(stab), F.when(stab > 0.75, " (over 75)").otherwise(" (under 40)")))
    advice = lambda when, name: F.when(when, F.lit(K.REPORT_ACTIONS[name]))
    actions = F.filter(F.array(advice(buf < 10, "buffer"), advice(emi > 0.35, "emi"), advice(vol > 0.65, "spending"),
                               advice(stab < 0.4, "income")), lambda a: a.isNotNull())
    return state.select("user_id", "version", score.alias("display_score"),
                        level(score, (750, "Excellent"), (650, "Good"), (550, "Average"), default="Needs Attention").alias("risk_status"),
                        F.filter(insights, lambda a: a.isNotNull()).alias("insights"),
                        F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit(K.REPORT_ACTIONS["none"]))).alias("actions"))


# ------------------------------------------------------ ordered fallbacks

def eligibility(users: DataFrame, live: DataFrame, offer: DataFrame) -> DataFrame:
    """Working-capital and term amounts: live decision, then offer, then income times a risk multiple.

    users(user_id, income_monthly, risk_score); live(user_id, credit_limit, loan_amount); offer(user_id, approved_amount).
    """
    j = users.join(live, "user_id", "left").join(offer, "user_id", "left")
    mult = F.when(c("risk_score") < 0.30, 4.5).when(c("risk_score") < 0.60, 3.0).otherwise(1.8)
    wc = F.coalesce("credit_limit", "loan_amount", "approved_amount", c("income_monthly") * mult)
    term = F.coalesce(c("loan_amount"), c("credit_limit"), c("approved_amount") * 1.4, wc * 1.6)
    return j.select("user_id", rnd(wc, 2).alias("wc_eligible"), rnd(term, 2).alias("term_eligible"))


def simulation_inputs(users: DataFrame) -> DataFrame:
    """Snapshot of inputs by ordered fallbacks: provided (p_*), state (s_*), features.

    Missing columns count as null. Feature columns keep their own names.
    """
    have = set(users.columns)
    g = lambda n: c(n).cast("double") if n in have else F.lit(None).cast("double")
    first = lambda n, *more: F.coalesce(g(f"p_{n}"), g(f"s_{n}"), *more)
    fv = F.lit("savings_rate" in have)
    u = users.withColumn("_inc", first("income_monthly", g("income_30d"), F.when(g("income_90d") != 0, g("income_90d") / 3)))
    need = F.coalesce(first("essential_expense_monthly"), F.lit(0.0)) + F.coalesce(first("discretionary_expense_monthly"), F.lit(0.0)) \
        + F.coalesce(first("emi_monthly"), F.lit(0.0))
    u = u.withColumn("income_monthly", F.when(c("_inc") > 0, c("_inc"))
                     .when(need > 0, F.greatest(F.lit(10_000.0), need * 1.35)).otherwise(50_000.0))
    inc = c("income_monthly")
    ess = first("essential_expense_monthly", g("essential_30d"))
    guess = inc * clip(1.0 - g("savings_rate") - g("discretionary_ratio"), 0.1, 0.9)
    u = u.withColumn("essential_expense_monthly", F.when(ess > 0, ess).otherwise(F.coalesce(F.when(fv & (guess > 0), guess), inc * 0.50)))
    disc = first("discretionary_expense_monthly", g("discretionary_30d"))
    u = u.withColumn("discretionary_expense_monthly", F.when(disc >= 0, disc).otherwise(
        F.coalesce(inc * clip(g("discretionary_ratio"), 0, 0.8), inc * 0.25)))
    emi = first("emi_monthly", g("emi_burden_ratio") * inc)
    u = u.withColumn("emi_monthly", F.when(emi > 0, emi).otherwise(F.greatest(F.lit(1.0), inc * 0.18)))
    buf = first("cash_buffer_days", g("cash_buffer_days"))
    u = u.withColumn("_buf", F.when(buf >= 0, buf).otherwise(12.0))
    u = u.withColumn("_stab", first("income_stability", g("income_stability_score"), F.lit(0.55)))
    u = u.withColumn("_vol", first("spending_volatility", g("spending_volatility_index"), F.lit(0.40)))
    by_features = clip(0.30 * clip(g("emi_burden_ratio") / 1.2, 0, 1.2) + 0.25 * clip(g("debit_failure_rate_90d"), 0, 1)
                       + 0.20 * clip(g("spending_volatility_index") / 3.0, 0, 1) + 0.15 * clip(1.0 - g("income_stability_score"), 0, 1)
                       + 0.10 * clip(1.0 - g("cash_buffer_days") / 30.0, 0, 1), 0, 1)
    by_inputs = clip(0.45 * clip(c("emi_monthly") / F.greatest(inc, F.lit(1.0)), 0, 1.5) + 0.35 * clip(1.0 - c("_buf") / 30.0, 0, 1)
                     + 0.20 * clip(c("_vol") / 1.2, 0, 1), 0, 1)
    u = u.withColumn("_risk", first("risk_score", by_features, by_inputs))
    u = u.withColumn("_fail", first("debit_failure_rate", g("debit_failure_rate_90d"), F.lit(0.0)))
    u = u.withColumn("_over", first("emi_overdue_count", F.bround(clip(c("_fail") * 3.0, 0, 3), 0)))
    outflow = F.greatest((c("essential_expense_monthly") + c("discretionary_expense_monthly") + c("emi_monthly")) / 30.0, F.lit(1.0))
    dep = clip(F.coalesce(g("s_credit_dependency_score"), clip(c("emi_monthly") / F.greatest(inc, F.lit(1.0)), 0, 1.2)), 0, 1.2)
    casc = first("cascade_susceptibility", clip(0.45 * dep + 0.35 * clip(c("_vol"), 0, 1) + 0.20 * clip(c("_fail"), 0, 1), 0, 1))
    r4 = lambda x, n: rnd(x, 4).alias(n)
    return u.select(
        "user_id", r4(clip(c("_stab"), 0, 1), "income_stability"), r4(clip(c("_vol"), 0, 1), "spending_volatility"),
        F.when(c("_buf") < 5, "LOW").when(c("_buf") <= 15, "MEDIUM").otherwise("HIGH").alias("liquidity_health"),
        r4(clip(c("_risk"), 0, 1), "risk_score"), r4(F.greatest(c("_buf"), F.lit(0.0)), "cash_buffer_days"),
        r4(F.greatest(c("emi_monthly"), F.lit(1.0)), "emi_monthly"),
        F.greatest(c("_over"), F.lit(0.0)).cast("int").alias("emi_overdue_count"), r4(clip(c("_fail"), 0, 1), "debit_failure_rate"),
        r4(first("cash_balance_current", c("_buf") * outflow), "cash_balance_current"), r4(clip(casc, 0, 1), "cascade_susceptibility"),
        r4(inc, "income_monthly"), r4(c("essential_expense_monthly"), "essential_expense_monthly"),
        r4(c("discretionary_expense_monthly"), "discretionary_expense_monthly"),
        r4(F.greatest(first("overdraft_limit", inc * 0.2), F.lit(0.0)), "overdraft_limit"))


def regime_posterior(obs: DataFrame) -> DataFrame:
    """Regime shares after one observation; long form, one row per regime.

    obs(user_id, kind, value, mean_income, sigma, p_STABLE, p_STRESSED, p_CRISIS).
    """
    expected = lambda r: c("mean_income") * K.REGIME_INCOME_MULTIPLIER[r]
    items = []
    for reg in K.REGIMES:
        diff = (F.log(c("value")) - F.log(expected(reg))) / c("sigma")
        like = (F.when(c("kind") == "income", F.when((c("value") > 0) & (expected(reg) > 0), F.exp(-0.5 * diff * diff)).otherwise(0.01))
                .when(c("kind") == "emi_paid", K.REGIME_INSTALMENT_LIKELIHOOD[reg]).otherwise(1.0))
        items.append(F.struct(F.lit(reg).alias("regime"), F.greatest(like * c(f"p_{reg}"), F.lit(1e-10)).alias("w")))
    o = obs.withColumn("_w", F.array(*items))
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"])
    return (o.withColumn("_t", total).withColumn("x", F.explode("_w"))
            .select("user_id", "x.regime", rnd(c("x.w") / c("_t"), 4).alias("posterior")))


def display_bands(risk: Column, compliance: Column) -> list[Column]:
    return [F.when(risk < 0.30, "LOW RISK").when(risk < 0.60, "MEDIUM RISK").otherwise("HIGH RISK").alias("risk_level"),
            F.when(compliance.isNull(), "limited").when(compliance >= 0.90, "strong").when(compliance >= 0.70, "moderate")
            .otherwise("weak").alias("filing_class")]


def estimates(df: DataFrame) -> DataFrame:
    """Monthly income and expense with fallbacks; needs inbound_30d and outbound_30d."""
    z = lambda n: F.coalesce(c(n), F.lit(0.0))
    income = F.when(c("income_30d") > 0, c("income_30d")).otherwise(z("inbound_30d"))
    known = z("essential_30d") + z("discretionary_30d")
    expense = F.when(known > 0, known).when(c("outbound_30d") > 0, c("outbound_30d")).otherwise(0.0)
    d = df.withColumn("income_est", F.greatest(F.lit(0.0), income)).withColumn("expense_est", F.greatest(F.lit(0.0), expense))
    i, e = c("income_est"), c("expense_est")
    sav = F.when((z("savings_rate") <= 0) & (i > 0), clip((i - e) / F.greatest(i, F.lit(1.0)), -1, 1)).otherwise(z("savings_rate"))
    dcr = F.when(i > 0, clip(e / F.greatest(i, F.lit(1.0)), 0, 2)).otherwise(0.0)
    util = clip(0.15 + 0.6 * F.coalesce(c("cash_dependency_index"), F.lit(0.25)), 0.05, 0.95) * 100.0
    return d.withColumns({"savings_est": rnd(sav, 4), "debit_credit_ratio": rnd(dcr, 4), "utilisation": rnd(util, 4),
                          "income_est": rnd(i, 2), "expense_est": rnd(e, 2)})


def health_index(df: DataFrame, deception: Column) -> DataFrame:
    """0-100 from five clamped parts, and its band; reads estimates() and state columns."""
    one = lambda x: clip(x, 0, 1)
    credit = one((F.least(F.greatest(display_score(c("risk_score")), F.lit(300)), F.lit(900)) - 300.0) / 600.0)
    liq = one(0.60 * one(c("cash_buffer_days") / 30.0) + 0.40 * c("liquidity_health_index"))
    stab = one(0.65 * c("income_stability_score") + 0.35 * (1.0 - one(c("spending_volatility_index") / 1.5)))
    beh = one(0.35 * one((c("savings_est") + 0.10) / 0.60) + 0.25 * (1.0 - one(c("emi_burden_ratio") / 0.60))
              + 0.20 * (1.0 - one(c("debit_credit_ratio") / 1.20)) + 0.20 * (1.0 - one(c("utilisation") / 100.0 / 0.90)))
    net = 1.0 - one(F.coalesce(deception, F.lit(0.08)))
    total = 100.0 * (0.30 * credit + 0.20 * liq + 0.20 * stab + 0.20 * beh + 0.10 * net)
    d = df.withColumn("health_index", F.least(F.greatest(rnd(total, 0), F.lit(0.0)), F.lit(100.0)).cast("int"))
    return d.withColumn("health_band", level(c("health_index"), (70, "low_risk"), (45, "medium_risk"), default="high_risk"))


def distress(state: DataFrame) -> DataFrame:
    """Users to be offered relief, with the intent flag appended.

    Needs ews_14d, ews_30d and an intent_signals array of strings.
    """
    hit = (c("liquidity_health") == "LOW") | (F.coalesce(c("ews_14d"), F.lit(0.0)) >= 0.35)
    return (state.where(hit).withColumn("signal_probability", rnd(F.least(F.lit(0.99), F.coalesce(c("ews_30d"), F.lit(0.5))), 4))
            .withColumn("intent_signals", F.concat("intent_signals", F.array(F.lit("EMI_STRESS_IMMINENT")))))


def question_ranking(fv: DataFrame, top: int = 5) -> DataFrame:
    """Signals worth asking about, by how much an answer would reduce uncertainty.

    Needs max_posterior and contradiction_layers next to the features.
    """
    proxy = (c("emi_burden_ratio") * 0.35 + c("debit_failure_rate_90d") * 0.25 + (1 - c("income_stability_score")) * 0.20
             + c("spending_volatility_index") * 0.20)

    def item(name, when, template, feature=None, boost=1.0):
        weight = K.SIGNAL_IMPORTANCE.get(feature or name, K.DEFAULT_IMPORTANCE)
        urs = rnd(weight * (1.0 - F.least(c("max_posterior"), F.lit(1.0))) * (0.3 + 0.7 * proxy), 4) * boost
        return F.when(when, F.struct(F.lit(name).alias("signal"), rnd(urs, 6).alias("urs"), F.lit(template).alias("template")))
    items = F.array(
        item("income_contradiction", c("contradiction_layers") >= 2, "income_clarify", "income_stability_score", 1.5),
        item("emi_burden_ratio", c("emi_burden_ratio") > 0.40, "future_commitment"),
        item("lifestyle_inflation_trend", F.abs("lifestyle_inflation_trend") > 0.15, "expense_explain"),
        item("cash_buffer_days", c("cash_buffer_days") < 10, "asset_disclosure"),
        item("merchant_category_shift_count", c("merchant_category_shift_count") > 3, "behavioral_intent"),
        item("debit_failure_rate_90d", c("debit_failure_rate_90d") > 0.10, "future_commitment"))
    w = W.partitionBy("user_id").orderBy(F.desc("urs"), "signal")
    return (fv.select("user_id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i")).select("user_id", "i.*")
            .withColumn("rank", F.row_number().over(w)).where(c("rank") <= top))


# ------------------------------------------------------- audit and decisions

def recalibrate(prior: DataFrame, fresh: DataFrame, moved: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(updated decisions, limit reductions).

    A user is rescored when throughput moved by 15 % or was not positive before;
    a limit below 95 % of the old one is reported.
    prior(user_id, loan_amount, throughput); fresh(user_id, throughput, credit_score, risk_band, loan_amount, ...).
    """
    p = prior.select("user_id", c("loan_amount").alias("prev_loan"), c("throughput").alias("prev_throughput"))
    j = fresh.join(p, "user_id")
    change = F.when(c("prev_throughput") > 0, F.abs(c("throughput") - c("prev_throughput")) / c("prev_throughput"))
    updated = j.where(change.isNull() | (change >= moved))
    cut = updated.where((c("prev_loan") > 0) & (c("loan_amount") < c("prev_loan") * 0.95)).select(
        "user_id", "prev_loan", c("loan_amount").alias("new_loan"),
        rnd((c("prev_loan") - c("loan_amount")) / c("prev_loan") * 100, 1).alias("reduction_pct"))
    return updated, cut


def replay(audit: DataFrame, since: datetime, kinds: list[str] | None = None) -> DataFrame:
    """Audit records since a time, filtered by type before anything is cut off."""
    a = audit.where(c("ts") >= ntz(since))
    return a.where(c("event_type").isin(kinds)) if kinds else a


def freshest_score(aliases: DataFrame, scores: DataFrame, fallback: DataFrame) -> DataFrame:
    """Latest valid score over all ids of an entity, else the fallback's.

    aliases(entity, id); scores(id, credit_score, refreshed_at); fallback(id, credit_score).
    """
    live = (aliases.join(scores.where(c("credit_score") > 0), "id").groupBy("entity")
            .agg(F.max_by("credit_score", F.struct(F.coalesce("refreshed_at", F.lit("0001-01-01").cast("timestamp_ntz")), "id")).alias("live")))
    back = (aliases.join(fallback.where(c("credit_score") > 0), "id").groupBy("entity")
            .agg(F.max_by("credit_score", "id").alias("back")))
    j = aliases.select("entity").distinct().join(live, "entity", "left").join(back, "entity", "left")
    s = F.coalesce("live", "back")
    return j.select("entity", F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(300)), F.lit(900))).alias("credit_score"),
                    F.when(c("live").isNotNull(), "live").when(c("back").isNotNull(), "fallback").alias("source"))
