"""Queries for the aggregation operators."""

from __future__ import annotations

from fintrail.functions import constants as K
from fintrail.operators import features as FT
from fintrail.plans import tables as T
from fintrail.plans.registry import query
from fintrail.plans.sql import REF, US_DAY, r


def _from_fv(name: str, cols: list[str], full: bool = False) -> None:
    """A query for some columns of the vector; the plan prunes the other aggregates."""
    src = "fv" if full else "fx"
    sel = ", ".join(["user_id", *cols])

    @query(name, f"SELECT {sel} FROM {src}")
    def _(spark, d):
        df = T.fv(spark, d) if full else FT.account_features(T.ev(spark, d), T.REF)
        return df.select("user_id", *cols)


SCALARS = [f"{n}_{w}d" for n in ("income", "essential", "discretionary") for w in (7, 30, 90)]

_from_fv("features_90d", [c for c in K.FEATURE_COLUMNS] + ["income_band", "city_tier", "age_group"], full=True)
_from_fv("a1_window_type_sums", [*SCALARS, "emi_30d", "emi_90d", "subscription_30d"])
_from_fv("a2_net_cashflow", ["net_cashflow_7d", "net_cashflow_30d", "net_cashflow_90d"])
_from_fv("a3_decayed_throughput", ["daily_avg_throughput_30d"])
_from_fv("a5_cash_buffer", ["cash_buffer_days"])
_from_fv("a6_debit_failure_rate", ["debit_failure_rate_90d"])
_from_fv("a7_month_end_dip", ["end_of_month_liquidity_dip"])
_from_fv("a8_emi_burden", ["emi_burden_ratio"])
_from_fv("a9_savings_rate", ["savings_rate"])
_from_fv("a10_income_stability", ["income_stability_score"])
_from_fv("a11_spending_volatility", ["spending_volatility_index"])
_from_fv("a12_spend_ratios", ["discretionary_ratio", "cash_dependency_index"])
_from_fv("a13_recurring_counts", ["subscription_count_30d", "emi_payment_count_90d"])
_from_fv("a14_failure_flag", ["anomaly_flag"])
_from_fv("a15_salary_spike", ["salary_day_spike_flag"])
_from_fv("a16_lifestyle_inflation", ["lifestyle_inflation_trend"])


@query("a4_decayed_count", f"""SELECT user_id,
  {r(f"sum(exp(-(ln(2) / 15.0) * greatest(0.0, (epoch_us({REF}) - epoch_us(ts)) / {US_DAY})))")} AS decayed_count
  FROM ev WHERE ts >= {REF} - INTERVAL 30 DAY AND ts <= {REF} GROUP BY user_id""")
def a4(spark, d):
    return FT.decayed_count(T.ev(spark, d), T.REF, half_life=15.0)


@query("a17_category_shift", "SELECT user_id, CAST(shift AS INTEGER) AS merchant_category_shift_count FROM fx_shift")
def a17(spark, d):
    return FT.category_shift(T.ev(spark, d), T.REF)


@query("a18_top3_concentration", f"SELECT user_id, {r('hhi')} AS top3_merchant_concentration FROM fx_top3")
def a18(spark, d):
    return FT.top_merchants(T.ev(spark, d), T.REF)
