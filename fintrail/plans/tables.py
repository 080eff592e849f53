"""Binding of the given tables to the event model.

Each function is a lazy plan over `<dir>/<name>.parquet`; only the columns a
query uses are read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import ntz
from fintrail.operators import features as FT, twin as TW
from fintrail.session import scratch

REF = datetime(2024, 1, 31)
SCENARIO_DAYS = 30                  # length of the what-if scenarios


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(k: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def as_events(raw: DataFrame) -> DataFrame:
    """Typed canonical events from the `events` layout (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    return raw.withColumn("k", k).select(
        "event_id", "user_id", "ts", "k",
        F.when(et == "signup", F.round(4 * F.col("value"), 2))
         .otherwise(F.round(-F.col("value"), 2)).alias("amount"),
        F.concat(F.lit("M"), F.col("k") % 20).alias("merchant_name"),
        F.when(F.col("k") % 3 == 0, "UPI").otherwise("BANK_TRANSFER").alias("channel"),
        _pick(F.col("k"), K.PROVENANCE[:6]).alias("source_provenance"),
        F.when((et == "error") & (F.col("k") % 2 == 0), "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(F.col("k") % 2 == 0, "P2M").otherwise("P2P").alias("txn_kind"),
        F.when(et == "signup", "INCOME").when(et == "click", "EXPENSE_ESSENTIAL")
         .when(et == "purchase", "EXPENSE_DISCRETIONARY").when(et == "view", "EMI_PAYMENT")
         .when(et == "error", "SUBSCRIPTION").alias("transaction_type"),
        _pick(F.col("k"), K.CATEGORIES).alias("merchant_category"))


def ev(spark: SparkSession, d: str) -> DataFrame:
    return as_events(table(spark, d, "events"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    bal = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("upi"), F.col("c_custkey")).alias("upi_id"),
        F.concat(F.lit("G"), F.col("c_custkey")).alias("gstin"),
        F.concat(F.lit("vpa"), F.col("c_custkey")).alias("vpa"),
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("node"),
        (F.col("c_nationkey") % 4 + 1).cast("int").alias("city_tier"),
        F.when(bal < 2000, "low").when(bal < 6000, "mid").otherwise("high").alias("income_band"),
        F.when(seg == "AUTOMOBILE", "18-25").when(seg == "BUILDING", "26-35")
         .when(seg == "FURNITURE", "36-45").when(seg == "HOUSEHOLD", "46-55")
         .otherwise("56+").alias("age_group"),
        (F.col("c_custkey") % 36).cast("int").alias("months_active"))


def invoices(spark: SparkSession, d: str) -> DataFrame:
    st = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("taxable_value"),
        F.when(st == "F", "ontime").when(st == "O", "delayed").otherwise("missing").alias("filing_status"),
        F.when(st == "F", 0).otherwise((F.col("o_orderkey") % 45).cast("int")).alias("filing_delay_days"))


def _net_price() -> Column:
    # the product has four decimals; the nudge sends half-cents up in every engine
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + 1e-7, 2)


def eway(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", _net_price().alias("tot_inv_value"),
        F.concat(F.lit("H"), F.col("l_partkey") % 12).alias("main_hsn_code"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("user_id", F.col("l_shipdate").alias("ts"), "tot_inv_value", "main_hsn_code",
                    "l_orderkey", "l_linenumber"))


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """Transfers between regions: one edge per line item, self-loops still in."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_shipdate", _net_price().alias("amount"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("src"))
    supp = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("dst"))
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("src", "dst", "amount", F.col("l_shipdate").alias("ts"),
                    F.lit("upi").alias("event_type")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return raw_edges(spark, d).where(F.col("src") != F.col("dst"))


def event_table(spark: SparkSession, d: str) -> DataFrame:
    """The typed events, parsed once and dealt out by number for the steps that read them several times.

    A given file has few splits when its row groups are large, and then few tasks do all the work on its events.
    """
    def build(s, p):
        raw = table(s, p, "events")
        return as_events(raw.repartition(FT.user_parts(raw), "user_id", "event_id"))
    return stored(spark, d, "events", build)


def fv(spark: SparkSession, d: str) -> DataFrame:
    """Full feature vectors at REF with profile and invoice features."""
    return FT.features(event_table(spark, d), REF, invoices=invoices(spark, d), eway=eway(spark, d),
                       profiles=profiles(spark, d).drop("node", "upi_id", "vpa"))


# ------------------------------------------------------------ stored stages

_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A pipeline stage written once per application and read by what follows it.

    Scoring jobs read feature and state tables; they do not recompute them.
    """
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = scratch(spark, name)
        build(spark, d).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "features", fv)


def processed_features(spark: SparkSession, d: str) -> DataFrame:
    """The feature table after imputation and flagging: what labels and models read."""
    from fintrail.operators import models as M
    return stored(spark, d, "processed", lambda s, p: M.post_process(feature_table(s, p)))


def twin(spark: SparkSession, d: str) -> DataFrame:
    """State snapshots: one version per active user-day."""
    return stored(spark, d, "twin", lambda s, p: TW.snapshots(event_table(s, p)))


def twin_latest(spark: SparkSession, d: str) -> DataFrame:
    return TW.latest(twin(spark, d))


# --------------------------------------------------- raw sources and messages

MESSAGE_TEMPLATES = [
    "URGENT: your account will be suspended within 24 hours. Share your OTP immediately",
    "Official notice from RBI: Income Tax Department order of court",
    "Your verification code is 482913",
    "Final warning: unauthorized login found, confirm code 559201, action required",
    "Payment of 1,250 to merchant M3 done",
    "Can I afford a car loan of ₹4,50,000 next month?",
    "No, lower EMI please, extend to 12 month tenure",
    "Yes ok, I accept. How can I improve my score in 3 months?",
]


def raw_sources(spark: SparkSession, d: str, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six event sources in their raw shapes, split from `events` by provenance."""
    e = (ev(spark, d) if events is None else events).withColumn("timestamp", F.col("ts"))
    failed = F.col("status") == "FAILED"
    src = lambda p: e.where(F.col("source_provenance") == p)
    head = ["event_id", "user_id", "timestamp"]
    rec = lambda v: F.lit(v).alias("recurrence_flag")
    plain = F.when(failed, "FAILED").otherwise("SUCCESS").alias("status")
    return {
        "bank_transactions": src("bank_api").select(
            *head, "amount", "merchant_name", "channel", (F.col("amount") + 1000).alias("balance_after"),
            F.concat(F.lit("R"), "event_id").alias("reference_id"), plain, rec(False)),
        "upi_transactions": src("upi_api").select(
            *head, "amount", F.when(F.col("amount") > 0, "inbound").otherwise("outbound").alias("direction"),
            "merchant_name", F.lower("txn_kind").alias("txn_type"),
            F.concat(F.lit("upi"), F.col("event_id") % 150).alias("counterparty_upi"),
            F.when(failed, "failed_funds").otherwise("success").alias("status"), rec(False)),
        "sms_alerts": src("sms_parser").select(
            *head, "amount", "merchant_name",
            F.concat(F.lit("Txn at "), "merchant_name", F.when(failed, " was Declined").otherwise(" done")).alias("raw_text"),
            plain, rec(False)),
        "emi_schedules": src("emi_statement").select(
            *head, "amount", "merchant_name", F.when(failed, "OVERDUE").otherwise("PAID").alias("status"), rec(True)),
        "open_banking": src("open_banking_aa").select(
            *head, "amount", F.lit("AA_BALANCE_SNAPSHOT").alias("merchant_name"),
            (F.col("amount") + 2000).alias("balance_after"), plain, rec(False)),
        "voice_transcripts": src("voice_stt_parser").select(
            *head, F.col("amount").alias("extracted_amount"), F.col("merchant_name").alias("extracted_merchant"),
            plain, rec(False)),
    }


def messages(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """User turns of the conversations, and one templated message per event."""
    conv = table(spark, d, "conversations").where(F.col("role") == "user").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("message_id"),
        F.col("conv_id").alias("user_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("string").alias("sender_id"), "text")
    e = ev(spark, d) if events is None else events
    tmpl = e.select(
        F.concat(F.lit("e"), "event_id").alias("message_id"), "user_id", "ts",
        F.when(F.col("k") % 5 == 0, "TM-HDFCBK").otherwise("9876543210").alias("sender_id"),
        _pick(F.col("k"), MESSAGE_TEMPLATES).alias("text"))
    return conv.unionByName(tmpl)


def merchant_texts(spark: SparkSession, d: str) -> DataFrame:
    """Events with descriptive merchant strings, so the merchant rules have work."""
    return ev(spark, d).withColumn("merchant_name", _pick(F.col("k"), MERCHANT_TEXTS))


MERCHANT_TEXTS = [
    "Salary from Employer", "HDFC Home Loan EMI", "ATM cash withdrawal", "Zerodha SIP", "Landlord rent",
    "Netflix monthly", "Apollo Pharmacy", "Airtel broadband", "Uber cab", "Swiggy pizza",
    "Reliance Fresh grocery", "LIC term life", "Coursera tuition", "AA_BALANCE_SNAPSHOT", "Corner shop",
    "Current account", "Loan Services", "Wages Ltd", "Paytm transfer", "Supermart",
]


def region_flows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Invoices and consignments with the node of their owner."""
    p = profiles(spark, d).select("user_id", "node")
    inv = invoices(spark, d).join(p, "user_id").select("node", "ts", F.col("taxable_value").alias("amount"))
    ew = eway(spark, d).join(p, "user_id").select("node", "ts", "tot_inv_value")
    return inv, ew


def region_series(spark: SparkSession, d: str) -> DataFrame:
    """Gap-free daily series per node."""
    from fintrail.operators import timeline as TL
    inv, ew = region_flows(spark, d)
    return TL.filled_series(TL.daily_series(inv, ew, ["node"]), ["node"])


# ------------------------------------------------------------- graph, paths

def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed transfer pairs of all time."""
    from fintrail.operators import graph as G
    return G.collapse(edges(spark, d))


def transfers(spark: SparkSession, d: str) -> DataFrame:
    """Instant payments between accounts: event_id, src, dst, amount, ts; self-payments still in."""
    from fintrail.operators import joins as J
    upi = J.counterparties(raw_sources(spark, d, event_table(spark, d))["upi_transactions"], profiles(spark, d))
    return upi.select("event_id", F.col("user_id").alias("src"), F.col("counterparty").alias("dst"), F.abs("amount").alias("amount"),
                      F.col("timestamp").alias("ts"))


def account_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed pairs of accounts that pay each other."""
    from fintrail.operators import graph as G
    return stored(spark, d, "account_pairs", lambda s, p: G.collapse(transfers(s, p).where("src <> dst")))


def account_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer to supplier payments and supplier to customer refunds."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_returnflag", F.concat(F.lit("S"), "l_suppkey").alias("s"))
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("cst"))
    j = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    pay = j.select(F.col("cst").alias("src"), F.col("s").alias("dst"))
    return pay.unionByName(j.where("l_returnflag = 'R'").select(F.col("s").alias("src"), F.col("cst").alias("dst")))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    """Daily cash flows by kind, dense from the first day of the data to the last."""
    e = ev(spark, d)
    first, last = e.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    e = e.where("ts is not null").withColumn("day", F.datediff(F.to_date("ts"), F.lit(first)))
    days = (last - first).days if first else 0
    t = F.col("transaction_type")
    amt = lambda *k: F.round(F.coalesce(F.sum(F.when(t.isin(*k), F.abs("amount"))), F.lit(0.0)), 2)
    daily = e.groupBy(F.col("user_id").alias("path_id"), "day").agg(
        amt("INCOME").alias("income"), amt("EXPENSE_ESSENTIAL").alias("essential"),
        amt("EXPENSE_DISCRETIONARY").alias("discretionary"), amt("EMI_PAYMENT", "SUBSCRIPTION").alias("emi"))
    grid = daily.select("path_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days))))
    cols = ["income", "essential", "discretionary", "emi"]
    return grid.join(daily, ["path_id", "day"], "left").fillna(0.0, subset=cols)


def flows(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "flows", _flows)


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Observed balances: 2,000 plus the running net of the flows."""
    from pyspark.sql import Window as W
    w = W.partitionBy("path_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    net = F.col("income") - F.col("essential") - F.col("discretionary") - F.col("emi")
    return flows(spark, d).select("path_id", "day", F.round(F.lit(2000.0) + F.sum(net).over(w), 2).alias("balance"))
