"""Canonicalisation, validation and identity of events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fintrail.functions import constants as K
from fintrail.functions.rules import lookup

BLANKS = {"channel": "string", "balance_after": "double", "reference_id": "string"}


def status(raw: Column) -> Column:
    """Canonical status; anything unknown counts as SUCCESS."""
    return lookup(F.lower(raw), K.STATUS_MAP, "SUCCESS")


def _slim(df: DataFrame, provenance: str, **over: Column) -> DataFrame:
    base = {"event_id": F.col("event_id"), "user_id": F.col("user_id"), "ts": F.col("timestamp"),
            "amount": F.col("amount"), "merchant_name": F.col("merchant_name"),
            "source_provenance": F.lit(provenance), "status": status(F.col("status")),
            "recurrence_flag": F.col("recurrence_flag")}
    base.update(over)
    return df.select(*[c.alias(n) for n, c in base.items()])


def canonicalise(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Union of whichever raw sources are given, as canonical events."""
    shapes = {
        "bank_transactions": ("bank_api", dict(channel=F.col("channel"), balance_after=F.col("balance_after"),
                                               reference_id=F.col("reference_id"))),
        "upi_transactions": ("upi_api", dict(channel=F.lit("UPI"),
                                             reference_id=F.substring(F.col("event_id").cast("string"), 1, 8))),
        "sms_alerts": ("sms_parser", {}),
        "emi_schedules": ("emi_statement", dict(channel=F.lit("EMI"))),
        "open_banking": ("open_banking_aa", dict(balance_after=F.col("balance_after"))),
        "voice_transcripts": ("voice_stt_parser", dict(amount=F.col("extracted_amount"),
                                                       merchant_name=F.col("extracted_merchant"))),
    }
    out = None
    for name, (prov, over) in shapes.items():
        if name in sources:
            part = _slim(sources[name], prov, **over)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for name, kind in BLANKS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("channel", F.coalesce("channel", F.lit("OTHER")))


FAILURE_WORDS = "failed|declined|insufficient"


def slim_union(sources: Mapping[str, DataFrame]) -> DataFrame:
    """The narrow union the feature job reads, failures in messages included."""
    def part(df, **c):
        cols = {"user_id": F.col("user_id"), "ts": F.col("timestamp"), "amount": F.col("amount"),
                "merchant_name": F.col("merchant_name"), "status": status(F.col("status")),
                "transaction_type": F.lit(""), "merchant_category": F.lit("OTHER"), **c}
        return df.select(*[v.alias(k) for k, v in cols.items()])

    builders = {
        "bank_transactions": lambda df: part(df),
        "upi_transactions": lambda df: part(df),
        "emi_schedules": lambda df: part(df, transaction_type=F.lit("EMI_PAYMENT"), merchant_category=F.lit("EMI")),
        "open_banking": lambda df: part(df, amount=F.lit(0.0), merchant_name=F.lit("AA_BALANCE_SNAPSHOT"),
                                        status=F.lit("SUCCESS"), transaction_type=F.lit("OTHER")),
        "sms_alerts": lambda df: part(df.where(F.lower("raw_text").rlike(FAILURE_WORDS)), amount=F.lit(-1.0),
                                      merchant_name=F.lit("SMS_FAILURE_ALERT"), status=F.lit("FAILED"),
                                      transaction_type=F.lit("EXPENSE_ESSENTIAL")),
    }
    out = None
    for name, build in builders.items():
        if name in sources:
            p = build(sources[name])
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def fill_type(ev: DataFrame) -> DataFrame:
    """Types rows whose type is blank: credits, then loan-like names, then essentials."""
    typ, name = F.col("transaction_type"), F.upper("merchant_name")
    guess = (F.when(F.col("amount") > 0, "INCOME")
             .when(name.contains("EMI") | name.contains("LOAN"), "EMI_PAYMENT")
             .otherwise("EXPENSE_ESSENTIAL"))
    return ev.withColumn("transaction_type", F.when(typ.isNull() | (typ == ""), guess).otherwise(typ))


def deduplicate(ev: DataFrame) -> DataFrame:
    return ev.dropDuplicates(["event_id"])


def valid_event() -> Column:
    ok = lambda c, vals: F.col(c).isNull() | F.col(c).isin(vals)
    return (F.col("event_id").isNotNull() & F.col("user_id").isNotNull() & F.col("ts").isNotNull()
            & F.col("amount").isNotNull() & F.col("status").isin(K.STATUSES)
            & F.col("source_provenance").isin(K.PROVENANCE) & ok("channel", K.CHANNELS)
            & ok("transaction_type", K.TRANSACTION_TYPES) & ok("merchant_category", K.CATEGORIES))


def validate(df: DataFrame, ok: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) by an enumeration or range condition; null counts as bad."""
    good = F.coalesce(ok if ok is not None else valid_event(), F.lit(False))
    return df.where(good), df.where(~good)


def alias_ids(profiles: DataFrame, kinds: tuple[str, ...] = ("user_id", "gstin", "vpa", "upi_id")) -> DataFrame:
    """(entity, id) pairs: every identifier a profile is known by."""
    ids = F.explode(F.array(*[F.col(k).cast("string") for k in kinds]))
    return (profiles.select(F.col("user_id").alias("entity"), ids.alias("id"))
            .where(F.col("id").isNotNull() & (F.col("id") != "")))


def resolve_entities(identifiers: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each `identifier`: all ids of the entity it names, itself included."""
    ids = alias_ids(profiles)
    hit = identifiers.join(ids.withColumnRenamed("id", "identifier"), "identifier", "left")
    found = hit.join(ids, "entity", "left").select("identifier", F.coalesce("id", "identifier").alias("id"))
    return found.groupBy("identifier").agg(F.array_sort(F.collect_set("id")).alias("ids"))
