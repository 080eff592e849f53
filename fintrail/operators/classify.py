"""Merchant, message and embedding classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import norm, rnd
from fintrail.functions.rules import first_match, lookup

LITERAL_ANCHORS = 1024


def merchant_category(name: Column, rules=None) -> Column:
    """Category of the first matching rule, null where none matches."""
    return first_match(name, rules or K.MERCHANT_RULES, None)


def transaction_type(category: Column, amount: Column) -> Column:
    """Type of the category; credits become INCOME unless the type already allows them."""
    typ = lookup(category, K.CATEGORY_TYPE, "OTHER")
    return F.when((amount > 0) & ~typ.isin(K.SIGN_KEEPS_TYPE), "INCOME").otherwise(typ)


def recurring(provenance: Column) -> Column:
    return provenance == "emi_statement"


def enrich(ev: DataFrame) -> DataFrame:
    """Category, type, confidence and recurrence of raw canonical events (stateless)."""
    cat = merchant_category(F.col("merchant_name"))
    return (ev.withColumn("merchant_category", F.coalesce(cat, F.lit("OTHER")))
            .withColumn("classifier_confidence", F.when(cat.isNotNull(), 1.0).otherwise(0.5))
            .withColumn("transaction_type", transaction_type(F.col("merchant_category"), F.col("amount")))
            .withColumn("recurrence_flag", recurring(F.col("source_provenance"))))


def anchors(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label, scaled to length one."""
    unit = _unit(F.col(vec))
    parts = (vectors.select(label, F.posexplode(unit).alias("i", "x"))
             .groupBy(label, "i").agg(F.avg("x").alias("x"))
             .groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")))
    return parts.select(label, _unit(F.transform("p", lambda s: s["x"])).alias("anchor"))


def _unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
        F.transform(v, lambda x: x.cast("double")))


def nearest_anchor(vectors: DataFrame, anchor_table: DataFrame, key: str, *, vec: str = "embedding",
                   label: str = "label", threshold: float = 0.50) -> DataFrame:
    """Label of the most similar anchor; OTHER at the threshold where none reaches it.

    Anchors number one per label. Up to LITERAL_ANCHORS of them - a size checked
    here - ride along as one broadcast row; a larger label set goes through the
    pruned nearest-neighbour join instead.
    """
    few = anchor_table.limit(LITERAL_ANCHORS + 1).count() <= LITERAL_ANCHORS
    if few:
        packed = anchor_table.agg(F.array_sort(F.collect_list(F.struct(label, "anchor"))).alias("anchors"))
        u = vectors.withColumn("u", _unit(F.col(vec)))
        scored = F.transform("anchors", lambda a: F.struct(
            F.aggregate(F.zip_with(F.col("u"), a["anchor"], lambda x, y: x * y), F.lit(0.0),
                        lambda s, v: s + v).alias("s"), a[label].alias("l")))
        best = u.crossJoin(F.broadcast(packed)).select(key, F.array_max(scored).alias("b"))
        best = best.select(key, F.col("b.s").alias("s"), F.col("b.l").alias("l"))
    else:
        from fintrail.operators.neighbours import nearest
        best = nearest(vectors.select(F.col(key).alias("q"), F.col(vec).alias("v")),
                       anchor_table.select(F.col(label).alias("b"), F.col("anchor").alias("v")), k=1
                       ).select(F.col("q").alias(key), F.col("similarity").alias("s"), F.col("b").alias("l"))
    hit = F.col("s") >= threshold
    return best.select(key, F.when(hit, F.col("l").cast("string")).otherwise("OTHER").alias("category"),
                       F.when(hit, rnd("s", 4)).otherwise(threshold).alias("confidence"))


def chat_intent(text: Column) -> Column:
    return first_match(text, K.CHAT_INTENT_RULES, "general")


def negotiation_intent(text: Column) -> Column:
    return first_match(F.trim(F.lower(F.coalesce(text, F.lit("")))), K.NEGOTIATION_RULES, "clarify")


def message_fields(text: Column) -> list[Column]:
    """Amounts, yes/no and time references found in a message."""
    low = F.lower(text)
    amounts = F.transform(F.regexp_extract_all(text, F.lit(K.AMOUNT_PATTERN), F.lit(1)),
                          lambda s: F.regexp_replace(s, ",", "").try_cast("double"))
    return [amounts.alias("amounts"),
            F.when(low.rlike(K.YES_WORDS), True).when(low.rlike(K.NO_WORDS), False).alias("answer"),
            F.regexp_extract_all(low, F.lit(K.TIME_PATTERN), F.lit(1)).alias("time_refs")]
