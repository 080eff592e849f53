"""Table schemas: the eight raw sources and the canonical event."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


_HEAD = dict(event_id=_S, user_id=_S, timestamp=_TS)
_TAIL = dict(source_provenance=_S, status=_S, recurrence_flag=_B)

RAW: dict[str, T.StructType] = {
    "bank_transactions": _struct(**_HEAD, amount=_D, merchant_name=_S, channel=_S,
                                 balance_after=_D, reference_id=_S, **_TAIL),
    "upi_transactions": _struct(**_HEAD, amount=_D, direction=_S, merchant_name=_S,
                                txn_type=_S, counterparty_upi=_S, **_TAIL),
    "sms_alerts": _struct(**_HEAD, amount=_D, merchant_name=_S, alert_type=_S,
                          raw_text=_S, **_TAIL),
    "emi_schedules": _struct(**_HEAD, amount=_D, merchant_name=_S, schedule_type=_S,
                             recurrence_pattern=_S, remaining_tenure=_I, emi_status=_S, **_TAIL),
    "open_banking": _struct(**_HEAD, amount=_D, merchant_name=_S, balance_after=_D,
                            account_type=_S, **_TAIL),
    "voice_transcripts": _struct(**_HEAD, extracted_amount=_D, extracted_merchant=_S,
                                 extracted_type=_S, confidence_score=_D, **_TAIL),
    "gst_invoices": _struct(user_id=_S, gstin=_S, invoice_id=_S, timestamp=_TS,
                            taxable_value=_D, gst_amount=_D, buyer_gstin=_S,
                            filing_status=_S, filing_delay_days=_I, synthetic_batch_id=_S),
    "eway_bills": _struct(user_id=_S, gstin=_S, timestamp=_TS, main_hsn_code=_S,
                          tot_inv_value=_D, from_gstin=_S, to_gstin=_S, transDistance=_I),
}

EVENT = _struct(
    event_id=_S, user_id=_S, ts=_TS, amount=_D, merchant_name=_S, channel=_S,
    balance_after=_D, reference_id=_S, source_provenance=_S, status=_S,
    recurrence_flag=_B, anomaly_flag=_B, transaction_type=_S, merchant_category=_S,
    classifier_confidence=_D)

# The same columns as they lie in the driver's `events` table.
EVENTS_TABLE = _struct(event_id=T.LongType(), ts=_TS, user_id=T.LongType(),
                       event_type=_S, value=_D, props=_S)
