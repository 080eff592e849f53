"""Trailing sums as of every event, against a plain loop; the stream against the table."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fintrail.functions import constants as K
from fintrail.operators import trailing as TR
from fintrail.session import scratch
from fintrail.streaming import streams as S
from fintrail.streaming.state import KeyedTable
from tests.test_streams import every_batch_twice  # noqa: F401

EV = "event_id long, user_id long, ts timestamp_ntz, amount double, transaction_type string, merchant_category string"
T0 = datetime(2024, 1, 1)


def plain(rows):
    out = {}
    for i, u, t, *_ in rows:
        if t is None:
            continue
        one = {}
        for n in TR.SIZES:
            held = [(0.0 if a is None or not math.isfinite(a) else a, k, c if c in K.CATEGORIES else "OTHER")
                    for _, u2, t2, a, k, c in rows if u2 == u and t2 is not None and t2 <= t and (t - t2).days <= n]
            one[f"income_{n}d"] = round(sum(a for a, k, _ in held if k == "INCOME"), 2)
            for m, kind in TR.KINDS.items():
                one[f"{m}_{n}d"] = round(sum(abs(a) for a, k, _ in held if k == kind), 2)
            one[f"net_cashflow_{n}d"] = round(one[f"income_{n}d"] - sum(one[f"{m}_{n}d"] for m in TR.KINDS), 2)
            one[f"event_count_{n}d"] = len(held)
            cats = {}
            for a, _, c in held:
                cats[c] = cats.get(c, 0) + abs(a)
            one[f"categories_{n}d"] = {c: round(x, 2) for c, x in cats.items() if round(x, 4)}
        out[i] = one
    return out


def found(df):
    drop = {"event_id", "user_id", "ts", "batch_id"}
    return {r["event_id"]: {k: v for k, v in r.asDict().items() if k not in drop} for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for i in want:
        for k, v in want[i].items():
            if isinstance(v, dict):
                assert got[i][k].keys() == v.keys() and all(abs(got[i][k][c] - v[c]) < 0.006 for c in v), (i, k)
            else:
                assert abs(got[i][k] - v) < 0.006, (i, k, got[i][k], v)


def rows(n=150, days=260, seed=3):
    r = random.Random(seed)
    kinds, cats = ["INCOME", *TR.KINDS.values(), "OTHER", None], [*K.CATEGORIES[:5], "unheard of", None]
    out = [(i, r.choice([1, 1, 1, 2, None]), T0 + timedelta(hours=r.randrange(days * 24) // 6 * 6),
            round(r.uniform(-500, 500), 2), r.choice(kinds), r.choice(cats)) for i in range(n)]
    edge = T0 + timedelta(days=3)
    return out + [(900, 7, edge, 5.0, "INCOME", "SALARY"), (901, 7, edge + timedelta(days=8) - timedelta(microseconds=1), 1.0, "INCOME", "SALARY"),
                  (902, 7, edge + timedelta(days=8), 1.0, "INCOME", "SALARY"), (903, 7, edge + timedelta(days=91), 1.0, "INCOME", "SALARY"),
                  (904, 8, edge, None, "EMI_PAYMENT", "EMI"), (905, 8, edge, float("nan"), "EMI_PAYMENT", "EMI"), (906, 8, edge, -7.25, "EMI_PAYMENT", "EMI"),
                  (907, 8, None, 9.0, "INCOME", "SALARY")]


def test_summaries_equal_a_plain_loop(spark):
    data = rows()
    extra = spark.createDataFrame(data, EV).withColumn("_day", F.lit("x")).withColumn("at", F.lit(1)).withColumn("count", F.lit(2))
    close(found(TR.event_summaries(extra)), plain(data))
    assert TR.event_summaries(spark.createDataFrame([], EV)).count() == 0


def test_stream_equals_table_and_forgets(spark, every_batch_twice):  # noqa: F811
    data = sorted((x for x in rows(80) if x[2] is not None), key=lambda x: x[2])
    out = scratch(spark, "t")
    cuts = [T0 + timedelta(days=d) for d in (0, 90, 180, 400)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame([x for x in data if a <= x[2] < b], EV).coalesce(1).write.parquet(f"{out}/src/s={i}")
    stream = S.read_stream(spark, f"{out}/src/*", spark.createDataFrame([], EV).schema, files_per_batch=1)
    S.summary_stream(stream, f"{out}/t", f"{out}/s", f"{out}/c")
    close(found(spark.read.parquet(f"{out}/t")), plain(data))
    kept = KeyedTable(spark, f"{out}/s").read(99, range(64), EV)
    users = {x[1] for x in data if x[2] >= cuts[2]}
    assert kept.where(F.col("user_id").isin([u for u in users if u]) & (F.col("ts") <= F.lit(max(x[2] for x in data) - timedelta(days=91)))).count() == 0
