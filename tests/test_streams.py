"""Streams against their batch forms, late rows, restarts."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Window as W, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from fintrail.operators import features as FT, stateful
from fintrail.plans import tables as T
from fintrail.schemas import EVENTS_TABLE
from fintrail.session import scratch
from fintrail.streaming import streams as S
from fintrail.streaming.state import KeyedTable, replaced

SF = "/root/testdata/sf0.001"
c = F.col


def sliced(spark, days=(8, 16, 24, 32)):
    """The event table as files that arrive in time order."""
    src = scratch(spark, "slices")
    raw, lo = T.table(spark, SF, "events"), datetime(2024, 1, 1)
    for i, n in enumerate(days):
        hi = datetime(2024, 1, 1) + timedelta(days=n)
        raw.where((c("ts") >= F.lit(lo)) & (c("ts") < F.lit(hi))).coalesce(1).write.parquet(f"{src}/s={i}")
        lo = hi
    return T.as_events(S.read_stream(spark, f"{src}/*", EVENTS_TABLE, files_per_batch=1))


@pytest.fixture
def every_batch_twice(monkeypatch):
    """Each micro-batch runs again right after it has ended, as after a failure before its offset was committed."""
    once = DataStreamWriter.foreachBatch
    monkeypatch.setattr(DataStreamWriter, "foreachBatch", lambda w, f: once(w, lambda df, i: (f(df, i), f(df, i))[1]))


def test_stateful_stream_equals_batch(spark, every_batch_twice):
    out = scratch(spark, "t")
    S.flag_stream(sliced(spark), f"{out}/t", f"{out}/s", f"{out}/c", chunk=40)
    rows = spark.read.parquet(f"{out}/t")
    assert rows.select("batch_id").distinct().count() == 4
    got = {(r["event_id"], r["anomaly_flag"]) for r in rows.collect()}
    want = {(r["event_id"], r["anomaly_flag"]) for r in stateful.stateful_flags(T.ev(spark, SF)).collect()}
    assert got == want and rows.count() == len(want)


def test_a_silent_user_is_forgotten(spark):
    out, t0 = scratch(spark, "t"), datetime(2024, 1, 1)
    kinds = "event_id long, user_id long, ts timestamp_ntz, amount double, status string"
    calm = [(i, 1, t0 + timedelta(days=i), 10.0 + i % 3, "SUCCESS") for i in range(20)]
    for i, rows in enumerate([calm, [(50, 2, t0 + timedelta(days=105), 1.0, "SUCCESS"), (51, 1, t0 + timedelta(days=105), 500.0, "SUCCESS")],
                              [(52, 1, t0 + timedelta(days=250), 9000.0, "SUCCESS")]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{out}/src/s={i}")
        S.flag_stream(S.read_stream(spark, f"{out}/src/*", spark.createDataFrame(rows, kinds).schema), f"{out}/t", f"{out}/s", f"{out}/c")
    got = {r["event_id"]: r["anomaly_flag"] for r in spark.read.parquet(f"{out}/t").collect()}
    assert got[51] is True and got[52] is False          # 86 days of silence are remembered, 145 are not
    table = KeyedTable(spark, f"{out}/s")
    kept = table.read(99, range(64), "user_id long, amounts array<double>, times array<double>, last double").collect()
    assert {r.user_id for r in kept} <= {1, 2} and len([r for r in kept if r.user_id == 1][0].amounts) == 1


def test_refresh_over_repeated_batches_equals_batch(spark, every_batch_twice):
    out = scratch(spark, "r")
    ref = lambda t: datetime(t.year, t.month, t.day) + timedelta(days=1)
    S.refresh(sliced(spark), f"{out}/s", f"{out}/f", f"{out}/t", f"{out}/c", ref)
    ev = T.ev(spark, SF)
    twins = spark.read.parquet(f"{out}/t")
    for i, n in enumerate((8, 16, 24, 32)):
        part = ev.where(c("ts") < F.lit(datetime(2024, 1, 1) + timedelta(days=n)))
        at = ref(part.agg(F.max("ts")).first()[0])
        lo = datetime(2024, 1, 1) + timedelta(days=n - 8)
        users = part.where(c("ts") >= F.lit(lo)).select("user_id").distinct()
        want = FT.account_features(part, at).join(users, "user_id", "left_semi")
        got = spark.read.parquet(f"{out}/f/batch_id={i}").select(*want.columns)
        a, b = ({r["user_id"]: [round(v, 4) if isinstance(v, float) else v for v in r] for r in d.collect()} for d in (got, want))
        assert a == b and a
    versions = twins.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("v"), F.count_distinct("version").alias("d")).collect()
    assert all(r.n == r.v == r.d for r in versions) and max(r.v for r in versions) == 4


def test_days_that_leave_all_windows_are_taken_out(spark):
    out, t0 = scratch(spark, "r"), datetime(2024, 1, 31)
    one = T.ev(spark, SF).where("user_id = 1").limit(40).withColumn("n", F.row_number().over(W.orderBy("event_id"))).cache()
    for i, first in enumerate((0, 95, 300)):
        part = one.where(c("n") % 3 == i).withColumn("ts", (F.lit(t0 + timedelta(days=first)).cast("timestamp_ntz") + F.make_dt_interval(c("n") % 5))).drop("n")
        part.coalesce(1).write.parquet(f"{out}/src/s={i}")
        S.refresh(S.read_stream(spark, f"{out}/src/*", part.schema), f"{out}/s", f"{out}/f", f"{out}/t", f"{out}/c",
                  lambda t: datetime(t.year, t.month, t.day) + timedelta(days=1))
    whole = spark.read.parquet(f"{out}/src")
    at = whole.agg(F.max("ts")).first()[0]
    want = FT.account_features(whole, datetime(at.year, at.month, at.day) + timedelta(days=1)).first().asDict()
    got = spark.read.parquet(f"{out}/f/batch_id=2").first().asDict()
    assert all(got[k] == pytest.approx(v, abs=1e-4) if isinstance(v, float) else got[k] == v for k, v in want.items())
    left = KeyedTable(spark, f"{out}/s/days").read(99, range(64), "user_id long, day date").agg(F.min("day")).first()[0]
    assert left >= (t0 + timedelta(days=300)).date()


def test_patches_in_order_append_only_material_changes(spark, every_batch_twice):
    out = scratch(spark, "p")
    now = spark.createDataFrame([(1, 3, 30.0, "HIGH", "x"), (2, 1, 5.0, "LOW", "x"), (4, 9, 1.0, "LOW", "x")],
                                "user_id long, version int, cash_buffer_days double, liquidity_health string, note string")
    S.seed_latest(now, f"{out}/latest")
    kinds = "user_id long, seq int, cash_buffer_days double, liquidity_health string, note string"
    parts = [[(1, 1, 20.0, None, None), (1, 2, None, None, "y"), (1, 3, None, "LOW", None), (2, 1, 5.0, None, "z"), (3, 1, 1.0, None, None)],
             [(2, 5, 6.0, None, None), (1, 6, 20.0, "LOW", None), (1, 7, 21.0, None, None)]]
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, kinds)
        df.coalesce(1).write.parquet(f"{out}/src/s={i}")
        S.patch_stream(S.read_stream(spark, f"{out}/src/*", df.schema), f"{out}/latest", f"{out}/v", f"{out}/c",
                       ["cash_buffer_days", "liquidity_health", "note"], ["seq"])
    got = sorted((r.user_id, r.version, r.cash_buffer_days, r.liquidity_health, r.note, r.batch_id) for r in spark.read.parquet(f"{out}/v").collect())
    assert got == [(1, 4, 20.0, "HIGH", "x", 0), (1, 5, 20.0, "LOW", "y", 0), (1, 6, 21.0, "LOW", "y", 1), (2, 2, 6.0, "LOW", "z", 1)]


def test_keyed_table_rewrites_only_touched_buckets(spark):
    t = KeyedTable(spark, scratch(spark, "k"), buckets=8)
    kinds = "user_id long, v int"
    all_rows = spark.createDataFrame([(i, 0) for i in range(50)] + [(None, 0)], kinds)
    t.write(0, t.touched(all_rows), all_rows)
    some = spark.createDataFrame([(7, 1), (None, 1)], kinds)
    b = t.touched(some)
    assert 1 <= len(b) <= 2
    for _ in range(2):                                     # again, as after a failure
        t.write(1, b, replaced(t.read(1, b, kinds), some))
    now = {r.user_id: r.v for r in t.read(2, range(8), kinds).collect()}
    assert len(now) == 51 and {k for k, v in now.items() if v} == {7, None}
    assert {r.v for r in t.read(1, range(8), kinds).collect()} == {0}


def test_buckets_over_several_batches_equal_one(spark):
    a, b = scratch(spark, "a"), scratch(spark, "b")
    S.store_buckets(sliced(spark), f"{a}/t", f"{a}/c")
    one = T.as_events(S.read_stream(spark, SF, EVENTS_TABLE, glob="events.parquet"))
    S.store_buckets(one, f"{b}/t", f"{b}/c")
    x, y = (S.trailing(spark.read.parquet(f"{p}/t")) for p in (a, b))
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_late_rows_go_to_the_side_table(spark):
    src, out = scratch(spark, "src"), scratch(spark, "out")
    raw = T.table(spark, SF, "events")
    new = c("ts") >= F.lit(datetime(2024, 1, 15))
    raw.where(new).coalesce(1).write.parquet(f"{src}/s=0")
    raw.where(~new).coalesce(1).write.parquet(f"{src}/s=1")
    s = T.as_events(S.read_stream(spark, f"{src}/*", EVENTS_TABLE, files_per_batch=1))
    S.ingest(s, f"{out}/t", f"{out}/late", f"{out}/c")
    kept, late = spark.read.parquet(f"{out}/t"), spark.read.parquet(f"{out}/late")
    high = raw.agg(F.max("ts")).first()[0]
    assert kept.count() + late.count() == raw.count()
    assert late.count() == raw.where(~new & (c("ts") < F.lit(high - timedelta(days=7)))).count() > 0


def test_a_repeated_batch_replaces_its_output(spark):
    out = scratch(spark, "again")
    df = T.ev(spark, SF).select("event_id")
    S.put(df, out, 3)
    S.put(df, out, 3)
    assert spark.read.parquet(out).count() == df.count()


def test_next_version_continues(spark):
    known = spark.createDataFrame([(1, 4), (1, 5), (2, 1)], "user_id long, version int")
    fresh = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    got = {r["user_id"]: r["version"] for r in S.next_version(fresh, known).collect()}
    assert got == {1: 6, 2: 2, 3: 1}


def test_retention_touches_only_the_day_of_the_limit(spark):
    out = scratch(spark, "k")
    S.ingest(sliced(spark), f"{out}/t", f"{out}/late", f"{out}/c", delay=timedelta(days=60))
    rows = T.ev(spark, SF)
    files = {p: p.stat().st_mtime_ns for p in Path(f"{out}/t").rglob("*.parquet")}
    limit = S.retain(spark, f"{out}/t", timedelta(days=15))
    high = rows.agg(F.max("ts")).first()[0]
    assert limit == high - timedelta(days=15)
    want = {r[0] for r in rows.where(c("ts") >= F.lit(limit)).select("event_id").collect()}
    kept = lambda: sorted(r[0] for r in spark.read.parquet(f"{out}/t").select("event_id").collect())
    assert kept() == sorted(want)
    now = {p: p.stat().st_mtime_ns for p in Path(f"{out}/t").rglob("*.parquet")}
    later = {p for p in files if p.parent.name > f"day={limit.date()}"}
    assert later and all(now[p] == files[p] for p in later)
    assert not [p for p in now if p.parent.name < f"day={limit.date()}"]
    # a run that ended between taking a day out and putting it back
    edge = next(p for p in Path(f"{out}/t").rglob(f"day={limit.date()}") if p.is_dir())
    side = Path(f"{out}/t_trimmed") / edge.parent.name / edge.name
    side.parent.mkdir(parents=True)
    edge.rename(side)
    (Path(f"{out}/t_trimmed") / "_SUCCESS").touch()
    assert S.retain(spark, f"{out}/t", timedelta(days=15)) == limit and kept() == sorted(want)
    assert S.retain(spark, f"{out}/none", timedelta(days=1)) is None
