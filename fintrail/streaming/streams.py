"""Structured Streaming forms of the operators.

Sources are file streams. Every `foreachBatch` sink writes its own
`batch_id=<n>` folder with overwrite, so a batch that is run again after a
failure replaces its output instead of repeating it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fintrail.functions.numeric import micros, ntz, rnd
from fintrail.operators import classify, features as FT, risk as R, stateful, trailing as trailing_events, twin as TW
from fintrail.streaming.state import KeyedTable, replaced

c = F.col
WATERMARK = "7 days"


# ---------------------------------------------------------------- plumbing

def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100, glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Process everything there is and stop."""
    q: StreamingQuery = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def put(df: DataFrame, path: str, batch_id: int, *parts: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*parts) if parts else w).parquet(f"{path}/batch_id={batch_id}")


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Everything written so far, or None before the first batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What earlier batches wrote; a repeated batch does not see its own output."""
    rows = stored_rows(spark, path)
    return None if rows is None else rows.where(c("batch_id") < batch_id)


# ------------------------------------------------------------------ ingest

def ingest(stream: DataFrame, out: str, late: str, checkpoint: str, delay: timedelta = timedelta(days=7)) -> None:
    """Canonical ingest into folders by batch and day; rows older than the delay go to a side table.

    The highest time seen is kept per batch in a small table next to the output.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df.persist()
        marks = before(spark, f"{out}_marks", batch_id)
        seen = marks.agg(F.max("high")).first()[0] if marks is not None else None
        high = df.agg(F.max("ts")).first()[0]
        is_late = (c("ts") < ntz(seen - delay)) if seen else F.lit(False)
        put(df.where(~is_late).withColumn("day", F.to_date("ts")), out, batch_id, "day")
        put(df.where(is_late), late, batch_id)
        top = max(x for x in (seen, high) if x is not None) if (seen or high) else None
        put(spark.createDataFrame([(top,)], "high timestamp_ntz"), f"{out}_marks", batch_id)
        df.unpersist()
    run_available(stream.writeStream.foreachBatch(sink), checkpoint)


def deduplicated(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each event_id once within the watermark; state is dropped behind it."""
    s = stream.withColumn("event_time", instant(c("ts"))).withWatermark("event_time", watermark)
    return s.dropDuplicatesWithinWatermark(["event_id"]).drop("event_time")


def fan_out(stream: DataFrame, out: str, checkpoint: str) -> None:
    """One directory per source."""
    run_available(stream.writeStream.foreachBatch(lambda df, i: put(df, out, i, "source_provenance")), checkpoint)


def enriched(stream: DataFrame) -> DataFrame:
    """Stateless classification."""
    return classify.enrich(stream)


# ------------------------------------------------------------ trailing sums

KINDS = {"income": "INCOME", "essential": "EXPENSE_ESSENTIAL", "discretionary": "EXPENSE_DISCRETIONARY",
         "emi": "EMI_PAYMENT", "subscription": "SUBSCRIPTION"}


def instant(ts: Column) -> Column:
    """The wall-clock time read as UTC, so that windows fall on its calendar days in any session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def day_buckets(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Sums per user and day over a tumbling window; late rows within the watermark update their day."""
    s = stream.withColumn("event_time", instant(c("ts"))).withWatermark("event_time", watermark)
    sums = [F.sum(F.when(c("transaction_type") == t, F.abs("amount")).otherwise(0.0)).alias(n) for n, t in KINDS.items()]
    g = s.groupBy("user_id", F.window("event_time", "1 day")).agg(F.count(F.lit(1)).alias("events"), *sums)
    return g.withColumn("day", F.to_date(F.to_utc_timestamp("window.start", F.current_timezone()))).drop("window")


def store_buckets(stream: DataFrame, out: str, checkpoint: str) -> None:
    run_available(day_buckets(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: put(df, out, i)), checkpoint)


def trailing(buckets: DataFrame) -> DataFrame:
    """7/30/90-day sums at each active day, from the latest state of every bucket."""
    cols = ["events", *KINDS]
    live = buckets.groupBy("user_id", "day").agg(F.max_by(F.struct(*cols), "batch_id").alias("b")).select("user_id", "day", "b.*")
    live = live.withColumn("dn", F.unix_date("day"))
    w = W.partitionBy("user_id").orderBy("dn")
    out = []
    for n in (7, 30, 90):
        f = w.rangeBetween(-(n - 1), 0)
        out.append(F.sum("events").over(f).alias(f"events_{n}d"))
        out += [rnd(F.sum(k).over(f), 2).alias(f"{k}_{n}d") for k in KINDS]
    return live.select("user_id", "day", *out)


# ---------------------------------------------------------- stateful flags

KEEP = timedelta(days=91)


def flag_stream(stream: DataFrame, out: str, state: str, checkpoint: str, keep: timedelta = KEEP, chunk: int = stateful.CHUNK) -> None:
    """The order-dependent anomaly check over micro-batches; a user's history (200 amounts, 50 times) lies in a keyed table.

    Each batch is folded like a table, from the states that earlier batches left, so a user with most of its rows is
    spread over tasks. A state is given up when its user has had no event in the `keep` before a batch's newest event.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = through(df.select("event_id", "user_id", "ts", "amount", "status"), f"{state}_rows", batch_id)
        high = rows.agg(F.max(micros(c("ts")))).first()[0]
        table = KeyedTable(spark, state)
        buckets = table.touched(rows)
        kind = dict(rows.dtypes)["user_id"]
        known = table.read(batch_id, buckets, f"user_id {kind}, amounts array<double>, times array<double>, last double")
        if high is not None:
            known = known.where(c("last") >= high - keep / timedelta(microseconds=1))
        users = rows.select(c("user_id").alias("_u")).distinct()
        start = known.join(users, c("user_id").eqNullSafe(c("_u")), "left_semi")
        flags, ends, _ = stateful.speculative_flags(rows, start, ends=True, chunk=chunk)
        put(flags, out, batch_id)
        table.write(batch_id, buckets, replaced(known, ends.select(*known.columns)))
    run_available(stream.writeStream.foreachBatch(sink), checkpoint)


# ------------------------------------------------------ per-event summaries

def summary_stream(stream: DataFrame, out: str, state: str, checkpoint: str, keep: timedelta = KEEP) -> None:
    """One row per event with its user's trailing 7, 30 and 90 days, see `trailing.event_summaries`.

    A user's events of the last 91 days lie in a keyed table: a batch reads the buckets of its users, adds its own
    events and drops those that are older than `keep` at its newest event, so neither what it reads nor what it keeps
    grows with history. A late event counts what is known when it comes; rows written earlier stay as they are.
    """
    cols = ["event_id", "user_id", "ts", "amount", "transaction_type", "merchant_category"]

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = through(df.select(*cols), f"{state}_rows", batch_id)
        high = rows.agg(F.max("ts")).first()[0]
        table = KeyedTable(spark, state)
        buckets = table.touched(rows)
        kinds = dict(rows.dtypes)
        known = table.read(batch_id, buckets, ", ".join(f"{n} {kinds[n]}" for n in cols))
        users = rows.select(c("user_id").alias("_u")).distinct()
        past = known.join(users, c("user_id").eqNullSafe(c("_u")), "left_semi")
        both = past.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
        put(trailing_events.event_summaries(both, wanted=c("_new")), out, batch_id)
        live = known.unionByName(rows)
        table.write(batch_id, buckets, live.where(c("ts") > ntz(high - keep)) if high is not None else live.where("ts is not null"))
    run_available(stream.writeStream.foreachBatch(sink), checkpoint)


# -------------------------------------------------------- features and twin

def through(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Writes a batch's rows and reads them back, so that its source is read once."""
    put(df, path, batch_id)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch_id={batch_id}")


def refresh(stream: DataFrame, state: str, features: str, twins: str, checkpoint: str,
            as_of: Callable[[datetime], datetime]) -> None:
    """Per batch: add events to their users' days, recompute features of the users seen, add a state version for each.

    `as_of` maps the batch's latest event time to the reference time of its features: a midnight, never before an
    earlier one. A batch reads no event twice and no history: it reduces its events to days, adds these to the at most
    122 days kept of each user, and takes out days that have left all windows. The number of a user's last version lies in a table of its own.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        spark = df.sparkSession
        fresh = through(FT.day_state(df, FT.user_parts(df)), f"{state}/reduced", batch_id)
        ref = as_of(fresh.agg(F.max("high")).first()[0])
        days = KeyedTable(spark, f"{state}/days")
        buckets = days.touched(fresh)
        merged = FT.merged_days(days.read(batch_id, buckets, fresh.schema).unionByName(fresh)).select(*fresh.columns)
        days.write(batch_id, buckets, merged.where(c("day") >= F.lit(FT.first_day_needed(ref).date())))
        users = fresh.select(c("user_id").alias("_u")).distinct()
        held = days.read(batch_id + 1, buckets, fresh.schema).join(users, c("user_id").eqNullSafe(c("_u")), "left_semi")
        found = through(FT.account_features_of_days(held, ref).withColumn("ts", ntz(ref)), features, batch_id)
        versions = KeyedTable(spark, f"{state}/versions")
        kind = dict(found.dtypes)["user_id"]
        known = versions.read(batch_id, buckets, f"user_id {kind}, version int")
        states = through(next_version(TW.derive(found), known), twins, batch_id)
        versions.write(batch_id, buckets, replaced(known, states.select("user_id", c("version").cast("int").alias("version"))))
    run_available(stream.writeStream.foreachBatch(sink), checkpoint)


def next_version(fresh: DataFrame, known: DataFrame | None) -> DataFrame:
    """Fresh states numbered after each user's last version."""
    if known is None:
        return fresh.withColumn("version", F.lit(1))
    last = known.groupBy("user_id").agg(F.max("version").alias("_v"))
    return fresh.join(last, "user_id", "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).drop("_v")


def patch(current: DataFrame, patches: DataFrame, fields: list[str], order: Sequence[str] = ()) -> DataFrame:
    """The state after each patch of a known user, in order: its fields, version, and `material`.

    A patch overwrites the fields that it names; null leaves a field as it is. It makes a new version where a material
    field changes. The rows with `material` are the versions to append; a user's last row is its state from now on.
    """
    by = W.partitionBy("user_id").orderBy(*order) if order else W.partitionBy("user_id").orderBy(F.lit(0))
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    j = patches.select("user_id", *order, *[c(f).alias(f"_p_{f}") for f in fields]).join(current, "user_id")
    j = j.withColumns({f"_n_{f}": F.coalesce(F.last(f"_p_{f}", ignorenulls=True).over(upto), c(f)) for f in fields})
    changed = F.lit(False)
    for f in fields:
        if f in TW.MATERIAL:
            changed = changed | ~c(f"_n_{f}").eqNullSafe(F.lag(f"_n_{f}").over(by))
    first = F.lit(False)
    for f in fields:
        if f in TW.MATERIAL:
            first = first | ~c(f"_n_{f}").eqNullSafe(c(f))
    j = j.withColumn("material", F.when(F.row_number().over(by) == 1, first).otherwise(changed))
    j = j.withColumn("_more", F.sum(c("material").cast("int")).over(upto)).withColumn("_at", F.row_number().over(by))
    keep = [c(f"_n_{f}").alias(f) if f in fields else (c("version") + c("_more")).cast("int").alias(f) if f == "version" else c(f)
            for f in current.columns]
    return j.select(*keep, "material", c("_at").alias("step"))


def patch_stream(stream: DataFrame, latest: str, versions: str, checkpoint: str, fields: list[str], order: Sequence[str]) -> None:
    """Compare-and-append: patches against the table of latest states (see `seed_latest`).

    Only versions in which a material field differs are appended to `versions`, one folder per batch, so a batch that is
    run again replaces them. Users without a state are passed over.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = through(df, f"{latest}_patches", batch_id)
        table = KeyedTable(spark, latest)
        buckets = table.touched(rows)
        schema = spark.read.parquet(f"{latest}_schema").schema
        known = table.read(batch_id, buckets, schema)
        after = through(patch(known, rows, fields, order), f"{latest}_applied", batch_id)
        put(after.where("material").drop("material", "step"), versions, batch_id)
        top = after.groupBy("user_id").agg(F.max_by(F.struct(*[x for x in known.columns if x != "user_id"]), "step").alias("s"))
        table.write(batch_id, buckets, replaced(known, top.select("user_id", "s.*").select(*known.columns)))
    run_available(stream.writeStream.foreachBatch(sink), checkpoint)


def seed_latest(states: DataFrame, latest: str) -> None:
    """The table of latest states that `patch_stream` starts from: one row per user."""
    states.limit(0).write.mode("overwrite").parquet(f"{latest}_schema")
    table = KeyedTable(states.sparkSession, latest)
    table.write(-1, table.touched(states), states)


def notify(stream: DataFrame, consent: DataFrame, sent: str, escalated: str, state: str, checkpoint: str, **scores) -> None:
    """State snapshots to messages; fraud alerts go to the escalation table only.

    Of a user's history only the last four volatilities are kept, in a keyed table.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        rows = through(df, f"{state}_rows", batch_id)
        table = KeyedTable(df.sparkSession, state)
        buckets = table.touched(rows)
        kinds = dict(rows.dtypes)
        known = table.read(batch_id, buckets, ", ".join(f"{x} {kinds[x]}" for x in ("user_id", "version", "spending_volatility")))
        past = rows.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        now = TW.previous_volatility(past).where("_new").drop("_new")
        out, fraud = R.notifications(R.triggers(now), consent, **scores)
        put(out, sent, batch_id)
        put(fraud, escalated, batch_id)
        newest = W.partitionBy("user_id").orderBy(F.desc("version"))
        kept = past.select(*known.columns).withColumn("_rn", F.row_number().over(newest)).where("_rn <= 4").drop("_rn")
        table.write(batch_id, buckets, kept)
    run_available(stream.writeStream.foreachBatch(sink), checkpoint)


def retain(spark: SparkSession, path: str, keep: timedelta) -> datetime | None:
    """Takes what is older than `keep` before the newest row out of a table in folders batch_id=<n>/day=<date>.

    Folders of older days are deleted, and only the day that the limit falls into is written anew, beside the table, and
    then put in its place; files of kept days are not touched. Rows without a time stay. If a run ends early, the next
    one finishes it: a rewritten day that has lost its place is put back first. Returns the limit.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    side = f"{path}_trimmed"

    def folders(root: str) -> dict[tuple[str, str], object]:
        if not fs.exists(Path(root)):
            return {}
        return {(b.getPath().getName(), x.getPath().getName()): x.getPath() for b in fs.listStatus(Path(root)) if b.getPath().getName().startswith("batch_id=")
                for x in fs.listStatus(b.getPath()) if x.getPath().getName().startswith("day=")}

    def put_back() -> None:
        if fs.exists(Path(f"{side}/_SUCCESS")):
            for (batch, day), place in folders(side).items():
                target = Path(f"{path}/{batch}/{day}")
                if not fs.exists(target):
                    fs.mkdirs(target.getParent())
                    fs.rename(place, target)
        fs.delete(Path(side), True)
    put_back()
    days = {k: p for k, p in folders(path).items() if not k[1].endswith("__")}
    if not days:
        return None
    newest = max(day for _, day in days)
    high = spark.read.parquet(*[p.toString() for (_, day), p in days.items() if day == newest]).agg(F.max("ts")).first()[0]
    limit = high - keep
    edge = f"day={limit.date().isoformat()}"
    for (_, day), place in days.items():
        if day < edge:
            fs.delete(place, True)
    cut_days = [p for (_, day), p in days.items() if day == edge]
    if cut_days and limit.time() != datetime.min.time():
        rows = spark.read.option("basePath", path).parquet(*[p.toString() for p in cut_days])
        rows.where(c("ts") >= ntz(limit)).write.partitionBy("batch_id", "day").parquet(side)
        for place in cut_days:
            fs.delete(place, True)
        put_back()
    return limit
