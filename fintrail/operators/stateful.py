"""The order-dependent anomaly check, folded over chunks of a user's events at the same time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from fintrail.functions.numeric import micros
from fintrail.session import scratch

HISTORY = 200
TIMES = 50
WARM = 10
SIGMAS = 3.0
BURST = 5
HOUR = 3_600_000_000
CHUNK = 20_000                 # events of a user that one fold takes (and the rest of its last hour)
LEAD = 600                     # events before a chunk from which its start is guessed
STEP = 256                     # events that are tried at once


_OUT = "user_id {user}, chunk long, event_id {event}, flag boolean, kind int, amounts array<double>, times array<double>"


class AnomalyState:
    """What the check remembers of a user: the last 200 amounts and 50 times that were neither failed nor flagged."""

    __slots__ = ("amounts", "times")

    def __init__(self, amounts=(), times=()):
        self.amounts = np.asarray(amounts, float)[-HISTORY:]
        self.times = np.asarray(times, float)[-TIMES:]

    def check(self, amount: float, t: float, failed: bool) -> bool:
        """One event: whether it is flagged; if not, it is remembered."""
        if failed:
            return True
        if len(self.amounts) >= WARM:
            sigma = self.amounts.std(ddof=1)
            if (amount - self.amounts.mean()) / (sigma if sigma > 1e-9 else 1.0) > SIGMAS:
                return True
        if (self.times >= t - HOUR).sum() > BURST:
            return True
        self.keep(np.array([amount]), np.array([t]))
        return False

    def keep(self, amounts: np.ndarray, times: np.ndarray) -> None:
        self.amounts = np.concatenate([self.amounts, amounts])[-HISTORY:]
        self.times = np.concatenate([self.times, times])[-TIMES:]

    def fold(self, amounts: np.ndarray, times: np.ndarray, failed: np.ndarray) -> np.ndarray:
        """`check` of all events in order. Once the memory is full, up to STEP events are judged as if none of them
        were flagged; they are remembered up to the first one that is, and the rest is tried again."""
        out = failed.copy()
        todo = np.flatnonzero(~failed)
        at, width = 0, STEP
        while at < len(todo):
            if len(self.amounts) < HISTORY or len(self.times) < TIMES:
                i = todo[at]
                out[i] = self.check(amounts[i], times[i], False)
                at += 1
                continue
            pick = todo[at:at + width]
            a, t = amounts[pick], times[pick]
            seen = sliding_window_view(np.concatenate([self.amounts, a[:-1]]), HISTORY).copy()
            sigma = seen.std(axis=1, ddof=1)
            far = (a - seen.mean(axis=1)) / np.where(sigma > 1e-9, sigma, 1.0) > SIGMAS
            near = sliding_window_view(np.concatenate([self.times, t[:-1]]), TIMES)
            hit = far | ((near >= t[:, None] - HOUR).sum(axis=1) > BURST)
            n = int(hit.argmax()) if hit.any() else len(pick)
            self.keep(a[:n], t[:n])
            at += n
            if n < len(pick):
                out[pick[n]] = True
                at += 1
            width = min(STEP, max(16, 2 * n))
        return out


def _places(e: DataFrame, chunk: int, lead: int) -> DataFrame:
    """(user, hour) to the chunks that take its events, for users with more than `chunk` events.

    A row for each hour of such a user. `places` holds the own chunk, and the next one if the hour belongs to the
    events from which the start of that is guessed.
    """
    user = W.partitionBy("user_id")
    hours = (e.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("total", F.sum("n").over(user)).where(F.col("total") > chunk)
             .withColumn("off", F.coalesce(F.sum("n").over(user.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("chunk", F.floor(F.col("off") / chunk))
             .withColumn("end", F.max(F.col("off") + F.col("n")).over(W.partitionBy("user_id", "chunk"))))
    own = F.array(F.struct("chunk", F.lit(False).alias("lead")))
    following = F.array(F.struct(F.floor(F.col("end") / chunk).alias("chunk"), F.lit(True).alias("lead")))
    guesses = (F.col("end") < F.col("total")) & (F.col("off") + F.col("n") > F.col("end") - lead)
    return hours.select(F.col("user_id").alias("_user"), F.col("hour").alias("_hour"),
                        F.when(guesses, F.concat(own, following)).otherwise(own).alias("places"))


def _run(rows: DataFrame, start: DataFrame | None, all_ends: bool, path: str) -> None:
    """Folds each (user, chunk) from its start state, or from nothing, and stores what comes out.

    kind 0: an event's flag. kind 1: the state at the first event of a chunk that was not given one. kind 2: the state
    behind the last one. States are written for users with several chunks, or for all.
    """
    kinds = dict(rows.dtypes)
    user, event = kinds["user_id"], kinds["event_id"]
    d = rows.withColumns({"kind": F.lit(1), "amounts": F.lit(None).cast("array<double>"), "times": F.lit(None).cast("array<double>")})
    if start is not None:
        s = start.select("user_id", "chunk", "split", "amounts", "times", F.lit(0).alias("kind"))
        d = d.unionByName(s, allowMissingColumns=True)
    d = d.repartition("user_id", "chunk").sortWithinPartitions("user_id", "chunk", "kind", "ts", "event_id")
    d = d.select("user_id", "chunk", "event_id", "amt", "t", "failed", "lead", "split", "kind", "amounts", "times")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, open_lead, wanted = None, AnomalyState(), False, False

        def state_row(kind: int) -> tuple:
            return (held[0], held[1], None, None, kind, state.amounts.tolist(), state.times.tolist())
        for b in batches:
            if b.num_rows == 0:
                continue
            who = pc.dictionary_encode(b.column("user_id"), null_encoding="encode").indices.to_numpy()
            chunk = b.column("chunk").to_numpy()
            lead = pc.fill_null(b.column("lead"), False).to_numpy(zero_copy_only=False)
            kind = b.column("kind").to_numpy()
            split = b.column("split").to_numpy(zero_copy_only=False)
            amt = b.column("amt").to_numpy(zero_copy_only=False).astype(float)
            t = b.column("t").to_numpy(zero_copy_only=False).astype(float)
            failed = pc.fill_null(b.column("failed"), False).to_numpy(zero_copy_only=False)
            flags = np.zeros(b.num_rows, bool)
            change = (np.diff(who) != 0) | (np.diff(chunk) != 0) | (np.diff(lead.astype(int)) != 0) | (np.diff(kind) != 0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
            states = []
            for lo, hi in zip(cuts, cuts[1:]):
                key = (b.column("user_id")[lo].as_py(), int(chunk[lo]))
                if key != held:
                    if held is not None and wanted:
                        states.append(state_row(2))
                    held, state, open_lead = key, AnomalyState(), False
                    wanted = all_ends or bool(split[lo])
                if kind[lo] == 0:
                    state = AnomalyState(b.column("amounts")[lo].as_py(), b.column("times")[lo].as_py())
                    continue
                if open_lead and not lead[lo]:
                    states.append(state_row(1))
                open_lead = bool(lead[lo])
                flags[lo:hi] = state.fold(amt[lo:hi], t[lo:hi], failed[lo:hi])
            mine = pa.array((kind == 1) & ~lead)
            own = b.filter(mine)
            n = own.num_rows
            yield pa.RecordBatch.from_arrays(
                [own.column("user_id"), own.column("chunk"), own.column("event_id"), pa.array(flags[mine.to_numpy(zero_copy_only=False)]),
                 pa.array([0] * n, pa.int32()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(pa.float64()))],
                names=names)
            if states:
                yield rows_of(states, b.schema)
        if held is not None and wanted:
            yield rows_of([state_row(2)], b.schema)

    def rows_of(states: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [schema.field("user_id").type, pa.int64(), schema.field("event_id").type, pa.bool_(), pa.int32(),
                 pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*states), types)], names=names)

    names = ["user_id", "chunk", "event_id", "flag", "kind", "amounts", "times"]
    out = d.mapInArrow(fold, _OUT.format(user=user, event=event))
    out.write.parquet(path)


def speculative_flags(ev: DataFrame, start: DataFrame | None = None, ends: bool = False, chunk: int = CHUNK,
                      lead: int = LEAD) -> tuple[DataFrame, DataFrame | None, int]:
    """Flags of all events in order of (user, time, event_id), the users' end states if asked for, and the rounds taken.

    Flagged and failed events never enter the history, so each outcome rests on all earlier ones. A user's events are cut
    into chunks of about `chunk`; each chunk is folded in a task of its own from a guessed state, which the `lead`
    events before it give. Where a chunk's guess is not the end of the chunk before, it is folded again from that end,
    until all seams agree: the first chunk is right from the start, and each round makes at least one more right, so the
    result is that of the plain loop. As the memory is 200 amounts, guesses are nearly always right at once.
    `start` has the states (user_id, amounts, times) that users begin with.
    """
    spark = ev.sparkSession
    t = micros(F.col("ts"))
    e = ev.select("event_id", "user_id", "ts", F.abs(F.col("amount").cast("double")).alias("amt"), t.cast("double").alias("t"),
                  (F.col("status") == "FAILED").alias("failed"), F.floor(t / HOUR).alias("hour"))
    base = scratch(spark, "flags")
    places = _places(e, chunk, lead)
    places.write.parquet(f"{base}/places")
    places = spark.read.schema(places.schema).parquet(f"{base}/places")
    split = not places.isEmpty()
    if split:
        here = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("hour").eqNullSafe(F.col("_hour"))
        alone = F.array(F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("lead")))
        rows = (e.join(places, here, "left").withColumn("split", F.col("places").isNotNull())
                .withColumn("place", F.explode(F.coalesce("places", alone)))
                .select("event_id", "user_id", "ts", "amt", "t", "failed", "split", "place.chunk", "place.lead"))
    else:
        rows = e.drop("hour").withColumns({"chunk": F.lit(0).cast("long"), "lead": F.lit(False), "split": F.lit(False)})
    first = None
    if start is not None:
        first = start.select("user_id", F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("split"), "amounts", "times")
    kinds = dict(e.dtypes)
    schema = _OUT.format(user=kinds["user_id"], event=kinds["event_id"]) + ", round int"
    _run(rows, first, ends, f"{base}/runs/round=0")
    rounds, seams = 1, None
    state = F.struct("amounts", "times")
    while True:
        runs = spark.read.schema(schema).parquet(f"{base}/runs")
        ended = runs.where("kind = 2").groupBy("user_id", "chunk").agg(F.max_by(state, "round").alias("ended"))
        if not split:
            break
        starts = runs.where("kind = 1").select("user_id", "chunk", "amounts", "times", "round")
        starts = starts if seams is None else starts.unionByName(seams)
        began = (starts.groupBy("user_id", "chunk").agg(F.max_by(state, "round").alias("began"))
                 .select(F.col("user_id").alias("_u"), F.col("chunk").alias("_c"), "began"))
        same = F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("chunk") == F.col("_c"))
        before = F.lag("ended").over(W.partitionBy("user_id").orderBy("chunk"))
        at = ended.withColumn("before", before).where(F.col("before").isNotNull()).join(began, same, "left")
        wrong = at.where(~F.col("began").eqNullSafe(F.col("before"))).select("user_id", "chunk", "before.amounts", "before.times")
        wrong.write.parquet(f"{base}/seams/round={rounds}")
        seams = spark.read.schema(T.StructType([*wrong.schema.fields, T.StructField("round", T.IntegerType())])).parquet(f"{base}/seams")
        todo = seams.where(F.col("round") == rounds).drop("round")
        if todo.isEmpty():
            break
        redo = todo.select(F.col("user_id").alias("_u"), F.col("chunk").alias("_c"))
        again = rows.where(~F.col("lead") & F.col("split")).join(redo, same, "left_semi")
        _run(again, todo.withColumn("split", F.lit(True)), True, f"{base}/runs/round={rounds}")
        rounds += 1
    flags = runs.where("kind = 0")
    if rounds > 1:                               # the last fold of a chunk holds
        last = seams.groupBy(F.col("user_id").alias("_u"), F.col("chunk").alias("_c")).agg(F.max("round").alias("_r"))
        flags = flags.join(last, same, "left").where(F.col("round") == F.coalesce("_r", F.lit(0)))
    end = None
    if ends:
        last = e.groupBy("user_id").agg(F.max("t").alias("last")).withColumnRenamed("user_id", "_u")
        top = ended.groupBy("user_id").agg(F.max_by("ended", "chunk").alias("s")).select("user_id", "s.amounts", "s.times")
        end = top.join(last, F.col("user_id").eqNullSafe(F.col("_u"))).drop("_u")
    return flags.select("event_id", "user_id", F.col("flag").alias("anomaly_flag")), end, rounds


def stateful_flags(ev: DataFrame, chunk: int = CHUNK, lead: int = LEAD) -> DataFrame:
    """The check as events arrive: event_id, user_id, anomaly_flag. See `speculative_flags`."""
    return speculative_flags(ev, chunk=chunk, lead=lead)[0]
