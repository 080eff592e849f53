"""Trailing sums as of every single event."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import DAY_MICROS, micros, rnd

c = F.col
SIZES = (7, 30, 90)
UNIT = 10_000                  # amounts are summed as whole ten-thousandths, so that what leaves a window cancels exactly
FIRST = -(1 << 62)             # before every time of day
KINDS = {"essential": "EXPENSE_ESSENTIAL", "discretionary": "EXPENSE_DISCRETIONARY", "emi": "EMI_PAYMENT", "subscription": "SUBSCRIPTION"}


def _running(sizes: Sequence[int], kinds: int, keys: list[str], at: str, before: bool):
    """Running totals of sorted entries, for mapInArrow: a row for each wanted one, or each `at` with a wanted one.

    Totals start anew with each value of `keys`. They hold all entries of the same `at` (before: none of them), and what a
    row `_carry` brings. What a task keeps between batches is one row of totals and the entries of the last `at`.
    """
    width = 1 + kinds + len(K.CATEGORIES)

    def changes(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
        out = np.zeros(b.num_rows, bool)
        out[0] = True
        for n in names:
            x = b.column(n).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            out[1:] |= x[1:] != x[:-1]
        return out

    def numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
        return pc.fill_null(b.column(name), -1 if name in ("_leaves", "_k", "_c") else 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def entered(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((b.num_rows, width * len(sizes)), np.int64)
        leaves, k, cat, amount, size, n = (numbers(b, x) for x in ("_leaves", "_k", "_c", "_sum", "_abs", "_n"))
        row = np.arange(b.num_rows)
        for j, days in enumerate(sizes):
            sign = (leaves == 0).astype(np.int64) - (leaves == days)
            out[:, j * width] = sign * n
            typed, placed = np.flatnonzero(k >= 0), np.flatnonzero(cat >= 0)
            out[typed, j * width + 1 + k[typed]] = (sign * np.where(k == 0, amount, size))[typed]
            out[placed, j * width + 1 + kinds + cat[placed]] = (sign * size)[placed]
        if "_carry" in b.schema.names:
            brought = np.flatnonzero(b.column("_carry").is_valid().to_numpy(zero_copy_only=False))
            if len(brought):
                out[brought] += pc.list_flatten(b.column("_carry")).to_numpy().reshape(len(brought), -1)
        return out

    def done(b: pa.RecordBatch, state: np.ndarray, last: list | None) -> tuple[pa.RecordBatch | None, np.ndarray]:
        starts, new = changes(b, keys), changes(b, [*keys, at])
        starts[0] = last is None or last != [b.column(x)[0].as_py() for x in keys]
        sums = np.cumsum(entered(b), axis=0)
        first = np.flatnonzero(starts)
        base = np.concatenate([-state[None, :], sums[first - 1] * (first > 0)[:, None]])
        sums -= base[np.cumsum(starts)]
        own = b.column("_own").to_numpy(zero_copy_only=False).astype(bool)
        begins, place = np.flatnonzero(new), np.cumsum(new) - 1
        if before:
            pick = begins[np.maximum.reduceat(own, begins)]
            held = np.where(starts[pick][:, None], 0, np.where((pick > 0)[:, None], sums[pick - 1], state[None, :]))
            names, label = ["user_id", at], "_carry"
        else:
            pick = np.flatnonzero(own)
            held = sums[np.append(begins[1:], b.num_rows)[place[pick]] - 1]
            names, label = ["event_id", "user_id", "ts"], "_cells"
        out = None
        if len(pick):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1, dtype=np.int32) * held.shape[1]), pa.array(held.ravel()))
            out = pa.RecordBatch.from_arrays([*[b.column(x).take(pa.array(pick)) for x in names], lists], names=[*names, label])
        return out, sums[-1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, rest = np.zeros(width * len(sizes), np.int64), None, None
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            to = int(np.flatnonzero(changes(b, [*keys, at]))[-1])
            rest = b.slice(to)
            if to:
                head = b.slice(0, to)
                out, state = done(head, state, last)
                last = [head.column(x)[to - 1].as_py() for x in keys]
                if out is not None:
                    yield out
        if rest is not None:
            out, _ = done(rest, state, last)
            if out is not None:
                yield out

    return run


def event_summaries(events: DataFrame, sizes: Sequence[int] = SIZES, wanted: Column | None = None) -> DataFrame:
    """Per event: what its user's last 7, 30 and 90 days hold up to it, and a map of absolute amounts by category.

    An event counts in a window of n days while its age in whole days is at most n, so for less than n + 1 days.
    Events of the same instant count for each other, in whatever order they came. Income is signed, all other sums are
    of absolute amounts. Null and non-finite amounts count as events of amount zero; a category outside the fixed list
    (or null) counts as OTHER; categories whose amounts add up to zero are not in the map. Events without a time have
    no row, a null user is a user. `wanted` limits the rows that are returned, not what they count.

    Each event is entered once and taken out once for each window; a running total of both is the window's content, so
    the cost is linear in events whatever the windows hold. The totals run within (user, day) and are carried from day
    to day by one small row each, so no task holds a user's whole history. What is shuffled are the entries, a few
    columns each, and one wide row for each day on which a user has a wanted event; running totals stay in their task.
    """
    t = micros(c("ts"))
    a = F.coalesce(F.round(c("amount") * UNIT).try_cast("long"), F.lit(0))
    # a kind or category is its number in the lists below
    number = lambda x, names, other: F.coalesce(*[F.when(x == n, i) for i, n in enumerate(names)], F.lit(other)).cast("byte")
    kinds = {"income": "INCOME", **KINDS}
    ev = events.where("ts is not null").select(
        c("event_id"), c("user_id"), c("ts"), t.alias("_t"), a.alias("_a"), number(c("transaction_type"), kinds.values(), -1).alias("_k"),
        number(c("merchant_category"), K.CATEGORIES, K.CATEGORIES.index("OTHER")).alias("_c"),
        (F.lit(True) if wanted is None else wanted).alias("_own"))
    none = lambda n: F.lit(None).cast(dict(ev.dtypes)[n])
    marks = ev.select("user_id", "_a", "_k", "_c", F.inline(F.array(
        F.struct(c("_t"), F.lit(0).cast("byte").alias("_leaves"), c("_own"), c("event_id"), c("ts")),
        *[F.struct((c("_t") + (n + 1) * DAY_MICROS).alias("_t"), F.lit(n).cast("byte").alias("_leaves"), F.lit(False).alias("_own"),
                   none("event_id").alias("event_id"), none("ts").alias("ts")) for n in sizes]))).withColumn("_day", F.floor(c("_t") / DAY_MICROS))

    cells = [f"{p}_{n}" for n in sizes for p in ("count", *kinds, *[f"c{i}" for i in range(len(K.CATEGORIES))])]
    user, event, time = (dict(ev.dtypes)[x] for x in ("user_id", "event_id", "ts"))
    days = marks.groupBy("user_id", "_day", "_leaves", "_k", "_c").agg(
        F.sum("_a").alias("_sum"), F.sum(F.abs("_a")).alias("_abs"), F.count(F.lit(1)).alias("_n"), F.max("_own").alias("_own"))
    carried = (days.repartition("user_id").sortWithinPartitions("user_id", "_day").mapInArrow(
        _running(sizes, len(kinds), ["user_id"], "_day", before=True), f"user_id {user}, _day long, _carry array<long>")
        .select("user_id", "_day", F.lit(FIRST).alias("_t"), F.lit(False).alias("_own"), "_carry"))
    # a day's rows: first what earlier days carry into it, then its entries
    entries = marks.select("*", c("_a").alias("_sum"), F.abs("_a").alias("_abs"), F.lit(1).cast("long").alias("_n")).drop("_a")
    rows = entries.unionByName(carried, allowMissingColumns=True).repartition("user_id", "_day").sortWithinPartitions("user_id", "_day", "_t")
    here = rows.mapInArrow(_running(sizes, len(kinds), ["user_id", "_day"], "_t", before=False),
                           f"event_id {event}, user_id {user}, ts {time}, _cells array<long>")
    total = here.select("event_id", "user_id", "ts", *[c("_cells")[i].alias(x) for i, x in enumerate(cells)])
    cell = lambda p, n: c(f"{p}_{n}")
    # whole ten-thousandths are rounded as such, like `rnd` does their quotient; beyond ten million that shows its own digits
    money = lambda x: F.when(F.abs(x) < 10_000_000 * UNIT, F.floor((x + 50) / 100.0) / 100.0).otherwise(rnd(x / float(UNIT), 2))
    out = []
    for n in sizes:
        spent = cell("essential", n) + cell("discretionary", n) + cell("emi", n) + cell("subscription", n)
        pairs = F.array(*[F.struct(F.lit(name).alias("k"), money(cell(f"c{i}", n)).alias("v"), cell(f"c{i}", n).alias("x")) for i, name in enumerate(K.CATEGORIES)])
        held = F.transform(F.filter(pairs, lambda x: x["x"] != 0), lambda x: F.struct(x["k"], x["v"]))
        out += [*[money(cell(p, n)).alias(f"{p}_{n}d") for p in ("income", *KINDS)], money(cell("income", n) - spent).alias(f"net_cashflow_{n}d"),
                cell("count", n).alias(f"event_count_{n}d"), F.map_from_entries(held).alias(f"categories_{n}d")]
    return total.select("event_id", "user_id", "ts", *out)
