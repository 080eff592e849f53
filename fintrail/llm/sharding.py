"""Contiguous shards of least greatest size over atomic groups (native)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from fintrail.llm.common import stored

ROW_BYTES = 16                 # size of a row besides its text
FIRST_BITS, STEP_BITS = 14, 8  # key bits of the first summary, and of each refinement
SALTS = 256                    # parts a shard is cut into while its rows are numbered


@dataclass
class Segment:
    """A run of neighbouring groups; `single` if it is one group, which cannot be cut."""
    first: int
    last: int
    size: int
    largest: int
    bits: int

    @property
    def single(self) -> bool:
        return self.first == self.last


class _Line:
    """Ordered segments with prefix sums, and the greedy checks on them."""

    def __init__(self, segments: list[Segment]):
        self.seg = sorted(segments, key=lambda s: s.first)
        self.ends, self.starts, total = [], [], 0
        for s in self.seg:
            self.starts.append(total)
            total += s.size
            self.ends.append(total)
        self.total = total

    def low(self, x: int, capacity: int) -> int:
        """A place that the true next cut from x or later never lies before."""
        i = bisect_right(self.ends, x)
        if i == len(self.seg):
            return self.total
        j = bisect_right(self.ends, x + capacity) - 1
        to = self.ends[j] if j >= 0 else 0
        return max(to, self.ends[i] if self.seg[i].single else x)

    def high(self, x: int, capacity: int) -> int:
        """A place that the true next cut from x or earlier never lies behind."""
        i = bisect_right(self.ends, x)
        if i == len(self.seg):
            return self.total
        to = x + capacity
        if self.seg[i].largest > capacity:
            to = max(to, self.ends[i])
        j = bisect_right(self.ends, to)
        if j < len(self.seg) and self.seg[j].single and j > i:
            to = self.starts[j]
        elif j == i and self.seg[i].single:
            to = self.ends[i]
        return min(to, self.total)

    def may_fit(self, capacity: int, shards: int) -> bool:
        x = 0
        for _ in range(shards):
            x = self.high(x, capacity)
        return x >= self.total

    def fits(self, capacity: int, shards: int) -> bool:
        """With whole segments alone: enough, though not needed, for the groups to fit."""
        if any(s.size > capacity and not s.single for s in self.seg):
            return False
        x = 0
        for _ in range(shards):
            x = self.low(x, capacity)
        return x >= self.total


def _least(test, top: int) -> int:
    lo, hi = 0, top
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if test(mid) else (mid + 1, hi)
    return lo


def _summary(groups: DataFrame, bits: int) -> list[Segment]:
    rows = (groups.groupBy(F.shiftright("key", 64 - bits).alias("seg"))
            .agg(F.min("key").alias("first"), F.max("key").alias("last"),
                 F.sum("size").alias("size"), F.max("size").alias("largest")).collect())
    return [Segment(r["first"], r["last"], r["size"], r["largest"], bits) for r in rows]


def least_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity with which ordered groups (key, size) fill at most `shards` contiguous shards, and the keys
    at which shards 1, 2, ... begin. A group above the capacity has a shard of its own.

    The binary search runs on a summary of the groups by leading key bits. Whole segments give an upper bound of the
    capacity, free cuts inside segments a lower one; only segments that a cut may touch between the two are cut finer
    by the next bits, until both bounds meet. So the driver sees a bounded number of sums, and the result is exact.
    """
    segments = _summary(groups, FIRST_BITS)
    while True:
        line = _Line(segments)
        hi = _least(lambda c: line.fits(c, shards), line.total)
        lo = _least(lambda c: line.may_fit(c, shards), hi)
        touched, a, b = set(), 0, 0
        for _ in range(shards):
            a, b = line.low(a, lo), line.high(b, hi)
            touched.update(range(bisect_right(line.ends, a), min(bisect_left(line.starts, b) + 1, len(line.seg))))
        touched.update(i for i, s in enumerate(line.seg) if s.size > lo)
        rough = [i for i in touched if not line.seg[i].single]
        if not rough:
            cuts, x = [], 0
            for _ in range(shards):
                x = line.low(x, hi)
                if x >= line.total:
                    break
                cuts.append(line.seg[bisect_right(line.ends, x)].first)
            return hi, cuts
        keep = [s for i, s in enumerate(line.seg) if i not in set(rough)]
        new = []
        for bits in {line.seg[i].bits for i in rough}:
            own = [(line.seg[i].first >> (64 - bits),) for i in rough if line.seg[i].bits == bits]
            wanted = groups.sparkSession.createDataFrame(own, "seg long")
            part = groups.withColumn("seg", F.shiftright("key", 64 - bits)).join(F.broadcast(wanted), "seg", "left_semi")
            new += _summary(part, min(64, bits + STEP_BITS))
        segments = keep + new


def assign(rows: DataFrame, key: str, size: str, shards: int, order: list[Column]) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 within the shard) to rows; rows of one key stay together.

    `key` must be a non-null long. Slots are numbered in salted parts whose row counts are summed first, so that no
    task orders a whole shard.
    """
    groups = stored(rows.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("size")), "groups")
    _, cuts = least_capacity(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col(key) >= c).cast("int")
    out = rows.withColumn("shard", shard).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    before = W.partitionBy("shard").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = (out.groupBy("shard", "_salt").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = W.partitionBy("shard", "_salt").orderBy(*order)
    return (out.withColumn("_no", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "_salt"])
            .withColumn("slot", F.col("_before") + F.col("_no") - 1).drop("_salt", "_before", "_no"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards by the law `bytes`: equal texts stay together and the largest shard is as small as that allows.

    Returns doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot and grown_shard (null under this law).
    A null text counts as an empty one: no bytes, checksum 0. Equal texts are one group; repeated rows are rows of their own with slots of
    their own. Fewer groups than shards leave the last shards empty; an empty table gives no rows. The offsets that
    are broadcast are shards x 256 numbers. Other input columns are left out.
    """
    t = F.col(f"`{text_col}`")
    # the texts are read once; what follows works on these small rows
    slim = stored(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("_key"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32")), "sizes")
    out = assign(slim, "_key", "size", shards, [F.col("doc_id"), F.col("_key")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
