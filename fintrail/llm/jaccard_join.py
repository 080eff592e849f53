"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the decision."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fintrail.llm.common import M1, mix, row_key, slices, stored, window_hashes, words_of
from fintrail.llm.components import components

SHINGLE = 5                    # words of an n-gram
THRESHOLD = 0.8
RECALL = 0.9999                # share of pairs at the threshold that must become candidates
ROWS = 5                       # minima of a band
BLOCK_WORDS = 300_000          # n-grams and members compared in one task: two blocks of this size
BLOCK_DOCS = 2048
CELLS = 1 << 22                # of the incidence matrix held at once
FEW, STRIP = 8, 512            # sets from which an n-gram goes into the matrix; rows of it compared at once


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands of `rows` minima with which a pair at `threshold` shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def _shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes of all texts, and each text's range. A text of fewer words has one n-gram, all its words."""
    n = np.diff(bounds)
    windows = window_hashes(hashes, k)
    at = np.arange(len(windows))
    doc = np.repeat(np.arange(len(n)), n)[:len(windows)]
    inside = at + k <= bounds[1:][doc]
    parts, owner = [windows[inside]], [doc[inside]]
    for short in range(1, k):
        d = np.flatnonzero(n == short)
        if len(d):
            parts.append(window_hashes(hashes, short)[bounds[d]] + np.uint64(short))
            owner.append(d)
    values, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return values[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


def _signatures(values: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of the texts that have n-grams."""
    full = bounds[:-1][np.diff(bounds) > 0]
    x = (values >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(7)
    out = np.empty((len(full), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(full), b + 1, np.uint64)
        for _ in range(rows):
            f, s = (int(v) for v in rng.integers(1, 1 << 31, 2))
            y = (x ^ np.uint32(s)) * np.uint32(2 * f + 1)
            y ^= y >> np.uint32(15)
            y *= np.uint32(2246822519)
            y ^= y >> np.uint32(13)
            acc = mix(acc * M1 + np.minimum.reduceat(y, full))
        out[:, b] = acc
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """Stored: key, id, n_words, unit (hash of the word sequence; null without words), bands."""
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def sign(batches):
        for b in slices(batches):
            w = words_of(b.column("text"))
            n = np.diff(w.bounds)
            full = n > 0
            place = np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], n)
            unit = np.zeros(len(n), np.uint64)
            if full.any():
                unit[full] = mix(np.add.reduceat(mix(w.hashes + M1 * place.astype(np.uint64)), w.bounds[:-1][full]) + n[full].astype(np.uint64))
            sig = _signatures(*_shingles(w.hashes, w.bounds, shingle), bands, rows) if full.any() else np.empty((0, bands), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32()),
                                             pa.array(sig.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("id"), pa.array(n), pa.array(unit.view(np.int64), mask=~full), lists],
                names=["key", "id", "n_words", "unit", "bands"])

    return stored(slim.mapInArrow(sign, f"key long, id {kind}, n_words long, unit long, bands array<long>"), "signatures")


def _groups(batches, columns: tuple[str, ...]):
    """Runs of rows with equal `columns`, across batches."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in columns])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            this = tuple(k[:, lo].tolist())
            if held and this != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = this
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def _common(values: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """Numbers of common n-grams of the sets before `first` with those from `first` on (0: of all sets with all).

    N-grams in many sets are counted by matrix products, those in few by adding up their pairs of sets.
    """
    m = len(sizes)
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    column, row = at[shared[at]], np.repeat(np.arange(m), sizes)[shared[at]]
    order = np.argsort(column, kind="stable")        # rows stay in order within a column
    column, row = column[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.empty(0, np.int64)
    width = np.diff(np.append(begin, len(column)))
    out = np.zeros((first or m, m - first), np.float32)
    for k in range(2, FEW):
        at = begin[width == k]
        for i in range(k):
            for j in range(i + 1, k):
                a, b = row[at + i], row[at + j]
                if first:
                    cross = (a < first) & (b >= first)
                    np.add.at(out, (a[cross], b[cross] - first), 1)
                else:
                    np.add.at(out, (a, b), 1)
                    np.add.at(out, (b, a), 1)
    many = np.repeat(width >= FEW, width)
    number = (np.cumsum(width >= FEW) - 1).repeat(width)[many]
    row, total = row[many], int((width >= FEW).sum())
    step = max(64, CELLS // m)
    for lo in range(0, total, step):
        i, j = np.searchsorted(number, [lo, lo + step])
        cells = np.zeros((m, min(step, total - lo)), np.float32)
        cells[row[i:j], number[i:j] - lo] = 1
        out += cells[:first or m] @ cells[first:].T
    return out


def _linked(common: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which pairs reach the threshold, exactly: common / (left + right - common) >= top / bottom."""
    top, bottom = threshold.numerator, threshold.denominator
    out = np.empty(common.shape, bool)
    for lo in range(0, len(left), STRIP):
        part = slice(lo, lo + STRIP)
        out[part] = common[part].astype(np.float64) * (top + bottom) >= (left[part, None] + right[None, :]) * float(top)
    return out


def _least(link: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row the least label among its links."""
    out = np.empty(len(link), np.int64)
    for lo in range(0, len(link), STRIP):
        out[lo:lo + STRIP] = np.where(link[lo:lo + STRIP], label[None, :], np.iinfo(np.int64).max).min(1)
    return out


def _compare(batches, threshold: Fraction):
    """Links of each unit within its group (between the two blocks, if they differ) and the least unit it hangs on."""
    for (_, lo, hi), t in _groups(batches, ("comp", "lo", "hi")):
        if t.num_rows < 2:
            continue
        if lo != hi:
            t = t.sort_by("block")
        unit, copies = t.column("unit").to_numpy(), t.column("copies").to_numpy().astype(np.float64)
        grams = t.column("grams").combine_chunks()
        sizes = grams.value_lengths().to_numpy()
        first = int((t.column("block").to_numpy() == lo).sum()) if lo != hi else 0
        if lo != hi and first in (0, len(unit)):
            continue
        link = _linked(_common(grams.flatten().to_numpy(), sizes, first), sizes[:first or None], sizes[first:], threshold)
        if not first:
            np.fill_diagonal(link, False)
            links, label, old = link @ copies, unit.copy(), None
            while old is None or (label != old).any():
                old, label = label, np.minimum(label, _least(link, label))
            some = link.any(1)
        else:
            links = np.concatenate([link @ copies[first:], copies[:first] @ link])
            a, b, old = unit[:first].copy(), unit[first:].copy(), None
            while old is None or (a != old).any():
                old = a
                b = np.minimum(b, _least(link.T, a))
                a = np.minimum(a, _least(link, b))
            label, some = np.concatenate([a, b]), np.concatenate([link.any(1), link.any(0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(unit[some]), pa.array(links[some].astype(np.int64)), pa.array(label[some])], names=["unit", "links", "least"])


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL,
                       rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: key, doc_id, class_id, n_links, class_key (key of the document that stands for the class).

    Two documents are linked if the Jaccard similarity of their word n-gram sets is at least `threshold`; n_links
    counts the other documents linked with this one, copies included, and class_id is the least doc_id that links
    lead to, over any number of steps. Documents without words (null, empty) have no links and their own class.
    Texts of fewer than `shingle` words are one n-gram. A null doc_id counts only in a class that has no other.

    Equal word sequences are one unit with a number of copies. Units that share a band hash are candidates; instead
    of pairs, each bucket hangs its members on its least one, and the components of that graph are compared: inside
    tasks, block against block, on the full n-gram sets. Only sums per unit and one edge per unit and block leave a
    task, so groups of any size cost rows in proportion to members times blocks, and no link is lost.
    """
    bands = bands_for(threshold, rows, recall)
    share = Fraction(str(threshold))
    sigs = signatures(docs, id_col, text_col, shingle, bands, rows)
    units = stored(sigs.where("unit is not null").groupBy("unit").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("head"), F.count(F.lit(1)).alias("copies"),
        F.first("n_words").alias("n_words"), F.first("bands").alias("bands")).withColumn("key", F.col("head.key")), "units")
    banded = units.select("unit", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("unit").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = components(banded.join(heads, "band").select(F.col("unit").alias("a"), F.col("head").alias("b")))
    near = stored(near.select(F.col("v").alias("unit"), F.col("root").alias("comp")), "candidates")

    members = near.join(units.select("unit", "key", "copies", "n_words"), "unit")
    sizes = members.groupBy("comp").agg(F.greatest(
        F.ceil(F.sum("n_words") / BLOCK_WORDS), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("int").alias("blocks"))
    members = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    text = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    held = text.join(members.select("key", "unit", "copies", "comp", "block", "blocks"), "key")
    kinds = "key long, unit long, copies long, comp long, block int, blocks int"

    def sets(batches):
        for b in slices(batches):
            w = words_of(b.column("text"))
            values, bounds = _shingles(w.hashes, w.bounds, shingle)
            grams = [np.unique(values[lo:hi]).view(np.int64) for lo, hi in zip(bounds[:-1], bounds[1:])]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(grams)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "unit", "copies", "comp", "block", "blocks")), lists],
                                             names=["key", "unit", "copies", "comp", "block", "blocks", "grams"])

    # repeated rows share a key: one of them is enough
    dealt = (held.mapInArrow(sets, kinds + ", grams array<long>")
             .select("unit", "copies", "comp", "block", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("unit", "copies", "comp", "block", "grams", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "unit")

    def compare(batches):
        seen = _once(batches)
        yield from _compare(seen, share)

    found = stored(grouped.mapInArrow(compare, "unit long, links long, least long"), "links")
    classes = components(found.select(F.col("unit").alias("a"), F.col("least").alias("b")))
    ranked = (classes.join(units.select(F.col("unit").alias("v"), "head"), "v")
              .groupBy("root").agg(F.min("head").alias("class")).join(classes, "root").select(F.col("v").alias("unit"), "class"))
    counts = found.groupBy("unit").agg(F.sum("links").alias("links"))
    per_unit = (units.select("unit", "head", "copies").join(counts, "unit", "left").join(ranked, "unit", "left")
                .select("unit", F.coalesce("class", "head").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")))
    return (sigs.select("key", "id", "unit").join(per_unit, "unit", "left")
            .select("key", F.col("id").alias("doc_id"), F.when(F.col("unit").isNull(), F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("unit").isNull(), F.col("key")).otherwise(F.col("class.key")).alias("class_key")))


def _once(batches):
    """Drops rows that repeat the one before (same group and unit)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("comp", "lo", "hi", "unit")])
        new = np.ones(b.num_rows, bool)
        new[1:] = (k[:, 1:] != k[:, :-1]).any(0)
        new[0] = last != tuple(k[:, 0].tolist())
        last = tuple(k[:, -1].tolist())
        yield b if new.all() else b.filter(pa.array(new))
