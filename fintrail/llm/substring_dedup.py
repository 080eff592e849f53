"""Removal of word windows that occur more than once, found by level-wise doubling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fintrail.llm.common import BLANK, Words, row_key, slices, stored, window_hashes, words_of

WINDOW = 35                    # words of a removed window
LOW = np.uint64((1 << 24) - 1)  # words of a block are numbered in 24 bits beside 40 bits of hash
BLOCK = 1 << 23                 # windows whose anchors are found at once; blocks overlap by a window, so that none is changed


def levels(window: int) -> tuple[int, int]:
    """The first two window lengths: a quarter and a half of the last, rounded up, so that two cover the next."""
    half = -(-window // 2)
    return -(-half // 2), half


def _anchors(h: np.ndarray, n: int, width: int, block: int = BLOCK) -> np.ndarray:
    """For each of n windows, where the least of its `width` hashes stands (the last of equals)."""
    out = [np.empty(0, np.int64)]
    for begin in range(0, n, block):
        part = h[begin:min(begin + block, n) + width - 1]
        key, have = (part & ~LOW) | (LOW - np.arange(len(part), dtype=np.uint64)), 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[:len(key) - (width - have)], key[width - have:])
        out.append((LOW - (key & LOW)).astype(np.int64) + begin)
    return np.concatenate(out)


class _Grid:
    """The windows of a piece and the short windows that stand for them at the lower levels.

    Of the level-1 windows inside a window, the one with the least hash (the last of equals) is its anchor. Equal
    windows have equal anchors at equal offsets, so a window can only be repeated if its anchor is. Level 2 doubles
    the anchor towards the side on which the window has room: forward, else backward.
    """

    def __init__(self, w: Words, window: int):
        first, half = levels(window)
        self.w, self.window, self.first, self.half = w, window, first, half
        n = max(0, len(w.hashes) - window + 1)
        doc = w.docs()
        self.starts = np.flatnonzero(np.arange(n) + window <= w.bounds[1:][doc[:n]])
        self.doc = doc
        h = window_hashes(w.hashes, first)
        self.small = h
        self.anchor = _anchors(h, n, window - first + 1)[self.starts]
        self.forward = self.anchor + half <= self.starts + window

    def doubled(self) -> tuple[np.ndarray, np.ndarray]:
        """Start of the level-2 window of each window, and whether it lies forward of the anchor."""
        return np.where(self.forward, self.anchor, self.anchor + self.first - self.half), self.forward

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text, and position within it."""
        d = self.doc[at]
        return d, (at - self.w.bounds[d]).astype(np.int32)


def _flags(b: pa.RecordBatch, w: Words, kinds: int = 1) -> np.ndarray:
    """Marks the listed places of each text (kinds x words); a place is position * kinds + kind.

    Of a text that has copies, every place is marked: whatever it holds is repeated.
    """
    lists = b.column("ps")
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((kinds, len(w.hashes) + 1), bool)
    out[coded % kinds, coded // kinds + np.repeat(w.bounds[:-1], n)] = True
    out[:, :-1] |= np.repeat(b.column("copied").to_numpy(zero_copy_only=False), np.diff(w.bounds))
    return out


ROWS = "h long, key long, pos int, copied boolean"


def _batch(b: pa.RecordBatch, d: np.ndarray, pos: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    at = pa.array(d)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("key").take(at), pa.array(pos), b.column("copied").take(at)],
                                      names=["h", "key", "pos", "copied"])


def _rows(docs: DataFrame, window: int, level: int) -> DataFrame:
    """The windows of one level that are still candidates: hash, text and position. One copy speaks for all."""
    def rows(batches):
        for b in slices(batches):
            b = b.filter(b.column("speaks"))
            w = words_of(b.column("text"))
            g = _Grid(w, window)
            if level == 1:
                at = np.unique(g.anchor)
                yield _batch(b, *g.place(at), g.small[at])
                continue
            at, forward = g.doubled()
            if level == 2:
                alive = _flags(b, w)[0]
                h = window_hashes(w.hashes, g.half)
                for side in (True, False):
                    x = np.unique(at[(forward == side) & alive[g.anchor]])
                    d, pos = g.place(x)
                    # both kinds of a start have numbers of their own: 2 * position, and one more if backward
                    yield _batch(b, d, pos * 2 + (not side), h[x] ^ np.uint64(not side))
            else:
                x = g.starts[_flags(b, w, 2)[(~forward).astype(np.int64), at]]
                yield _batch(b, *g.place(x), window_hashes(w.hashes, window)[x])
    return docs.mapInArrow(rows, ROWS)


def _repeated(rows: DataFrame) -> DataFrame:
    """Of each text without copies, the positions whose hash occurs at least twice."""
    twice = rows.groupBy("h").agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("n")).where("n >= 2").select("h")
    return rows.where("not copied").select("h", "key", "pos").join(twice, "h", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("ps"))


def _copies(slim: DataFrame) -> DataFrame:
    """Stored, per key: whether its text has copies, and whether this row speaks for the text (one of its copies does)."""
    each = slim.groupBy(F.xxhash64("text", F.col("text").isNull()).alias("same"), "key").agg(F.count(F.lit(1)).alias("n"))
    texts = each.groupBy("same").agg(F.sum("n").alias("n"), F.min("key").alias("first"))
    return stored(each.select("same", "key").join(texts, "same").select("key", (F.col("n") > 1).alias("copied"),
                                                                        (F.col("key") == F.col("first")).alias("speaks")), "copies")


def _joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    last = np.ones(len(keep), bool)
    doc = w.docs()[keep]
    last[:-1] = doc[1:] != doc[:-1]
    edge = np.zeros(len(w.data) + 2, np.int8)
    edge[w.starts[keep]] += 1
    # a word that another one follows takes the blank behind it along
    np.subtract.at(edge, w.ends[keep] + ~last, 1)
    mask = np.cumsum(edge[:len(w.data)], dtype=np.int8).astype(bool)
    blank = BLANK[w.data]
    out = np.where(blank, np.uint8(32), w.data)[mask]
    offsets = np.concatenate([[0], np.cumsum(mask)])[w.texts]
    return pa.LargeStringArray.from_buffers(len(w.texts) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _kept(docs: DataFrame, window: int, id_type: str) -> DataFrame:
    def rows(batches):
        for b in slices(batches):
            w = words_of(b.column("text"))
            starts = _flags(b, w)[0, :-1]
            starts &= np.arange(len(starts)) + window <= w.bounds[1:][w.docs()]
            n = np.cumsum(starts, dtype=np.int32)
            gone = n - np.concatenate([np.zeros(min(window, len(n)), np.int32), n[:-window]]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[w.bounds]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("id"), pa.array(np.diff(w.bounds)), pa.array(np.diff(removed)),
                 _joined(w, np.flatnonzero(~gone))], names=["key", "id", "n_words", "n_removed", "kept"])
    return docs.mapInArrow(rows, f"key long, id {id_type}, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: key, id, n_words, n_removed, and the kept words joined by one space.

    A word goes if a window of `window` words that covers it has the same words as a window that starts elsewhere, in
    this or another document; windows are judged on the input. So all copies of a passage go, also those of repeated
    rows. Null, empty and wordless texts keep nothing (empty text); texts shorter than a window stay whole. Texts of any
    length are taken whole, in memory in proportion to them. Other columns are left out.

    Level 1 counts one short window (the anchor) of each window; only the anchors that repeat are doubled and counted
    again, and only where that repeats are the windows themselves counted. The texts are shuffled once, by key; all
    levels and the removal read that one exchange again (so all of them ask for the same columns of it). Each level's counts are pre-summed, and its survivors return
    to the texts in lists no longer than a text. Of equal texts one takes part, with double weight.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    copies = _copies(slim)
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = slim.repartition(parts, "key").join(copies, "key")

    def with_survivors(level: int, before: DataFrame) -> DataFrame:
        found = _repeated(_rows(before, window, level))
        return placed.join(found, "key", "left").select("key", "id", "text", "copied", "speaks", "ps")

    state = placed.withColumn("ps", F.expr("cast(null as array<int>)"))
    for level in (1, 2, 3):
        state = with_survivors(level, state)
    return _kept(state, window, kind)
