"""What the text operators share: stored stages, bounded Arrow slices, words and their hashes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fintrail.session import scratch

SLICE_BYTES = 4 << 20          # text that one Python step holds at once
LONG = 256                     # bytes from which a range is hashed by a call of its own
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage into the shared folder and reads it back: a lost executor costs one task, not the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(df: DataFrame) -> None:
    """Deletes the files of a stage that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text. Repeated rows share it, and so share their results."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(text_col).isNull())


def fold_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece stay under `limit` bytes (one longer text makes a piece of its own)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


@dataclass
class Words:
    """The words of a piece's texts, in order: hash, bytes [starts, ends) of `data`, and each text's range of words."""
    data: np.ndarray
    texts: np.ndarray          # byte offsets of the texts in data
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray         # word offsets of the texts
    hashes: np.ndarray

    def docs(self) -> np.ndarray:
        """For each word, the number of its text within the piece."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def byte_map(change: dict[int, int]) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for a, b in change.items():
        out[a] = b
    return out


LOWER = byte_map({c: c + 32 for c in range(65, 91)})
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: none), and the offsets of the texts."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(t):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(t.buffers()[1], np.int64)[t.offset:t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8)[o[0]:o[-1]] if o[-1] > o[0] else np.empty(0, np.uint8)
    return data, o - o[0]


def words_of(texts: pa.Array, bytes_as: np.ndarray | None = None) -> Words:
    """Words are runs of bytes that are not ASCII white space, after each byte b is read as bytes_as[b]."""
    data, at = text_bytes(texts)
    if bytes_as is not None:
        data = bytes_as[data]
    inside = ~BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.diff(at) > 0     # words end where their text ends
    head, tail = at[:-1][full], at[1:][full] - 1
    first[head], last[tail] = inside[head], inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, at, starts, ends, np.searchsorted(starts, at), byte_hashes(data, starts, ends))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step, long ones by themselves; alike in every task."""
    n = ends - starts
    h = n.astype(np.uint64) * M2
    long = np.flatnonzero(n > LONG)
    if len(long):
        raw = data.tobytes()
        h[long] = [xxhash.xxh64_intdigest(raw[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    left, todo = n, np.flatnonzero(n <= LONG)
    for k in itertools.count():
        todo = todo[left[todo] > 8 * k]
        if not len(todo):
            return mix(h)
        part = eights[starts[todo] + 8 * k]
        spare = np.maximum(0, 8 - (left[todo] - 8 * k)).astype(np.uint64) * np.uint64(8)
        h[todo] = mix(h[todo] ^ ((part << spare) >> spare)) + M1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * M1
    h = h ^ (h >> np.uint64(29))
    h = h * M2
    return h ^ (h >> np.uint64(32))


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; positions whose window would pass the end are left out."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = w[:n].copy()
    for j in range(1, k):
        acc *= M1
        acc ^= acc >> np.uint64(32)
        acc += w[j:j + n]
    return mix(acc)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
