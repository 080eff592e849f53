"""Quality of documents: repetition and length rules, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fintrail.llm.common import Words, byte_hashes, mix, slices, window_hashes, words_of
from fintrail.llm.ngrams import Chars, char_grams, chars_of, hashed, sums

BITS = 16                      # 2**BITS feature buckets
TRAIN_ROWS = 4000              # bound of the labelled sample that the regression is fitted on
EPOCHS = 12
KEEP_AT = 0.5                  # least probability of good quality
MIN_WORDS, MAX_REPEATED = 20, 30   # words of a text; percent of words in repeated windows
REPEAT = 8                     # words of such a window
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
PIECE = 1 << 20


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    scale: float               # calibration: probability = logistic(scale * score + shift)
    shift: float


def _grams(w: Words, c: Chars) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets and per-text ranges of word unigrams, word bigrams (within texts) and character trigrams."""
    h = w.hashes.astype(np.uint32)
    lo, hi = w.bounds[:-1], w.bounds[1:]
    out = [(hashed([h], 11, BITS), lo, hi)]
    out.append((hashed([h[:-1], h[1:]], 12, BITS) if len(h) > 1 else np.empty(0, np.int32), lo, np.maximum(lo, hi - 1)))
    out.append((char_grams(c, 3, BITS), c.starts, c.ends))
    return out


def base_measures(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a piece."""
    at = w.texts
    upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    blank = np.isin(w.data, np.array([0x20, *range(0x09, 0x0E)], np.uint8))
    out = {"n_words": np.diff(w.bounds), "word_chars": upto(~blank & ((w.data & 0xC0) != 0x80)), "n_symbols": upto(SYMBOLS[w.data])}
    # lines that hold a word, by text and content
    breaks = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    begin = begin[begin < len(w.data)]
    nxt = np.concatenate([begin[1:], [len(w.data)]])[:len(begin)]
    end = np.where((nxt > begin) & (w.data[np.maximum(nxt - 1, 0)] == 10), nxt - 1, nxt) if len(begin) else nxt
    has = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[has], end[has]
    doc = np.searchsorted(at, begin, side="right") - 1
    key = mix(byte_hashes(w.data, begin, end) + mix(doc.astype(np.uint64)))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    n = len(w.bounds) - 1
    out["n_dup_lines"] = np.bincount(doc[~first], minlength=n)
    # words in windows that the text has twice
    h = window_hashes(w.hashes, REPEAT)
    owner = w.docs()
    starts = np.flatnonzero(np.arange(len(h)) + REPEAT <= w.bounds[1:][owner[:len(h)]])
    key = mix(h[starts] + mix(owner[starts].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.hashes) + 1, np.int32)
    edge[starts[twice]] += 1
    edge[starts[twice] + REPEAT] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])[w.bounds]
    out["n_repeat_words"] = np.diff(covered)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(rows: list, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive gradient steps, row by row, with a small L2 penalty; classes weigh alike."""
    w, g2, b, b2 = np.zeros(1 << BITS, np.float64), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            i, v = rows[r]
            e = (_logistic(v @ w[i] + b) - y[r]) * weight[r]
            g = e * v + 1e-6 * w[i]
            g2[i] += g * g
            w[i] -= 0.3 * g / np.sqrt(g2[i])
            b2 += e * e
            b -= 0.3 * e / np.sqrt(b2)
    return w, b


def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make scores of rows left out of the fit into probabilities (Newton steps, ridge on scale)."""
    a, c = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, c
    for _ in range(50):
        p = _logistic(a * s + c)
        r, q = p - y, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(r * s).sum() + 0.1 * (a - 1), r.sum()])
        hess = np.array([[(q * s * s).sum() + 0.1, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(c)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = TRAIN_ROWS) -> QualityModel | None:
    """Fits a model on at most `max_rows` labelled documents, chosen by a hash of the id; every fifth only calibrates.

    Null labels are left out; of several labels of one id the lowest counts. None if there are not both labels.
    """
    chosen = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id is not null and y is not null")
              .groupBy("id").agg(F.min("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows))

    def rows(batches):
        for b in slices(batches, limit=PIECE):
            text = b.column("text")
            grams = _grams(words_of(text), chars_of(text))
            idx, val = [], []
            for i in range(b.num_rows):
                all_i, all_v = [], []
                for g, lo, hi in grams:
                    k, n = np.unique(g[lo[i]:hi[i]], return_counts=True)
                    all_i.append(k)
                    all_v.append(n / max(1, n.sum()))
                k, back = np.unique(np.concatenate(all_i), return_inverse=True)
                idx.append(k.astype(np.int32).tobytes())
                val.append(np.bincount(back, np.concatenate(all_v), len(k)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                                             names=["h", "y", "idx", "val"])

    picked = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
              .join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select(F.xxhash64("id").alias("h"), "y", "text"))
    got = picked.mapInArrow(rows, "h long, y int, idx binary, val binary").toPandas().sort_values("h")
    y = got["y"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    feats = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64) * 10) for i, v in zip(got["idx"], got["val"])]
    held = np.arange(len(y)) % 5 == 4
    w, b = _fit([f for f, h in zip(feats, held) if not h], y[~held])
    scale, shift = _calibrate(np.array([v @ w[i] + b for (i, v), h in zip(feats, held) if h]), y[held])
    return QualityModel((w * 10).astype(np.float32), b, scale, shift)


def judge(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the base measures, base_failed, quality (probability of good quality) and kept.

    A text fails the base rules with fewer than 20 words or with more than 30 % of its words in repeated windows. It is
    kept if it passes them and its probability is at least KEEP_AT; without a model every probability is 1. Null and
    empty texts have no words and are not kept. Repeated rows are judged alike; other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def score(batches):
        m = shared.value
        for b in slices(batches, limit=PIECE):
            text = b.column("text")
            w = words_of(text)
            base = base_measures(w)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"])
            p = np.ones(b.num_rows)
            if m is not None:
                s = sum(sums(m.weights[g], lo, hi).astype(np.float64) / np.maximum(1, hi - lo) for g, lo, hi in _grams(w, chars_of(text)))
                p = _logistic(m.scale * (s + m.bias) + m.shift)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(base[k]) for k in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_AT))],
                names=["id", *names, "base_failed", "quality", "kept"])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(score, f"id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, quality double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(docs, train(docs, labels, id_col, text_col), id_col, text_col)
