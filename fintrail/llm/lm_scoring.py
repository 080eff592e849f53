"""Language-model scores of documents: a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fintrail.llm.common import LOWER, Words, fold_of, mix, row_key, slices, stored, words_of

TOP_WORDS = 1_023              # words that the model tells apart; with the end of text they are classes of their own
SPELLINGS = 512                # classes of all other words, by their first letters
CLASSES = 1 + TOP_WORDS + SPELLINGS
HEAD = 200_000                 # words whose counts every task holds; the counts of all others are joined
DIM, STEPS, NOISE, RATE = 40, 150, 8.0, 0.05
PIECE = 1 << 20                # bytes of text that a task looks at once: its arrays take some twenty times as much
PENALTY = 0.7                  # of squared vectors, against the summed log loss
END = 0                        # hash and class of the end of a text, which also stands before its first word


@dataclass
class Head:
    """The most frequent words, by hash: their counts and classes (-1: by spelling)."""
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: whether it is listed, its count (0 if not), its class."""
        at = np.minimum(np.searchsorted(self.hashes, w.hashes), max(0, len(self.hashes) - 1))
        if not len(self.hashes):
            return np.zeros(len(w.hashes), bool), np.zeros(len(w.hashes), np.int64), _spelling(w)
        listed = self.hashes[at] == w.hashes
        own = np.where(listed, self.classes[at], -1)
        return listed, np.where(listed, self.counts[at], 0), np.where(own >= 0, own, _spelling(w))


def _spelling(w: Words) -> np.ndarray:
    """Class of each word by up to four of its first bytes."""
    padded = np.concatenate([w.data, np.zeros(4, np.uint8)])       # stays bytes: only the words' letters are widened
    key = np.zeros(len(w.starts), np.uint64)
    for j in range(4):
        key = (key << np.uint64(8)) | np.where(w.starts + j < w.ends, padded[w.starts + j], np.uint8(0))
    return (1 + TOP_WORDS + (mix(key) % np.uint64(SPELLINGS))).astype(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def word_counts(train: DataFrame) -> DataFrame:
    """Stored: hash, count and spelling class of every word of the texts, and the number of ends under hash END."""
    def count(batches):
        for b in slices(batches, limit=PIECE):
            w = words_of(b.column("text"), LOWER)
            h, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(h.view(np.int64), END)), pa.array(np.append(_spelling(w)[first], END)), pa.array(np.append(n, b.num_rows))],
                names=["h", "class", "n"])

    rows = train.select("text").mapInArrow(count, "h long, class long, n long")
    return stored(rows.groupBy("h").agg(F.first("class").alias("class"), F.sum("n").alias("c")), "words")


def _head(counts: DataFrame) -> Head:
    rows = counts.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(HEAD).select("h", "c").toArrow()
    classes = np.full(rows.num_rows, -1)
    top = min(TOP_WORDS, rows.num_rows)
    classes[:top] = np.arange(1, top + 1)
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Head(h[order], rows["c"].to_numpy()[order], classes[order])


def _sequence(w: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of every token (each text's words and its end), and each text's range of tokens."""
    n = np.diff(w.bounds)
    bounds = w.bounds + np.arange(len(w.bounds))
    now = np.full(bounds[-1], END, np.int64)
    now[np.arange(len(classes)) + np.repeat(np.arange(len(n)), n)] = classes
    before = np.concatenate([[END], now[:-1]])[:len(now)]      # a text's first word follows the end before it
    return before, now, bounds


def pair_counts(train: DataFrame, head: Head) -> np.ndarray:
    """How often each class follows each class, over all texts: a table whose size is fixed by the classes."""
    shared = train.sparkSession.sparkContext.broadcast(head)

    def count(batches):
        for b in slices(batches, limit=PIECE):
            w = words_of(b.column("text"), LOWER)
            before, now, _ = _sequence(w, shared.value.look_up(w)[2])
            pair, n = np.unique(before * CLASSES + now, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    rows = train.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES, np.float32)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def fit(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors, word vectors and biases of the log-bilinear model, by noise-contrastive estimation.

    The score of class w after class c is context[c] . word[w] + bias[w]. Each observed pair is told apart from NOISE
    pairs whose word is drawn from the class frequencies; as the pair counts are at hand, the expectation over the
    noise is taken exactly, by matrix products over all classes, instead of by samples.
    """
    rng = np.random.default_rng(11)
    n = pairs.sum()
    after, of = pairs.sum(1), pairs.sum(0)
    noise = (of + 0.5) / (of + 0.5).sum()
    offset = np.log(NOISE * noise).astype(np.float32)
    p = [rng.normal(0, 0.05, (CLASSES, DIM)).astype(np.float32), rng.normal(0, 0.05, (CLASSES, DIM)).astype(np.float32),
         np.log(noise).astype(np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    # contexts weigh by the square root of their counts, so that rare ones are learned as well
    scale = (1 / np.sqrt(np.maximum(after, 1)))[:, None].astype(np.float32)
    data = pairs * scale
    both = (after[:, None] * scale) * (NOISE * noise)[None, :].astype(np.float32) + data
    total = max(float(data.sum()), 1.0)
    pull = np.float32(PENALTY / total)
    for t in range(1, STEPS + 1):
        # in place, as the arrays are what the driver holds: log odds, share that is data, gradient
        g = p[0] @ p[1].T
        g += p[2] - offset
        np.clip(g, -30, 30, out=g)
        np.exp(np.negative(g, out=g), out=g)
        g += 1
        np.reciprocal(g, out=g)
        g *= both
        g -= data
        g /= np.float32(total)
        grads = [g @ p[1] + pull * p[0], g.T @ p[0] + pull * p[1], g.sum(0)]
        rate = RATE * min(1.0, 2 * (1 - t / (STEPS + 1)))
        for i in range(3):
            m[i] = 0.9 * m[i] + 0.1 * grads[i]
            v[i] = 0.99 * v[i] + 0.01 * grads[i] ** 2
            p[i] -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-12)
    return p[0], p[1], p[2] if n else np.zeros(CLASSES, np.float32)


def log_probabilities(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Normalised log10 probability of every class after every class."""
    out = model[0] @ model[1].T + model[2]
    out -= out.max(1, keepdims=True)
    return ((out - np.log(np.exp(out).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[bounds])


def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: key, id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    Tokens are the words, with A-Z lower-cased, and one end of text. The model learns from the rows where `train_on`
    holds; a null or empty text is an end alone. Repeated rows are scored alike; with nothing to learn from, all words
    are unknown and the classes are equally likely but for their biases. Other columns are left out.

    base_score is the unigram score with add-one smoothing: (count + 1) / (N + V + 1). `score` is that of the class
    after the class before, times the word's share of its class, (count + 1) over that sum in the class, plus one for
    unknown words; so the probabilities of all known words and of one unknown word add up to 1.

    Counts are over all texts. Tasks hold the HEAD most frequent words; the rest of a text's words are joined with the
    stored counts by hash and summed per text.
    """
    kind = dict(docs.dtypes)[id_col]
    train = docs.where(train_on).select(F.col(f"`{text_col}`").alias("text"))
    counts = word_counts(train)
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"] or 0)
    head = _head(counts)
    table = log_probabilities(fit(pair_counts(train, head)))
    # what the words that are no classes of their own add up to, by spelling
    listed = [int(h) for h in head.hashes[head.classes >= 0].view(np.int64)]
    tops = docs.sparkSession.createDataFrame([(h,) for h in [*listed, END]], "h long")
    mass = np.ones(CLASSES)
    for r in counts.join(F.broadcast(tops), "h", "left_anti").groupBy("class").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["class"]] += r["m"]
    shared = docs.sparkSession.sparkContext.broadcast((head, table, np.log10(mass)))
    ends = counts.where(F.col("h") == END).select("c").first()
    c_end = int(ends["c"]) if ends else 0
    below = np.log10(n_all + v_all + 1)

    def run(batches):
        head, table, log_mass = shared.value
        for b in slices(batches, limit=PIECE):
            w = words_of(b.column("text"), LOWER)
            known, c, cls = head.look_up(w)
            before, now, bounds = _sequence(w, cls)
            log_c = np.log10(c + 1.0)
            within = np.where(known & (cls > TOP_WORDS), log_c - log_mass[cls], 0.0)
            lm = _sums(table[before, now], bounds) + _sums(within, w.bounds)
            base = _sums(np.where(known, log_c - below, 0.0), w.bounds) + np.log10(c_end + 1.0) - below
            # the other words: their number per text, and what their classes' sums take away
            rare = np.flatnonzero(~known)
            doc = w.docs()[rare]
            order = np.lexsort((w.hashes[rare], doc))
            d, h, k = doc[order], w.hashes[rare][order], cls[rare][order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(d))).astype(np.int32)
            lm -= np.bincount(d, log_mass[k], minlength=b.num_rows)
            offsets = pa.array(np.searchsorted(d[at], np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("id"), pa.array(np.diff(bounds)), pa.array(_sums(known, w.bounds).astype(np.int64) + (c_end > 0)),
                 pa.array(base), pa.array(lm), pa.ListArray.from_arrays(offsets, pa.array(h[at].view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(n))],
                names=["key", "id", "n_tokens", "n_known", "base", "lm", "rare", "times"])

    slim = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scored = stored(slim.mapInArrow(run, f"key long, id {kind}, n_tokens long, n_known long, base double, lm double, "
                                         "rare array<long>, times array<int>"), "scored")
    # repeated rows share a key: the sums over their words are divided by their number
    words = scored.select("key", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("key", F.col("z.rare").alias("h"), F.col("z.times").alias("t"))
    c = F.coalesce("c", F.lit(0))
    sums = (words.join(counts.select("h", "c"), "h", "left").groupBy("key").agg(
        F.sum(F.col("t") * F.log10(c + 1)).alias("log_c"), F.sum("t").alias("words"), F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("known")))
    same = scored.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    sums = sums.join(same, "key").select("key", *[(F.col(x) / F.col("rows")).alias(x) for x in ("log_c", "words", "known")])
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.drop("rare", "times").join(sums, "key", "left").select(
        "key", "id", "n_tokens", (F.col("n_known") + zero("known")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero("log_c") - F.lit(float(below)) * zero("words")).alias("base_score"), (F.col("lm") + zero("log_c")).alias("score"))


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all documents, learning from those whose crc32(id) mod `modulus` is not `held`; adds held_out."""
    fold = fold_of(id_col, modulus)
    return score(docs, fold != held, id_col, text_col).withColumn("held_out", fold_of("id", modulus) == held)
