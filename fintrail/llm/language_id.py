"""Language of documents: sparse multinomial regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from fintrail.llm.common import fold_of, slices
from fintrail.llm.ngrams import Chars, char_grams, chars_of, sums

BITS = 15                      # 2**BITS feature buckets, fewer bits for very many languages:
CELLS = 1 << 23                # buckets x languages stay within this
ORDERS = (1, 2, 3)             # characters of an n-gram
ROWS_PER_LANG = 1500           # bounds of the labelled sample that the regression is fitted on: documents of a language,
TRAIN_ROWS = 24_000            # and of all of them, shared out evenly (but LEAST_ROWS of a language at least)
LEAST_ROWS = 10
HASHES = 1 << 30
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.01
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray        # buckets x languages, inverse document frequency included
    bias: np.ndarray
    temperature: float
    bits: int = BITS


def _frequencies(c: Chars, bits: int):
    """Of each text: different buckets and their relative frequencies."""
    grams = [char_grams(c, k, bits) for k in ORDERS]
    for s, e in zip(c.starts, c.ends):
        idx, n = np.unique(np.concatenate([g[s:e] for g in grams]), return_counts=True)
        yield idx.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many of the documents (column text) each bucket occurs, and their number; all whole texts count."""
    size = 1 << bits

    def count(batches):
        df, n = np.zeros(size, np.int64), 0
        for b in slices(batches, limit=PIECE):
            c = chars_of(b.column("text"))
            grams = [char_grams(c, k, bits) for k in ORDERS]
            for s, e in zip(c.starts, c.ends):
                seen = np.zeros(size, bool)
                for g in grams:
                    seen[g[s:e]] = True
                df += seen
            n += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["bucket", "n"])

    rows = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(size), 0
    for b, n in zip(rows["bucket"], rows["n"]):
        if b < 0:
            total = int(n)
        else:
            df[b] = n
    return df, total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _ftrl(rows: list, labels: np.ndarray, n_langs: int, size: int) -> np.ndarray:
    """Weights (buckets and one bias row x languages) by follow-the-regularised-leader with elastic net, row by row."""
    z, n = np.zeros((size + 1, n_langs)), np.zeros((size + 1, n_langs))

    def solved(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            idx, x = rows[r]
            i, v = np.append(idx, size), np.append(x, 1.0)
            w = solved(i)
            p = _softmax(v @ w)
            p[labels[r]] -= 1
            g = v[:, None] * p
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return solved(np.arange(size + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the weights were not fitted on.

    A slight pull towards 1 keeps it in range where all of these rows are right.
    """
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() + 0.002 * np.log(t) ** 2 for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_lang: int = ROWS_PER_LANG) -> LanguageModel:
    """Fits a model on documents with text and language.

    Every language is learned. Document frequencies are counted over all labelled documents; the regression sees at most
    `rows_per_lang` documents of each language, and fewer if there are so many languages that they would pass TRAIN_ROWS,
    chosen by a hash of id and text, of which every fifth only sets the temperature. The hash is cut at a bound for
    each language first, so that no task ranks more than about twice the documents that are wanted. Without any labelled document the model knows no language.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")) \
        .where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}      # the classes of the model
    bits = min(BITS, max(8, (CELLS // max(1, len(counts))).bit_length() - 1))
    wanted = min(rows_per_lang, max(LEAST_ROWS, TRAIN_ROWS // max(1, len(counts))))
    df, total = document_frequencies(known.select("text"), bits)
    bounds = [(g, min(HASHES, int(HASHES * (2 * wanted + 50) / n) + 1)) for g, n in counts.items()]
    bound = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    h = F.xxhash64("id", "text")
    low = F.pmod(F.col("h"), F.lit(HASHES))
    order = W.partitionBy("lang").orderBy(low, "h")
    chosen = (known.select("lang", h.alias("h")).join(F.broadcast(bound), "lang").where(low < F.col("bound")).select("h", "lang").distinct()
              .withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted).select("h", "lang"))

    def rows(batches):
        for b in slices(batches, limit=PIECE):
            idx, val = [], []
            for i, v in _frequencies(chars_of(b.column("text")), bits):
                idx.append(i.tobytes())
                val.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                                             names=["h", "lang", "idx", "val"])

    picked = known.select("text", "lang", F.xxhash64("id", "text").alias("h")).join(F.broadcast(chosen), ["h", "lang"], "left_semi")
    got = (picked.dropDuplicates(["h", "lang"]).select("h", "lang", "text")
           .mapInArrow(rows, "h long, lang string, idx binary, val binary").toPandas().sort_values(["h", "lang"]))
    langs = sorted(set(got["lang"]))
    size = 1 << bits
    if not langs:
        return LanguageModel([], np.zeros((size, 0)), np.zeros(0), 1.0, bits)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    place = {g: i for i, g in enumerate(langs)}
    labels = np.array([place[x] for x in got["lang"]])
    feats = []
    for i, v in zip(got["idx"], got["val"]):
        idx = np.frombuffer(i, np.int32)
        # relative frequencies of texts are small numbers: as a share in tenths of a percent they suit the step sizes
        feats.append((idx, np.frombuffer(v, np.float32) * idf[idx] * 10))
    held = np.arange(len(feats)) % 5 == 4
    w = _ftrl([f for f, h in zip(feats, held) if not h], labels[~held], len(langs), size)
    logits = np.array([v @ w[i] + w[size] for (i, v), h in zip(feats, held) if h]).reshape(-1, len(langs))
    return LanguageModel(langs, (w[:size] * idf[:, None] * 10).astype(np.float32), w[size], _temperature(logits, labels[held]), bits)


def _weighed(weights: np.ndarray, grams: np.ndarray, c: Chars) -> np.ndarray:
    """Sums of the grams' weights for each text, over parts that hold a bounded number of weights at once."""
    step = max(1, CELLS // weights.shape[1])
    if len(grams) <= step:
        return sums(weights[grams], c.starts, c.ends)
    out = np.zeros((len(c.starts), weights.shape[1]))
    for lo in range(0, len(grams), step):
        hi = min(len(grams), lo + step)
        some = np.flatnonzero((c.starts < hi) & (c.ends > lo))
        if len(some):
            out[some] += sums(weights[grams[lo:hi]], np.clip(c.starts[some], lo, hi) - lo, np.clip(c.ends[some], lo, hi) - lo)
    return out


def predict(docs: DataFrame, model: LanguageModel, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns `carry` of each row, with lang_pred and score (calibrated probability of lang_pred)."""
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for b in slices(batches, "_text", PIECE):
            text = b.column("_text")
            c = chars_of(text)
            n = np.maximum(1, len(ORDERS) * (c.ends - c.starts))
            has = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, prob = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if m.langs:
                z = sum(_weighed(m.weights, char_grams(c, k, m.bits), c) for k in ORDERS) / n[:, None] + m.bias
                p = _softmax(z.astype(np.float64) / m.temperature)
                pred = np.where(has, np.array(m.langs, object)[p.argmax(1)], UNKNOWN)
                prob = np.where(has, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(pred, pa.string()), pa.array(prob)],
                                             names=[*carry, "lang_pred", "score"])

    # the text comes first, under a name of its own if it is also carried
    slim = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in carry])
    return slim.mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the id mod `modulus` is 0), lang_pred and score (0 to 1).

    The model learns from the documents that are not held out. Null texts and texts without a letter are `und` with
    score 0, as is everything if nothing is labelled. Very long texts are taken whole; their weights are added up in parts.
    Of equal probabilities the language that comes first wins. Repeated rows are predicted alike; an empty table gives no
    rows; other columns are left out, so none can clash.
    """
    model = train(docs.where(fold_of(id_col, modulus) != 0), id_col, text_col, lang_col)
    return predict(docs, model, [id_col], text_col).select(
        F.col(f"`{id_col}`").alias("doc_id"), (fold_of(id_col, modulus) == 0).alias("held_out"), "lang_pred", "score")
