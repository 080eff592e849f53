"""Benchmark passages in documents by a distributed positional inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from fintrail.llm.common import byte_map, row_key, slices, stored, words_of

WINDOW = 10                    # words of a passage
SENT_STARTS = 100_000          # passages that are sent to every task (10 MB); more are joined by a shuffle
FILTER_TERMS = 1_000_000       # the index keeps benchmark terms alone only up to this checked count of them (16 MB)

INDEX = "key long, id {id}, n_words long, terms array<long>, positions array<int>"
# a word is a run of 0-9, a-z and everything beyond ASCII, after A-Z is lower-cased
WORD_BYTES = byte_map({c: c + 32 for c in range(65, 91)}
                      | {c: 32 for r in (range(0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)) for c in r})


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                terms: tuple[np.ndarray, np.ndarray] | None = None, within: int | None = None) -> DataFrame:
    """The stored index: for each document its key, id, word count, and the terms (word hashes) with their positions.

    With `terms` (sorted hashes, and for each the length of the shortest passage it is part of) only postings are kept
    that some passage can use: the word lies in a run of listed words at least as long as that passage. With `within`
    the words may lie apart: the lengths are the least numbers of different terms in a passage, and so many listed
    words must lie at most `within` words before or after, the word itself included. Whole texts are read; null and
    empty texts have no words. Other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def index(batches):
        for b in slices(batches):
            w = words_of(b.column("text"), WORD_BYTES)
            sel = np.arange(len(w.hashes))
            if terms is not None and len(terms[0]):
                at = np.minimum(np.searchsorted(terms[0], w.hashes), len(terms[0]) - 1)
                listed = terms[0][at] == w.hashes
                sel = np.flatnonzero(listed)
                if within is not None:
                    doc = w.docs()[sel]
                    total = np.append(0, np.cumsum(listed))
                    near = (total[np.minimum(sel + within + 1, w.bounds[doc + 1])]
                            - total[np.maximum(sel - within, w.bounds[doc])])
                    sel = sel[near >= terms[1][at[sel]]]
                else:
                    begins = listed.copy()
                    begins[1:] &= ~listed[:-1]
                    inner = w.bounds[(w.bounds > 0) & (w.bounds < len(listed))]
                    begins[inner] = listed[inner]
                    run = np.cumsum(begins) - 1
                    length = np.bincount(run[listed], minlength=1)
                    sel = sel[length[run[sel]] >= terms[1][at[sel]]]
            elif terms is not None:
                sel = sel[:0]
            cut = np.searchsorted(sel, w.bounds)
            n = np.diff(w.bounds)
            pos = (sel - np.repeat(w.bounds[:-1], np.diff(cut))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("id"), pa.array(n), _lists(w.hashes[sel].view(np.int64), cut), _lists(pos, cut)],
                names=["key", "id", "n_words", "terms", "positions"])

    return stored(slim.mapInArrow(index, INDEX.format(id=kind)), "index")


def postings(index: DataFrame) -> DataFrame:
    """(key, term, pos), one row per kept word of each document."""
    zipped = F.arrays_zip("terms", "positions")
    return (index.select("key", F.explode(zipped).alias("z"))
            .select("key", F.col("z.terms").alias("term"), F.col("z.positions").alias("pos")))


def benchmark_terms(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Different word sequences of the items as (seq, n, q, term), and the ids (as text) of the items that have each."""
    items = build_index(benchmark, id_col, text_col)
    items = items.where("n_words > 0").withColumn("seq", F.xxhash64("terms"))
    ids = items.select("seq", F.col("id").cast("string").alias("item")).distinct()
    seqs = items.groupBy("seq").agg(F.first("n_words").alias("n"), F.first("terms").alias("terms"))
    return seqs.select("seq", "n", F.posexplode("terms").alias("q", "term")), ids


def _collect_terms(needs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The terms of needs(term, need) with the least need of each; None if there are too many to be sent out."""
    need = needs.groupBy("term").agg(F.min("need").alias("least"))
    if need.limit(FILTER_TERMS + 1).count() > FILTER_TERMS:
        return None
    got = need.toPandas()
    h = got["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["least"].to_numpy(np.int64)[order]


def phrase_hits(index: DataFrame, seq_terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of documents inside an occurrence of a passage: (key, seq, pos).

    A passage is `window` consecutive words of a sequence, or all of a shorter one. Each passage is looked up by its
    rarest term in the index: its postings, less the term's offset, are the places where the sequence may lie. The
    lists of the passage's other terms are intersected with these places by exact offset, and a run of `window`
    consecutive agreeing words is an occurrence. Passages of one sequence share their places and their words.
    """
    post = postings(index)
    count = post.groupBy("term").agg(F.count(F.lit(1)).alias("n_post"))
    ranked = stored(seq_terms.join(count, "term", "left").withColumn("n_post", F.coalesce("n_post", F.lit(0))), "ranked")
    span = F.least("n", F.lit(window))
    ahead = W.partitionBy("seq").orderBy("q").rowsBetween(0, window - 1)
    rarest = F.min(F.struct("n_post", "q", "term")).over(ahead)
    anchors = (ranked.withColumn("a", rarest).where((F.col("q") + span <= F.col("n")) & (F.col("a.n_post") > 0))
               .select("seq", F.col("a.term").alias("term"), F.col("a.q").alias("aq")).distinct())
    places = (post.join(anchors, "term").select("key", "seq", (F.col("pos") - F.col("aq")).alias("shift"), "aq")
              .select("key", "seq", "shift", F.explode(F.sequence(F.col("aq") - (window - 1), F.col("aq") + (window - 1))).alias("q"))
              .where("q >= 0").distinct())
    wanted = places.join(ranked.select("seq", "n", "q", "term"), ["seq", "q"]).withColumn("pos", F.col("q") + F.col("shift"))
    # repeated rows share a key: their equal postings count once
    agree = wanted.join(post, ["key", "term", "pos"]).select("key", "seq", "n", "shift", "q", "pos").distinct()
    line = W.partitionBy("key", "seq", "shift").orderBy("q")
    runs = agree.withColumn("run", F.col("q") - F.row_number().over(line))
    sized = runs.withColumn("length", F.count(F.lit(1)).over(W.partitionBy("key", "seq", "shift", "run")))
    return sized.where(F.col("length") >= span).select("key", "seq", "pos")


def _passages(seq_terms: DataFrame, window: int) -> DataFrame:
    """Each passage as its different terms, once a sequence: (seq, want)."""
    ahead = W.partitionBy("seq").orderBy("q").rowsBetween(0, window - 1)
    return (seq_terms.withColumn("want", F.array_sort(F.array_distinct(F.collect_list("term").over(ahead))))
            .where(F.col("q") + F.least("n", F.lit(window)) <= F.col("n")).select("seq", "want").distinct())


def proximity_hits(index: DataFrame, seq_terms: DataFrame, within: int = WINDOW) -> DataFrame:
    """Documents with all terms of a passage at most `within` words apart, in any order: (key, seq).

    A passage is `within` consecutive words of a sequence, or all of a shorter one; each of its different terms must
    occur once, so every exact copy of a passage is found. Needs an index built without a term list or with one for
    `within`. A passage starts from its rarest term in the index; the postings around each place of it are cut from
    the document's own row of the index, so no posting is shuffled.
    """
    count = postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("n_post"))
    terms = _passages(seq_terms, within).select("seq", "want", F.explode("want").alias("term")).join(count, "term", "left")
    least = F.min(F.struct(F.coalesce("n_post", F.lit(0)).alias("n_post"), "term"))
    starts = stored(terms.groupBy("seq", "want").agg(least.alias("a")).where("a.n_post > 0")
                    .select("seq", "want", F.col("a.term").alias("start")), "starts")
    shared = index.sparkSession.sparkContext.broadcast(_collect_terms(starts.select(F.col("start").alias("term"), F.size("want").alias("need"))))

    def around(batches):
        first = shared.value
        for b in batches:
            for k in range(b.num_rows):                        # one document at a time, and of it so many places
                row = b.slice(k, 1)
                t, pos = row.column("terms").flatten().to_numpy(), row.column("positions").flatten().to_numpy()
                places = np.arange(len(t))
                if first is not None:
                    at = np.minimum(np.searchsorted(first[0], t.view(np.uint64)), max(0, len(first[0]) - 1))
                    places = np.flatnonzero(first[0][at] == t.view(np.uint64)) if len(first[0]) else places[:0]
                for cut in range(0, len(places), 10_000):
                    p = places[cut:cut + 10_000]
                    lo, hi = np.searchsorted(pos, pos[p] - within), np.searchsorted(pos, pos[p] + within, side="right")
                    bounds = np.append(0, np.cumsum(hi - lo))
                    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - lo, hi - lo)
                    near = pa.StructArray.from_arrays([pa.array(pos[at]), pa.array(t[at])], names=["pos", "term"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(row.column("key")[0], len(p)), pa.array(t[p]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), near)],
                        names=["key", "start", "near"])

    places = index.select("key", "terms", "positions").mapInArrow(around, "key long, start long, near array<struct<pos: int, term: long>>")
    small = starts.limit(SENT_STARTS + 1).count() <= SENT_STARTS
    found = places.join(F.broadcast(starts) if small else starts, "start")
    held = lambda near, want: F.size(F.array_except(want, near)) == 0
    found = found.where(held(F.col("near.term"), F.col("want")))
    # the first word of the span that holds them all is one of the postings around
    spans = lambda x: held(F.transform(F.filter("near", lambda y: y["pos"].between(x["pos"], x["pos"] + within)),
                                       lambda y: y["term"]), F.col("want"))
    return found.where(F.exists("near", spans)).select("key", "seq").distinct()


def proximity(docs: DataFrame, benchmark: DataFrame, within: int = WINDOW, id_col: str = "doc_id",
              text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, doc_id, n_words, n_near_items, near_items_sha256, near: the items that proximity_hits finds.

    Rows, nulls and repeats are as in `contamination`, whose items are all among these.
    """
    seq_terms, ids = benchmark_terms(benchmark, item_col, item_text)
    seq_terms = stored(seq_terms, "terms")
    needs = _passages(seq_terms, within).select(F.explode("want").alias("term"), F.size("want").alias("need"))
    index = build_index(docs, id_col, text_col, _collect_terms(needs), within)
    hits = stored(proximity_hits(index, seq_terms, within), "near")
    items = (hits.join(ids, "seq").select("key", "item").distinct()
             .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")))       # a list leaves out nulls
    out = index.select("key", F.col("id").alias("doc_id"), "n_words").join(items, "key", "left")
    return out.select(
        "key", "doc_id", "n_words", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_near_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("near_items_sha256"),
        F.col("items").isNotNull().alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Repeated documents have equal rows; null, empty and wordless texts have no hits; a null item id counts as no item
    in n_items but its passages are hits; equal items count each. An empty benchmark leaves every document clean.
    """
    seq_terms, ids = benchmark_terms(benchmark, item_col, item_text)
    seq_terms = stored(seq_terms, "terms")
    index = build_index(docs, id_col, text_col, _collect_terms(seq_terms.select("term", F.least("n", F.lit(window)).alias("need"))))
    hits = stored(phrase_hits(index, seq_terms, window), "hits")
    words = hits.select("key", "pos").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = (hits.select("key", "seq").distinct().join(ids, "seq").where("item is not null")
             .select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")))
    out = index.select("key", F.col("id").alias("doc_id"), "n_words").join(words.join(items, "key", "left"), "key", "left")
    return out.select(
        "key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
