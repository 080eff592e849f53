"""Exact nearest neighbours as blocks of queries that base rows stream past.

Every base row belongs to the cell of its nearest pivot. A query's k-th distance
is bounded by its distances to a few representatives per cell; the triangle
inequality then rules out whole cells, which a query notes as bits. A task holds
one split of the queries and reads one split of the base rows in order of their
ids: a query is sent once per split of the base rows, however many cells it looks
into, and a task hands on only each query's k best - never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from fintrail.functions.numeric import norm
from fintrail.session import written

MAX_PIVOTS = 256
ROWS_PER_PIVOT = 4_096
HELD = 1 << 22                 # coordinates of the queries that a task holds
READ = 1 << 21                 # coordinates of the base rows that it looks at together
TASK_PAIRS = 1 << 35           # pairs of a task at most
LEAST_PAIRS = 1 << 26          # fewer are not worth a further task
WAVES = 3                      # tasks of a core at most, if TASK_PAIRS needs no more
FRESH = 5                      # a query's start in a task costs as much as this many rows read
TILE = 2_048                   # base rows of one product
RUN = 256                      # of which so many have one greatest value
PAIRS = 1 << 20                # distances that a task holds at once
QUERY_STEP = 8_192             # queries whose rows are handed on together
WIDE = 0.7                     # queries that look into this share of the cells are compared with all of them
SLACK = 1e-7
SOUND = "n >= 1e-9 AND n < double('Infinity')"    # NaN is not below either; as a pivot it would hide its whole cell

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclidean_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(sq, 0.0))


def _matrix(col: pa.ListArray) -> np.ndarray:
    wide = pc.unique(pc.fill_null(pc.list_value_length(col), -1)).to_pylist()
    if len(wide) != 1 or wide[0] < 0:
        raise ValueError("vectors must have the same length")
    return col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(col), wide[0])


def _pieces(batches: Iterator[pa.RecordBatch], others: int) -> Iterator[pa.RecordBatch]:
    """Rows in pieces whose distances to `others` rows stay within PAIRS."""
    step = max(1, PAIRS // max(1, others))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _splits(queries: int, base: int, dims: int, cores: int) -> tuple[int, int]:
    """Numbers of splits of the queries and of the base rows: tasks stay bounded, and few rows are sent."""
    pairs = queries * base
    least = max(1, -(-queries * dims // HELD))
    waves = min(WAVES, max(1, pairs // (4 * LEAST_PAIRS * cores)))
    tasks = max(1, min(waves * cores, -(-pairs // LEAST_PAIRS)), -(-pairs // TASK_PAIRS))
    shapes = [(n, max(1, -(-tasks // n))) for n in range(least, max(least, tasks) + 1)]
    return min(shapes, key=lambda x: (-(-x[0] * x[1] // cores), FRESH * queries * x[1] + base * x[0]))


def _few_copies(x: np.ndarray, ids: pa.Array, k: int, exclude_self: bool) -> np.ndarray:
    """Rows, sorted by id, that can be among any query's k best: of equal vectors the first ones."""
    as_bytes = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    same = np.unique(as_bytes, return_inverse=True)[1]
    at = np.argsort(same, kind="stable")

    def nth(first: np.ndarray) -> np.ndarray:
        place = np.arange(len(first))
        return place - np.maximum.accumulate(np.where(first, place, 0))

    if exclude_self:                                           # all copies with one id may fall away: k for each id, 2 k in all
        code = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        s, c = same[at], code[at]
        at = at[nth(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]) < k]
    s = same[at]
    return np.sort(at[nth(np.r_[True, s[1:] != s[:-1]]) < (2 * k if exclude_self else k)])


class _Block:
    """The queries of a task, and the k nearest of the base rows read so far, known by their places in reading order."""

    def __init__(self, rows: pa.Table, k: int, share: float, cells: int, metric: Metric, exclude_self: bool):
        rows = rows.combine_chunks().to_batches()[0]
        self.ids, self.x = rows["q"], _matrix(rows["x"])
        self.most = rows["bound"].to_numpy().copy()            # no further row may be farther away
        self.bits = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.uint8).reshape(len(self.x), -1)
        looks = sum(int(np.unpackbits(self.bits[:, i]).sum()) for i in range(self.bits.shape[1]))
        self.wide = looks >= share * cells * len(self.x)
        self.k, self.metric, self.exclude_self = k, metric, exclude_self
        self.d = np.full((len(self.x), k), np.inf)
        self.at = np.full((len(self.x), k), -1, np.int64)
        self.read: list[pa.Array] = []
        self.sound = np.arange(len(self.x))
        if metric is euclidean_matrix:
            self.sound = np.flatnonzero(np.isfinite(self.x).all(1))
            self.mid = self.x[self.sound[:TILE]].mean(0) if len(self.sound) else np.zeros(self.x.shape[1])
            self.room = np.empty(max(PAIRS, TILE), np.float32)
            self.square = np.concatenate([((self.x[i:i + TILE] - self.mid) ** 2).sum(1) for i in range(0, len(self.x), TILE)])

    def add(self, rows: pa.Table) -> None:
        """Compares further base rows, in order of their ids."""
        rows = rows.combine_chunks().to_batches()[0]
        ids, x, cell, before = rows["b"], _matrix(rows["x"]), rows["cell"].to_numpy(), sum(map(len, self.read))
        self.read.append(ids)
        use = _few_copies(x, ids, self.k, self.exclude_self)
        if self.metric is euclidean_matrix:
            use = use[np.isfinite(x[use]).all(1)]
        if self.wide:
            groups = [(self.sound, use)]
        else:
            groups = [(self.sound[(self.bits[self.sound, c >> 3] >> (7 - c & 7)) & 1 > 0], use[cell[use] == c]) for c in np.unique(cell[use])]
        for q, b in groups:
            for i in range(0, len(b), TILE):
                tile = b[i:i + TILE]
                pairs = self._pairs(x[tile])
                step = max(1, min(PAIRS // (-(-len(tile) // RUN) * RUN), READ // x.shape[1]))
                for j in range(0, len(q), step):
                    self._keep(*pairs(q[j:j + step]), tile, ids, before)

    def _pairs(self, x: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What finds the pairs of some queries and the rows x that are not too far apart: query, place in x, distance."""
        if self.metric is not euclidean_matrix:
            def compared(q):
                m = self.metric(self.x[q], x)
                i, j = np.nonzero(m <= self.most[q, None])
                return q[i], j, m[i, j]
            return compared
        wide, n = x.shape[1], -(-len(x) // RUN) * RUN
        right = np.zeros((wide + 1, n), np.float32)
        right[-1] = -np.inf                                                      # fills up the last run
        with np.errstate(all="ignore"):
            mid = x - self.mid
            half = (mid ** 2).sum(1) / 2
            right[:-1, :len(x)], right[-1, :len(x)] = mid.T, -half
            reach = np.sqrt(2 * half.max())

        def screened(q):
            """Single precision finds the pairs to be measured: q b - b b / 2 with an error that is allowed for."""
            with np.errstate(all="ignore"):
                left = np.ones((len(q), wide + 1), np.float32)
                left[:, :-1] = self.x[q] - self.mid
                near = np.matmul(left, right, out=self.room[:len(q) * n].reshape(len(q), n)).reshape(-1, RUN)
                error = (wide + 8) * 2.0 ** -23 * (np.sqrt(self.square[q]) * reach + reach * reach / 2) + 2.0 ** -100
                least = np.nextafter(((self.square[q] - self.most[q] ** 2) / 2 - error).astype(np.float32), np.float32(-np.inf))
                least = np.repeat(least, n // RUN)
                runs = np.flatnonzero(~(near.max(1) < least))
                r, j = np.nonzero(~(near[runs] < least[runs, None]))      # what overflowed is measured too
            i, j = runs[r] // (n // RUN), runs[r] % (n // RUN) * RUN + j
            i, j = q[i[j < len(x)]], j[j < len(x)]
            step = max(1, PAIRS // wide)
            d = np.empty(len(i))
            for at in range(0, len(i), step):
                gap = self.x[i[at:at + step]] - x[j[at:at + step]]
                d[at:at + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            return i, j, d
        return screened

    def _keep(self, q: np.ndarray, j: np.ndarray, d: np.ndarray, tile: np.ndarray, ids: pa.Array, before: int) -> None:
        ok = np.isfinite(d) & (d <= self.most[q])
        q, at, d = q[ok], tile[j[ok]], d[ok]
        if self.exclude_self and len(q):
            ok = ~pc.fill_null(pc.equal(self.ids.take(pa.array(q)), ids.take(pa.array(at))), False).to_numpy(zero_copy_only=False)
            q, at, d = q[ok], at[ok], d[ok]
        if not len(q):
            return
        rows, of = np.unique(q, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), of])
        d = np.concatenate([self.d[rows].ravel(), d])
        at = np.concatenate([self.at[rows].ravel(), before + at])
        order = np.lexsort((at, d, of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], np.arange(len(rows)))[of[order]]
        best = order[rank < self.k]
        self.d[rows], self.at[rows] = d[best].reshape(-1, self.k), at[best].reshape(-1, self.k)
        self.most[rows] = np.minimum(self.most[rows], self.d[rows, -1])

    def found(self) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.read)
        for i in range(0, len(self.x), QUERY_STEP):
            q, n = np.nonzero(self.at[i:i + QUERY_STEP] >= 0)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(i + q)), ids.take(pa.array(self.at[i + q, n])),
                                              pa.array(self.d[i + q, n])], names=["q", "b", "distance"])


def _pivot_rows(base: DataFrame, pivots: int):
    """At most `pivots` rows, the same in every call."""
    return base.select("v").orderBy(F.xxhash64("b"), "b").limit(pivots).collect()


def knn_join(queries: DataFrame, base: DataFrame, k: int, *, metric: Metric = euclidean_matrix,
             exclude_self: bool = False, pivots: int | None = None, probes: int | None = None) -> DataFrame:
    """The k base rows nearest to each query: q, b, distance, rn.

    queries(q, v, x) and base(b, v, x): `metric` compares the full vectors x and
    may exceed the Euclidean distance of the v vectors but never fall below it.
    With `probes` a query looks into that many nearest cells only (more where they
    hold fewer than k rows), so its work is bounded and its rows are approximate.
    """
    queries, base = (df.select(key, *[F.col(n).cast("array<double>").alias(n) for n in ("v", "x")]) for df, key in ((queries, "q"), (base, "b")))
    if pivots is None:
        pivots = max(1, min(MAX_PIVOTS, base.count() // ROWS_PER_PIVOT))
    rows = _pivot_rows(base, pivots)
    kinds_q, kinds_b = dict(queries.dtypes)["q"], dict(base.dtypes)["b"]
    out = f"q {kinds_q}, b {kinds_b}, distance double"
    if not rows:
        empty = base.sparkSession.createDataFrame([], out)
        return empty.withColumn("rn", F.lit(1))
    piv = np.array([r["v"] for r in rows], dtype=float)
    slack = SLACK * (1.0 + float(np.abs(piv).max()))       # rounding of the expanded squares grows with the values

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, len(piv)):
            d = euclidean_matrix(_matrix(rows["v"]), piv)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([rows["b"], rows["x"], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                             names=["b", "x", "cell", "b_d"])

    cells = base.select("b", "v", "x").mapInArrow(place, f"b {kinds_b}, x array<double>, cell int, b_d double")
    need = k + (1 if exclude_self else 0)
    near = W.partitionBy("cell").orderBy("b_d", "b")
    seeds = (cells.withColumn("rk", F.row_number().over(near)).where(F.col("rk") <= need)
             .select("b", "x").collect())                                        # at most pivots * need rows
    stat = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("b_d").alias("r")).collect()   # <= pivots rows
    radius = np.full(len(piv), -np.inf)
    size = np.zeros(len(piv), dtype=np.int64)
    for s in stat:
        size[s["cell"]] = s["n"]
        radius[s["cell"]] = s["r"]
    seed_x = np.array([s["x"] for s in seeds], dtype=float)
    seed_id = np.array([s["b"] for s in seeds])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, max(len(piv), len(seed_x))):
            q_ids = rows["q"].to_numpy(zero_copy_only=False)
            d = euclidean_matrix(_matrix(rows["v"]), piv)
            if probes is not None:
                order = np.argsort(np.where(size[None, :] > 0, d, np.inf), axis=1, kind="stable")
                held = size[order]
                take = ((np.arange(len(piv))[None, :] < probes) | (held.cumsum(1) - held < need)) & (held > 0)
                hits, bound = np.zeros(d.shape, bool), np.full(len(d), np.inf)
                np.put_along_axis(hits, order, take, axis=1)
            else:
                m = metric(_matrix(rows["x"]), seed_x)
                if exclude_self:
                    m = np.where(q_ids[:, None] == seed_id[None, :], np.inf, m)
                m = np.where(np.isfinite(m), m, np.inf)
                bound = np.partition(m, k - 1, axis=1)[:, k - 1] if m.shape[1] >= k else np.full(len(m), np.inf)
                hits = (d - radius[None, :] <= bound[:, None] + slack) & np.isfinite(radius)[None, :]
            bits = np.packbits(hits, axis=1)
            out = pa.RecordBatch.from_arrays([rows["q"], rows["x"], pa.array(bound + 100 * slack), pa.array([x.tobytes() for x in bits], pa.binary())],
                                             names=["q", "x", "bound", "cells"])
            yield out.filter(pa.array(hits.any(1)))

    spark = base.sparkSession
    n_q, n_b = _splits(queries.count(), int(size.sum()), seed_x.shape[1], spark.sparkContext.defaultParallelism)
    number = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (queries.select("q", "v", "x").mapInArrow(route, f"q {kinds_q}, x array<double>, bound double, cells binary")
            .select("*", number(n_q, "q", "x").alias("qs"), every(n_b).alias("bs"), F.lit(0).alias("kind")))
    right = cells.select("b", "x", "cell", every(n_q).alias("qs"), number(n_b, "b").alias("bs"), F.lit(1).alias("kind"))
    used, share = int((size > 0).sum()), WIDE if probes is None else 1.0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wait, block = [], [], None
        for batch in batches:
            n = int(np.searchsorted(batch["kind"].to_numpy(), 1))                # queries come first
            if n:
                held.append(batch.slice(0, n))
            if n == batch.num_rows or not held:
                continue
            if block is None:
                block = _Block(pa.Table.from_batches(held), k, share, used, metric, exclude_self)
            wait.append(batch.slice(n))
            if sum(x.num_rows for x in wait) * seed_x.shape[1] >= READ:
                block.add(pa.Table.from_batches(wait))
                wait = []
        if wait:
            block.add(pa.Table.from_batches(wait))
        if block is not None:
            yield from block.found()

    best = (left.unionByName(right, allowMissingColumns=True).repartitionById(n_q * n_b, F.col("qs") * n_b + F.col("bs"))
            .sortWithinPartitions("kind", "b").select("kind", "q", "b", "x", "bound", "cells", "cell").mapInArrow(compare, out))
    w = W.partitionBy("q").orderBy("distance", "b")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def _unit(df: DataFrame, key: str) -> DataFrame:
    """Stored, as the join reads these rows many times, by tasks of their own, as a file of vectors is one split."""
    n = norm(F.col("v"))
    v = F.transform("v", lambda x: x.cast("double") / F.when(F.col("n") < 1e-9, F.lit(1.0)).otherwise(F.col("n")))
    dealt = df.repartition(F.xxhash64(key, "v"))
    return written(dealt.select(key, "v", n.alias("n")).select(key, "n", v.alias("v")), "units").withColumn("x", F.col("v"))


def nearest(queries: DataFrame, base: DataFrame, k: int = 5, exclude_self: bool = False, pivots: int | None = None,
            probes: int | None = None) -> DataFrame:
    """Top-k by cosine similarity: q, b, similarity, rn. Zero vectors are similar to nothing (0.0).

    On unit vectors cosine order is distance order. Zero vectors tie at 0.0 with
    everything, so the few of smallest id stand for all of them. `probes` as in `knn_join`.
    """
    b, q = _unit(base, "b"), _unit(queries, "q")
    live = knn_join(q.where(SOUND), b.where(SOUND), k, exclude_self=exclude_self, pivots=pivots, probes=probes)
    found = live.select("q", "b", (1.0 - F.col("distance") * F.col("distance") / 2.0).alias("similarity"))
    need = k + (1 if exclude_self else 0)
    ties = b.where("n < 1e-9").orderBy("b").limit(need).select("b")
    blank = b.orderBy("b").limit(need).select("b")
    pad = (q.where("n >= 1e-9").select("q").crossJoin(F.broadcast(ties))      # at most k + 1 rows broadcast
           .unionByName(q.where("n < 1e-9").select("q").crossJoin(F.broadcast(blank))))
    if exclude_self:
        pad = pad.where(F.col("q") != F.col("b"))
    both = found.unionByName(pad.withColumn("similarity", F.lit(0.0)))
    w = W.partitionBy("q").orderBy(F.desc(F.round("similarity", 12)), "b")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def fit_probes(queries: DataFrame, base: DataFrame, k: int, recall: float, *, exclude_self: bool = False, pivots: int,
               sample: int = 256) -> int:
    """Fewest cells to look into so that `recall` of the true neighbours of at most `sample` queries is found.

    The sample is the one bound: its queries run exactly against all base rows, and the
    rank of each true neighbour's cell says how many cells would have found it.
    """
    b, q = _unit(base, "b").where(SOUND), _unit(queries, "q").where(SOUND)
    few = q.orderBy(F.xxhash64("q"), "q").limit(sample)
    true = knn_join(few, b, k, exclude_self=exclude_self, pivots=pivots).select("q", "b")
    pairs = true.join(few.select("q", F.col("v").alias("qv")), "q")
    rows = b.select("b", "v").join(F.broadcast(pairs), "b").select("qv", "v").collect()      # at most sample * k rows
    if not rows:
        return 1
    piv = np.array([r["v"] for r in _pivot_rows(b, pivots)], dtype=float)
    d = euclidean_matrix(np.array([r["qv"] for r in rows], dtype=float), piv)
    cell = euclidean_matrix(np.array([r["v"] for r in rows], dtype=float), piv).argmin(1)
    own = d[np.arange(len(d)), cell][:, None]
    rank = (d < own).sum(1) + ((d == own) & (np.arange(len(piv))[None, :] < cell[:, None])).sum(1)
    return int(np.sort(rank)[int(np.ceil(recall * len(rank))) - 1]) + 1


def nearest_probed(queries: DataFrame, base: DataFrame, k: int = 5, recall: float = 0.95, exclude_self: bool = False,
                   pivots: int | None = None, sample: int = 256) -> DataFrame:
    """Approximate form of `nearest`, with the same columns: every base row lies in a cell, a query looks into the
    nearest few. How many is fitted for the wanted recall by `fit_probes`; vectors without any structure need most cells.
    """
    if pivots is None:
        pivots = max(1, min(MAX_PIVOTS, int(np.sqrt(base.count()))))
    probes = fit_probes(queries, base, k, recall, exclude_self=exclude_self, pivots=pivots, sample=sample)
    return nearest(queries, base, k, exclude_self, pivots, probes)
