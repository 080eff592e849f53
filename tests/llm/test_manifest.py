"""Token counts, whitening and the Merkle manifest: the installed library, brute force, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fintrail.llm import merkle as M, token_counts as T, whitening as W


# ------------------------------------------------------------------ token counts

def one_by_one(pairs, part):
    """Symbols left when the lowest pair is merged, leftmost first, until none is left."""
    ranks = {tuple(p): i for i, p in enumerate(pairs)}
    s = [T.byte_names()[b] for b in part]
    while len(s) > 1:
        rank, i = min((ranks.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(s, s[1:])))
        if rank == 1 << 40:
            break
        s[i:i + 2] = [s[i] + s[i + 1]]
    return len(s)


@pytest.mark.parametrize("seed", range(4))
def test_merges_one_by_one(seed, monkeypatch):
    rng = random.Random(seed)
    made, pairs = list("abc"), []
    while len(pairs) < 40:
        p = (rng.choice(made), rng.choice(made))
        if p[0] + p[1] not in made:
            pairs.append(p)
            made.append(p[0] + p[1])
    m = T.Merges(pairs)
    parts = ["".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 9, 40, 90]))).encode() for _ in range(150)] + [b"a" * 77, b"abab" * 20]
    want = [one_by_one(pairs, p) for p in parts]
    assert m.counts(parts) == want
    monkeypatch.setattr(T, "LONG", 5)            # nearly all as linked lists
    assert m.counts(parts) == want
    with pytest.raises(ValueError):
        T.Merges([("a", "b"), ("abc", "d")])


ODD = [None, "", " ", "  \n\n x", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|>", "<|endoftex", "don't we'll", "é中文😀", "\x1c\x85 y",
       "՘x ౜1\U0001246f2", "\U000323b0z", "z" * 1300, "ab" * 900, "中" * 700, "1234 5,6!?", "\x00\x7f", "w " * 900]


def test_token_counts_equal_the_library(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    lib = tokenizers.Tokenizer.from_file(public.path(T.VOCABULARY))
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(ODD[2:12]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts.append("".join(chr(rng.randint(0x4e00, 0x9fff)) if rng.random() < 0.9 else " " for _ in range(400_000)))    # over one slice
    rows = [(i % 290, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "again", "x", 1, 2), (None, "again", "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, id string, n_tokens int, n_bytes int")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(df).collect())
    size = [len(e.ids) for e in lib.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    assert got == sorted(((-1 if r[0] is None else r[0]), len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, size))
    assert T.count_tokens(df.limit(0)).count() == 0
    monkeypatch.setattr(T, "REMEMBERED", 20)     # the memory starts afresh often
    import pyarrow as pa
    b = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts[:60])], names=["id", "text"])
    monkeypatch.setattr(T, "PIECE", 50)
    assert [n for o in T.count_batches(iter([b]), T.load(), 512) for n in o.column("n_tokens").to_pylist()] == size[:60]


# -------------------------------------------------------------------- whitening

KINDS = "vec_id int, embedding array<double>, n int, x string, component int"


def whiten_by_eigenvectors(vectors, k):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    centred = (n * u - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    white = (n * x - sums) / n @ v / np.sqrt(e)
    total = ((centred ** 2).sum() / n)
    return n, [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums))) for r in x], white, e / total


@pytest.mark.parametrize("seed,d,k", [(0, 5, 3), (1, 24, 16), (2, 3, 16)])
def test_whitening(spark, seed, d, k):
    rng = np.random.default_rng(seed)
    good = rng.normal(size=(90, d)) @ np.diag(10.0 ** rng.uniform(-1, 2, d)) + 50
    good = np.vstack([good, np.repeat(good[:1], 40, axis=0)])
    rows = [(i, [float(c) for c in v], 0, "x", 9) for i, v in enumerate(good)]
    odd = [None, [], [1.0] * (d + 1), [float("nan")] * d, [None] * d, [float("inf")] + [0.0] * (d - 1)]
    df = spark.createDataFrame(rows + [(900 + i, v, 0, "x", 9) for i, v in enumerate(odd)] + [(None, rows[3][1], 0, "x", 9)], KINDS).repartition(7)
    out = W.whitened_components(df, k=k).toPandas()
    k = min(k, d)
    n, far, white, share = whiten_by_eigenvectors(list(good) + [good[3]], k)
    assert len(out) == (len(good) + 1) * k and set(out["n"]) == {n}
    got = out.assign(vec_id=out["vec_id"].fillna(len(good))).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-9
    assert np.allclose(out.groupby("component")["explained"].first(), share, rtol=1e-9) and out["identity_error"].max() < 1e-9
    first = out.assign(vec_id=out["vec_id"].fillna(len(good))).groupby("vec_id")["deviation"].first()
    assert [int(v) for v in first] == far


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0], 0, "x", 9) for i in range(3)], KINDS)
    assert W.whitened_components(one).count() == 0 and W.whitened_components(one.limit(0)).count() == 0
    # a constant entry, a repeated entry and a sum of two entries add no component
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(b), 7.0, float(a), float(a + b)], 0, "x", 9) for i, (a, b) in enumerate(rng.integers(-40, 40, (60, 2)))]
    out = W.whitened_components(spark.createDataFrame(rows, KINDS)).toPandas()
    assert sorted(out["component"].unique()) == [1, 2] and out["identity_error"].max() < 1e-9
    assert abs(out.groupby("component")["explained"].first().sum() - 1) < 1e-9
    # a direction with a ten-millionth of the spread of another one is still found
    far = spark.createDataFrame([(i, [float(a) * 1e8, float(b)], 0, "x", 9) for i, (a, b) in enumerate(rng.integers(-40, 40, (60, 2)))], KINDS)
    out = W.whitened_components(far).toPandas()
    assert sorted(out["component"].unique()) == [1, 2] and out["identity_error"].max() < 1e-4
    # entries that no long holds
    huge = spark.createDataFrame([(1, [1e300, 0.0], 0, "x", 9), (2, [-1e300, 1.0], 0, "x", 9), (3, [0.0, 0.5], 0, "x", 9)], KINDS)
    assert {r.component for r in W.whitened_components(huge).collect()} >= {1}


# ----------------------------------------------------------------------- merkle

H = lambda t: hashlib.sha256(t.encode()).hexdigest()
FRAME = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(nodes):
    """Root and, for each node, its (siblings before, siblings after) by level."""
    paths = [[] for _ in nodes]
    place, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = p - p % 3
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + 3])))
        level = [H("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
        place = [p // 3 for p in place]
    return level[0], paths


def manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return H("".join(map(FRAME, (r[0], r[3], r[2], r[4], text))))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, upper = tree_of([subs[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for (_, _, lf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), subs[s][1]):
            path = path + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "")) if even and r[1] is not None else lf
            for a, b in path:
                now = H(a + now + b)
            out.append((r[0], lf, subs[s][0], root, H("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, digest string, leaf string, kept int"


@pytest.mark.parametrize("digits,n", [(6, 800), (2, 85), (1, 30)])     # two layers, and many
def test_merkle_manifest(spark, digits, n):
    rng = random.Random(digits)
    rows = [(i, f"line {i}\nend" if i % 3 else f"plain {i}", "en", "hot", 9) for i in range(n)]
    rows += [(1000 + i, rng.choice([None, "", "\n", "é\nx"]), rng.choice([None, "fr"]), rng.choice([None, "", "a", "é", "Z", "\U0001F600", "￮"]),
              rng.choice([None, 3])) for i in range(60)]
    rows += [(None, "no id\n", "en", "a", 1), (None, None, None, None, None), (7, "other", "en", "hot", 1)] + [(5, "same\n", "en", "hot", 4)] * 30
    rows += [(-4, "x" * 2_000_000 + "\n", "en", "lone", 1)]
    df = spark.createDataFrame([(*r, 1, "d", "l", 2) for r in rows], DOCS)
    if digits == 6:
        df = df.repartition(5)
    out = M.manifest_check(df, digits)
    assert sorted((tuple(r) for r in out.collect()), key=str) == manifest(rows)
    assert M.manifest_check(df.limit(0)).count() == 0
    one = M.manifest_check(df.where("source = 'lone'")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H("")


def test_merkle_proofs_and_ranks(spark):
    rows = [(i % 50, i, f"d{i:04}") for i in range(2000)] + [(7, None, "x")] * 500
    df = spark.createDataFrame([(f"s{g}" if g else None, i, x) for g, i, x in rows], "group string, no int, digest string").repartition(16)
    got = M.ranked(df, "group", ["no"]).groupBy("group").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.max_by("rank", "no").alias("top")).collect()
    assert len(got) == 50 and all(list(r.r) == list(range(len(r.r))) and r.top == len(r.r) - 1 for r in got)
    leaves = spark.createDataFrame([(i, "ab"[i % 2], H(str(i))) for i in range(20)], "id int, source string, leaf string")
    m = M.build(leaves)
    found = M.proofs(m).collect()
    assert len(found) == 20 and all(M.fold(r.leaf, r.before, r.after) == m.root for r in found)
