"""Merkle manifest of a dataset: a content-addressed tree of digests, and proofs found by descending from its root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fintrail.llm.common import stored

ARITY = 3                      # nodes of a run
DIGITS = 6                     # levels that one record holds (so at most 729 nodes)
TOP = "top"                    # group of the tree over all subroots


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------ record of a block

def levels_of(nodes: list[str], whole: bool, digits: int) -> list[list[str]]:
    """The levels above up to ARITY^digits neighbours. A whole tree ends at its root, a part of one after `digits` levels."""
    out = [nodes]
    while len(out) <= digits and (len(out[-1]) > 1 or not whole):
        low = out[-1]
        out.append([_hash("".join(low[i:i + ARITY])) for i in range(0, len(low), ARITY)])
    return out


def segment_of(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """The siblings before and after node i and its ancestors, nearest the leaf first (each level's joined).

    Found from the top: the digits of i choose a child of each record on the way down, the others are collected, and
    the collected levels are turned round at the end.
    """
    before, after = [], []
    for level in range(len(levels) - 2, -1, -1):
        at = i // ARITY ** level
        run = at - at % ARITY
        low = levels[level]
        before.append("".join(low[run:at]))
        after.append("".join(low[at + 1:run + ARITY]))
    return before[::-1], after[::-1]


def fold(leaf: str, before: list[str], after: list[str]) -> str:
    for a, b in zip(before, after):
        leaf = _hash(a + leaf + b)
    return leaf


# ---------------------------------------------------------------------- ranks

def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `rank` (from 0) within each group by `order`, nulls first, without a task that holds a whole group.

    The rows are dealt out by ranges of (group, order) and numbered per task; a group that goes over several tasks is
    shifted by the counts of the tasks before, of which there is one number for each task. Rows that are alike in all
    of `order` go in any order.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    dealt = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n = object(), 0
        for b in batches:
            runs = []
            for g in b.column(group).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                runs.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(runs, pa.int64())],
                                             names=[*b.schema.names, "_part", "_no"])
    fields = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    rows = stored(dealt.mapInArrow(number, f"{fields}, _part int, _no long").drop("_tie"), "merkle-order")
    mark = F.struct(F.col(group).isNotNull().alias("there"), F.col(group).alias("g"))
    edges = (rows.groupBy("_part").agg(F.min(mark).alias("first"), F.max(F.struct(mark.alias("m"), F.col("_no"))).alias("last"))
             .orderBy("_part").collect())          # one row for each task
    shifts, end, ahead = [], None, 0
    for r in edges:
        shift = ahead if end is not None and r["first"] == end else 0
        shifts.append((r["_part"], r["first"]["there"], r["first"]["g"], shift))
        ahead = r["last"]["_no"] + 1 + (shift if r["last"]["m"] == r["first"] else 0)
        end = r["last"]["m"]
    kind = dict(nodes.dtypes)[group]
    known = rows.sparkSession.createDataFrame(shifts, f"_part int, _there boolean, _g {kind}, _shift long")
    same = F.col("_g").eqNullSafe(F.col(group))
    return (rows.join(F.broadcast(known), "_part")
            .withColumn("rank", F.col("_no") + F.when(same, F.col("_shift")).otherwise(0)).drop("_part", "_no", "_there", "_g", "_shift"))


# ----------------------------------------------------------------------- trees

RECORD = "digest string, group string, block long, depth int, children array<string>"


@dataclass
class Trees:
    """One tree per group, as stored layers of records, leaf side first: the digest that names a record, and its nodes.

    A record stands for up to `digits` levels: `children` are the nodes of the lowest of them, and all levels between
    follow from these. `roots` has a row (group, digest) per tree.
    """
    digits: int
    layers: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def grown(nodes: DataFrame, digits: int = DIGITS) -> Trees:
    """Builds the trees over nodes (group string, rank, digest). Nulls are a group of their own.

    Other columns go into the records of the lowest layer (`kept`, beside `children`).
    """
    others = [c for c in nodes.columns if c not in ("group", "rank", "digest")]
    low = nodes.withColumn("kept", F.struct(*others)) if others else nodes
    out, span = Trees(digits), ARITY ** digits

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, depths = [], []
            for block, children in zip(b.column("block"), b.column("children")):
                nodes = children.as_py()
                levels = levels_of(nodes, block.as_py() == 0 and len(nodes) < span, digits)
                heads.append(levels[-1][0])
                depths.append(len(levels) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), b.column("group"), b.column("block"),
                                              pa.array(depths, pa.int32()), *b.columns[2:]],
                                             names=["digest", "group", "block", "depth", *b.schema.names[2:]])
    while True:
        kept = [c for c in ("kept",) if c in low.columns]
        run = F.sort_array(F.collect_list(F.struct("rank", "digest", *kept)))
        blocks = (low.groupBy("group", F.expr(f"rank div {span}").alias("block")).agg(run.alias("run"))
                  .select("group", "block", F.col("run.digest").alias("children"), *[F.col(f"run.{c}").alias(c) for c in kept]))
        kinds = RECORD + "".join(f", {c} {dict(blocks.dtypes)[c]}" for c in kept)
        layer = stored(blocks.mapInArrow(named, kinds), "merkle-layer")
        out.layers.append(layer)
        low = layer.select("group", F.col("block").alias("rank"), "digest")
        if (layer.agg(F.max("block")).first()[0] or 0) == 0:
            out.roots = low.select("group", "digest")
            return out


def met(requests: DataFrame, layer: DataFrame) -> DataFrame:
    """Requests (digest, group, rank, before, after, ...) with the record that their digest names, in their own place."""
    r = layer.select(F.col("digest").alias("_digest"), F.col("group").alias("_group"), F.col("block").alias("_block"), *layer.columns[3:])
    return requests.join(r, (F.col("digest") == F.col("_digest")) & F.col("group").eqNullSafe(F.col("_group")) &
                         (F.col("rank") == F.col("_block"))).drop("_digest", "_group", "_block")


def _paths(row: dict, digits: int) -> tuple[list[str], list[int], list[list[str]], list[list[str]]]:
    """A record's nodes, their ranks, and their siblings up to the root: the new segment, then the path so far."""
    levels = levels_of(row["children"], row["depth"] < digits, digits)
    found = [segment_of(levels, i) for i in range(len(levels[0]))]
    return (levels[0], [row["rank"] * ARITY ** digits + i for i in range(len(found))],
            [p[0] + row["before"] for p in found], [p[1] + row["after"] for p in found])


def descended(trees: Trees, roots: DataFrame, layers: int | None = None) -> DataFrame:
    """Requests for all nodes below `roots` (digest, group, before, after, other columns), through all layers or some.

    At each layer a request meets its record by digest. The record's nodes, told apart by the next digits of their
    rank, are the requests to the layer below; their segment of siblings goes in front of the path so far.
    """
    at = roots.withColumn("rank", F.lit(0).cast("long"))
    fixed, digits = ("digest", "rank", "before", "after"), trees.digits
    extra = [c for c in at.columns if c not in fixed]
    fields = ", ".join(["digest string", "rank long", "before array<string>", "after array<string>",
                        *[f"`{c}` {t}" for c, t in at.dtypes if c in extra]])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                nodes, ranks, before, after = _paths(row.to_pylist()[0], digits)
                same = pa.array([0] * len(nodes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(ranks, pa.int64()), pa.array(before, pa.list_(pa.string())),
                     pa.array(after, pa.list_(pa.string())), *[row.column(c).take(same) for c in extra]], names=[*fixed, *extra])
    for layer in trees.layers[::-1][:layers]:
        at = met(at, layer.drop("kept")).mapInArrow(step, fields)
    return at


# -------------------------------------------------------------------- manifest

@dataclass
class Manifest:
    """The trees of the sources, the places of these in the tree over them, that tree, and its root (None: no rows)."""
    sources: Trees
    order: DataFrame
    top: Trees
    root: str | None
    kept: str | None


def leaf_of(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
            changed: dict[str, Column] | None = None) -> Column:
    """The leaf digest of a row; `changed` puts other values in the place of columns."""
    return digest_of(*[framed((changed or {}).get(c, docs[c])) for c in columns])


def build(leaves: DataFrame, digits: int = DIGITS) -> Manifest:
    """Builds the manifest over leaves (id, source, leaf, other columns) and stores it. Leaves are in order of (id, leaf)."""
    placed = ranked(stored(leaves, "merkle-leaves"), "source", ["id", "leaf"])
    sources = grown(placed.withColumnsRenamed({"source": "group", "leaf": "digest"}), digits)
    order = ranked(sources.roots.withColumn("all", F.lit(TOP)), "all", ["group"])
    order = stored(order.withColumnRenamed("group", "source"), "merkle-sources")
    top = grown(order.select(F.col("all").alias("group"), "rank", "digest"), digits)
    root = top.roots.first()
    return Manifest(sources, order, top, root["digest"] if root else None, dict(sources.layers[0].dtypes).get("kept"))


def subroots(m: Manifest) -> DataFrame:
    """Each source's subroot with its proof up to the root: source, digest, before, after."""
    spark = m.order.sparkSession
    start = spark.createDataFrame([(m.root, TOP, [], [])] if m.root else [],
                                  "digest string, group string, before array<string>, after array<string>")
    return descended(m.top, start).drop("group").join(m.order.select("source", "rank", "digest"), ["rank", "digest"]).drop("rank")


def proofs(m: Manifest) -> DataFrame:
    """The proof of every leaf: source, rank, leaf, subroot, before, after (siblings by level, leaf side first)."""
    start = subroots(m).withColumnRenamed("source", "group").withColumn("subroot", F.col("digest"))
    return descended(m.sources, start).withColumnsRenamed({"digest": "leaf", "group": "source"})


def verified(m: Manifest) -> DataFrame:
    """One row per leaf: its own columns (`kept`), leaf, subroot, proof_sha256, folded_root, root, verified.

    The leaves must have been built with a column `shadow`, the digest of the row as it is found now (null: as it was).
    It is folded with the stored siblings. Only digests leave a task; siblings stay with their block.
    """
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                kept = row.column("kept").flatten()
                leaves, _, before, after = _paths({c: row.column(c)[0].as_py() for c in ("children", "depth", "rank", "before", "after")}, digits)
                now = [leaf if x is None else x for leaf, x in zip(leaves, kept.field("shadow").to_pylist())]
                proof = [_hash("".join(x + y for x, y in zip(p, q))) for p, q in zip(before, after)]
                folded = [fold(x, p, q) for x, p, q in zip(now, before, after)]
                subroot = row.column("subroot").take(pa.array([0] * len(leaves)))
                yield pa.RecordBatch.from_arrays([kept, pa.array(leaves), subroot, pa.array(proof), pa.array(folded)],
                                                 names=["kept", "leaf", "subroot", "proof_sha256", "folded_root"])
    digits = m.sources.digits
    start = subroots(m).withColumnRenamed("source", "group").withColumn("subroot", F.col("digest"))
    blocks = met(descended(m.sources, start, len(m.sources.layers) - 1), m.sources.layers[0])
    one = m.kept[len("array<"):-1]
    out = blocks.mapInArrow(check, f"kept {one}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return (out.select("kept.*", "leaf", "subroot", "proof_sha256", "folded_root").drop("shadow")
            .withColumn("root", F.lit(m.root).cast("string")).withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root"))))


def manifest_check(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Builds the manifest of `docs` and proves every row against it, rows with an even crc32 of doc_id after tampering.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Tampering deletes the line breaks of a
    text. Null columns are framed as `-`; a null doc_id comes first in its source and is not tampered with; null
    sources are a source of their own, before all others. Rows that are alike share their leaf digest and have
    places next to each other; rows with equal doc_ids are in the order of their leaf digests. Very long texts are
    hashed whole by Spark; an empty table has no root and no rows. Only the five columns are read, so no other column
    can clash.
    """
    d = docs.select("doc_id", "source", "lang", "n_chars", "text")
    even = F.crc32(d["doc_id"].cast("string").cast("binary")) % 2 == 0
    bare = leaf_of(d, changed={"text": F.replace(d["text"], F.lit("\n"), F.lit(""))})
    leaves = d.select(d["doc_id"].alias("id"), "source", leaf_of(d).alias("leaf"), F.when(even, bare).alias("shadow"))
    return verified(build(leaves, digits)).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                                          "folded_root", "verified")
