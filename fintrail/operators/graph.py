"""Transfer-graph operators as iterative DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fintrail.functions.numeric import DAY_MICROS, level, micros, rnd
from fintrail.session import cut, written

c = F.col
SUSPICIOUS_PER_DAY = 50_000.0


def build(upi: DataFrame, ewb: DataFrame | None = None) -> DataFrame:
    """Edges of both sources without self-loops and unknown ends."""
    e = upi.withColumn("event_type", F.lit("upi"))
    if ewb is not None:
        e = e.unionByName(ewb.withColumn("event_type", F.lit("ewb")))
    known = lambda n: c(n).isNotNull() & ~c(n).isin("", "unknown")
    return e.where(known("src") & known("dst") & (c("src") != c("dst")))


def collapse(edges: DataFrame) -> DataFrame:
    """One row per ordered pair: weight, first and last time, count."""
    return edges.groupBy("src", "dst").agg(F.sum("amount").alias("weight"), F.min("ts").alias("min_ts"),
                                           F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("transfers"))


# ----------------------------------------------------------------- pagerank

def pagerank(pairs: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, block: int = 6) -> DataFrame:
    """Weighted PageRank, ranks summing to 1.

    With uniform jumps, handing the mass of dangling nodes to everyone only
    rescales the result, so the loop leaves it out and the ranks are normalised
    at the end. A step is then one join and one pre-aggregated sum; `block` steps
    run between two lineage cuts, where convergence is checked.
    """
    out = pairs.groupBy("src").agg(F.sum("weight").alias("_w"))
    steps = cut(pairs.join(out, "src").where(c("_w") > 0).select("src", "dst", (c("weight") / c("_w")).alias("p")))
    nodes = cut(pairs.select(c("src").alias("node")).unionByName(pairs.select(c("dst").alias("node"))).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("pagerank", F.lit(0.0))
    base = (1.0 - damping) / n
    ranks = nodes.withColumn("r", F.lit(1.0 / n))
    done = 0
    while done < max_iter:
        before, last = ranks, min(block, max_iter - done)
        for _ in range(last):
            flow = (steps.join(ranks.withColumnRenamed("node", "src"), "src")
                    .groupBy(c("dst").alias("node")).agg(F.sum(c("r") * c("p")).alias("in")))
            ranks = nodes.join(flow, "node", "left").select("node", (base + damping * F.coalesce("in", F.lit(0.0))).alias("r"))
        ranks = cut(ranks)
        done += last
        moved = (ranks.join(before.withColumnRenamed("r", "b"), "node")
                 .agg(F.sum(F.abs(c("r") - c("b")))).first()[0])
        if moved < tol:
            break
    total = ranks.agg(F.sum("r").alias("t"))                  # one row
    return ranks.crossJoin(F.broadcast(total)).select("node", (c("r") / c("t")).alias("pagerank"))


def shell_hubs(ranks: DataFrame, maturity: DataFrame, rank: float = 0.15, months: int = 6) -> DataFrame:
    """Marks high-ranked, young nodes. maturity(node, months_active)."""
    j = ranks.join(maturity, "node", "left").withColumn("months_active", F.coalesce("months_active", F.lit(24)))
    return j.withColumn("is_shell_hub", (c("pagerank") >= rank) & (c("months_active") <= months))


# -------------------------------------------------- strong components

def strong_components(pairs: DataFrame, min_size: int = 3, max_rounds: int = 10_000) -> DataFrame:
    """node, component (its largest node), size - for components of at least min_size.

    A round first makes the graph small: nodes without an edge in or out go (they lie on no cycle), and chains of nodes
    with one edge in and one out become one edge, all at once by doubling. Then every node learns the largest node that
    reaches it, and, against the edges among nodes that agree on it, the largest that it reaches. Nodes for which both
    are the same make a component and leave the graph. Largest nodes spread along edges and over the shortcut to the
    largest node found so far, whose own largest node reaches all that it reaches, so long ways take few steps. Nodes of a chain belong to
    the component of its two ends, if that is one. Names are numbered first: largest of numbers are kept in hash tables
    and take little room in each round's shuffles, largest of texts are sorted for.
    """
    edges = written(pairs.select("src", "dst").where("src <> dst").distinct())
    names = _numbered(edges)
    edges = written(edges.join(names.withColumnsRenamed({"name": "src", "node": "_s"}), "src")
                    .join(names.withColumnsRenamed({"name": "dst", "node": "_d"}), "dst").select(c("_s").alias("src"), c("_d").alias("dst")))
    found: list[DataFrame] = []
    drawn: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    for _ in range(max_rounds):
        edges, some = _shrunk(edges)
        drawn += some
        if edges.isEmpty():
            break
        up = _greatest(edges)
        inside = (edges.join(up.withColumnsRenamed({"node": "src", "top": "a"}), "src")
                  .join(up.withColumnsRenamed({"node": "dst", "top": "b"}), "dst").where("a = b").select("src", "dst"))
        inside = written(inside)
        down = _greatest(inside.select(c("dst").alias("src"), c("src").alias("dst")))
        same = written(up.join(down.withColumnRenamed("top", "low"), "node").where("top = low")
                   .select("node", c("top").alias("component")))
        # a largest node all of whose edges leave its group is alone in its component
        alone = up.where("node = top").join(same.select("node"), "node", "left_anti").select("node", c("top").alias("component"))
        gone = same.unionByName(alone)
        found.append(gone)
        left = gone.select("node")
        edges = written(edges.join(left.withColumnRenamed("node", "src"), "src", "left_anti")
                    .join(left.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    else:
        raise RuntimeError("strong_components did not finish; raise max_rounds")
    out = pairs.sparkSession.createDataFrame([], "node long, component long")
    for part in found:
        out = out.unionByName(part)
    for chain, rings, starts in reversed(drawn):   # the ends of a chain may lie inside a later one
        out = out.unionByName(starts.join(out.select("node"), "node", "left_anti")).unionByName(rings)
        one = out.select(c("node").alias("first"), c("component").alias("_a"))
        two = out.select(c("node").alias("last"), c("component").alias("_b"))
        on = chain.join(one, "first").join(two, "last").where("_a = _b").select("node", c("_a").alias("component"))
        out = written(out.unionByName(on))
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(c("size") >= min_size)
    # a component is named by its largest node
    large = written(out.join(sizes, "component").join(names, "node").select("component", "name", "size"))
    named = large.groupBy("component").agg(F.max("name").alias("_top"))
    return large.join(named, "component").select(c("name").alias("node"), c("_top").alias("component"), "size")


def _numbered(edges: DataFrame) -> DataFrame:
    """(name, node): a number of its own for every end of an edge."""
    ends = edges.select(c("src").alias("name")).unionByName(edges.select(c("dst").alias("name"))).distinct()
    return written(ends.withColumn("node", F.monotonically_increasing_id()))


def _shrunk(edges: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, DataFrame]]]:
    """Edges without dead ends and with chains drawn together. For each drawing: the chains (node, first, last), whole
    cycles of such nodes (node, component), and nodes to which a chain comes back (node, component).

    Dead ends go as long as there are any. Chains are drawn together while they hold an eighth of the nodes, so that
    happens logarithmically often; fewer such nodes are left to what follows. What hangs together like a tree is gone
    after logarithmically many repetitions.
    """
    drawn = []
    while True:
        ins = edges.groupBy(c("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("before"))
        outs = edges.groupBy(c("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("after"))
        deg = written(ins.join(outs, "node", "full"))
        kinds = deg.agg(F.count_if(c("i").isNull() | c("o").isNull()).alias("dead"),
                        F.count_if((c("i") == 1) & (c("o") == 1)).alias("thin"), F.count(F.lit(1)).alias("n")).first()
        draw = kinds["thin"] > 0 and 8 * kinds["thin"] >= kinds["n"]
        if not kinds["dead"] and not draw:
            return edges, drawn
        if kinds["dead"]:
            live = deg.where(c("i").isNotNull() & c("o").isNotNull()).select("node")
            kept = edges.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(
                live.withColumnRenamed("node", "dst"), "dst", "left_semi")
        else:
            kept = edges
        thin = deg.where((c("i") == 1) & (c("o") == 1)).select("node", "before", "after")
        if draw:
            ends, closed = _ends(thin, kinds["thin"])
            lone = thin.select("node")
            links = ends.where("first_step").select(c("first").alias("src"), c("last").alias("dst"))
            kept = (edges.join(lone.withColumnRenamed("node", "src"), "src", "left_anti")
                    .join(lone.withColumnRenamed("node", "dst"), "dst", "left_anti").unionByName(links))
            if kinds["dead"]:
                # a chain from or to a dead end becomes an edge of it, which goes with it
                dead = deg.where(c("i").isNull() | c("o").isNull()).select("node")
                kept = (kept.join(dead.withColumnRenamed("node", "src"), "src", "left_anti")
                        .join(dead.withColumnRenamed("node", "dst"), "dst", "left_anti"))
            # a chain that comes back to its start: that node is on a cycle with it, which needs no further edge
            back = ends.where("first = last").select(c("first").alias("node"), c("first").alias("component"))
            drawn.append((ends.select("node", "first", "last"), closed, written(back.distinct())))
            kept = kept.where("src <> dst").distinct()
        edges = written(kept)


def _ends(thin: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """For nodes with one edge in and one out: the first and last node outside the chain they are in; and whole cycles.

    Pointers double: after k steps a node knows the node 2^k ahead and behind, or the end of its chain, and the largest
    node on the way. Those that have found no end after log2(n) steps go round in a cycle, whose largest node they know.
    """
    p = written(thin.select("node", c("before").alias("first"), c("after").alias("last"), c("node").alias("top"), c("before").alias("near")))
    inner = written(thin.select(c("node").alias("x")))
    for _ in range(max(1, n.bit_length())):
        ahead = p.select(c("node").alias("last"), c("last").alias("_last"), c("top").alias("_top"))
        behind = p.select(c("node").alias("first"), c("first").alias("_first"))
        p = written(p.join(ahead, "last", "left").join(behind, "first", "left").select(
            "node", F.coalesce("_first", "first").alias("first"), F.coalesce("_last", "last").alias("last"),
            F.greatest("top", F.coalesce("_top", "top")).alias("top"), "near"))
        open_ends = p.join(inner, c("last") == c("x"), "left_semi")
        if open_ends.isEmpty():
            break
    p = p.join(inner.select(c("x").alias("last"), F.lit(True).alias("_open")), "last", "left")
    starts = inner.select(c("x").alias("near"), F.lit(False).alias("_start"))
    ends = (p.where("_open IS NULL").join(starts, "near", "left")
            .select("node", "first", "last", F.coalesce("_start", F.lit(True)).alias("first_step")))
    return written(ends), written(p.where("_open").select("node", c("top").alias("component")))


def _greatest(edges: DataFrame) -> DataFrame:
    """(node, top): the largest node that reaches each node, itself included."""
    nodes = edges.select(c("src").alias("node")).unionByName(edges.select(c("dst").alias("node"))).distinct()
    top = written(nodes.select("node", c("node").alias("top"), F.lit(True).alias("fresh")))
    while True:
        along = (edges.join(top.where("fresh").select(c("node").alias("src"), "top"), "src")
                 .select(c("dst").alias("node"), "top"))
        over = (top.select("node", c("top").alias("via")).where("node <> via")
                .join(top.where("fresh").select(c("node").alias("via"), "top"), "via").select("node", "top"))
        news = along.unionByName(over).groupBy("node").agg(F.max("top").alias("up"))
        higher = F.coalesce(c("up") > c("top"), F.lit(False))
        top = written(top.join(news, "node", "left").select("node", F.when(higher, c("up")).otherwise(c("top")).alias("top"), higher.alias("fresh")))
        if top.where("fresh").isEmpty():
            return top.select("node", "top")


# ------------------------------------------------------------------- cycles

def cycles(pairs: DataFrame, lengths: Sequence[int] = (2, 3, 4, 5), members: DataFrame | None = None) -> DataFrame:
    """Every simple cycle of the given lengths, once, starting at its smallest node.

    A cycle is found from its node of lowest degree, in two halves: ways of up to half its length from that node along
    the edges and against them, over nodes that rank higher, which meet in the same node and share no other. Low degrees
    at the start keep halves few, and hubs are only ever met in the middle. Ways that no way of the other kind can
    close, as none leads from their start to their end, are left out before they are made longer.
    Optionally restricted to members(node, component). Returns nodes, hops (weight, min_ts, max_ts per hop), length.
    """
    e = pairs
    if members is not None:
        m = members.select("node", "component")
        e = (e.join(m.select(c("node").alias("src"), c("component").alias("_a")), "src")
             .join(m.select(c("node").alias("dst"), c("component").alias("_b")), "dst").where("_a = _b").drop("_a", "_b"))
    deg = (e.select(c("src").alias("node")).unionByName(e.select(c("dst").alias("node")))
           .groupBy("node").agg(F.count(F.lit(1)).alias("deg")))
    e = written(e.join(deg.select(c("node").alias("src"), c("deg").alias("_sd")), "src")
            .join(deg.select(c("node").alias("dst"), c("deg").alias("_dd")), "dst")
            .select(F.struct(c("_sd").alias("deg"), c("src").alias("id")).alias("s"),
                    F.struct(c("_dd").alias("deg"), c("dst").alias("id")).alias("d"),
                    F.struct("weight", "min_ts", "max_ts").alias("hop")))
    none = F.slice(F.array("s"), 1, 0)
    forth = {1: e.where("d > s").select(c("s").alias("at"), c("d").alias("end"), none.alias("way"), F.array("hop").alias("hops"))}
    back = {1: e.where("s > d").select(c("d").alias("at"), c("s").alias("end"), none.alias("way"), F.array("hop").alias("hops"))}

    def longer(ways: DataFrame, ahead: bool) -> DataFrame:
        on, to = ("s", "d") if ahead else ("d", "s")
        step = e.select(c(on).alias("end"), c(to).alias("next"), "hop")
        j = ways.join(step, "end").where((c("next") > c("at")) & (c("next") != c("end")) & ~F.array_contains("way", c("next")))
        if ahead:
            return j.select("at", c("next").alias("end"), F.concat("way", F.array("end")).alias("way"), F.concat("hops", F.array("hop")).alias("hops"))
        return j.select("at", c("next").alias("end"), F.concat(F.array("end"), "way").alias("way"), F.concat(F.array("hop"), "hops").alias("hops"))

    def closable(ways: DataFrame, other: DataFrame) -> DataFrame:
        return ways.join(other.select("at").distinct(), "at", "left_semi")
    for k in range(2, (max(lengths) + 1) // 2 + 1):
        if any(x // 2 >= k for x in lengths):
            back[k] = written(longer(closable(back[k - 1], forth[1]), False))
        need = back[max(x // 2 for x in lengths if (x + 1) // 2 >= k)]
        forth[k] = written(longer(closable(forth[k - 1], need if k > 2 else back[1]), True))
    out = None
    for length in lengths:
        a, b = forth[(length + 1) // 2], back[length // 2].withColumnsRenamed({"way": "way2", "hops": "hops2"})
        p = a.join(b, ["at", "end"]).where(~F.arrays_overlap("way", "way2"))
        ids = F.transform(F.concat(F.array("at"), "way", F.array("end"), "way2"), lambda x: x["id"])
        p = p.select(ids.alias("ids"), F.concat("hops", "hops2").alias("hops")).withColumn(
            "first", F.array_position("ids", F.array_min("ids")).cast("int"))
        turn = lambda x: F.concat(F.slice(x, c("first"), length), F.slice(x, F.lit(1), c("first") - 1))
        p = p.select(turn(c("ids")).alias("nodes"), turn(c("hops")).alias("hops"), F.lit(length).alias("length"))
        out = p if out is None else out.unionByName(p)
    return out


def monotone(hops: Column) -> Column:
    """From some hop on, each hop's first transfer is later than the last of the hop before.

    A ring has no first node, so any rotation counts: at most one step around it may go back in time.
    """
    after = F.concat(F.slice(hops, F.lit(2), F.size(hops) - 1), F.slice(hops, 1, 1))
    steps = F.zip_with(hops, after, lambda a, b: ~(b["min_ts"] > a["max_ts"]))
    return F.size(F.filter(steps, lambda x: x)) <= 1


def cycle_metrics(found: DataFrame) -> DataFrame:
    """Flow, speed and temporal order of each cycle."""
    flow = F.aggregate("hops", F.lit(0.0), lambda a, h: a + h["weight"])
    lo = F.array_min(F.transform("hops", lambda h: h["min_ts"]))
    hi = F.array_max(F.transform("hops", lambda h: h["max_ts"]))
    days = F.greatest((micros(hi) - micros(lo)) / F.lit(float(DAY_MICROS)), F.lit(1.0))
    m = found.withColumns({"temporal_ok": monotone(c("hops")), "total_flow": rnd(flow, 2)})
    return m.withColumn("velocity", rnd(flow / days, 2)).withColumn(
        "suspicious", c("temporal_ok") & (c("velocity") > SUSPICIOUS_PER_DAY))


def recurrence(found: DataFrame) -> DataFrame:
    """How often each cycle's node set occurs among the cycles given."""
    key = F.array_sort("nodes")
    k = found.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("recurrence"))
    return found.withColumn("_k", key).join(k, "_k").drop("_k")


def verdicts(hubs: DataFrame, metrics: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Ring verdict per node from the temporally ordered cycles. hubs: node, is_shell_hub, pagerank.

    `scc_size` is the size of the largest component of `members`; `evidence` lists what speaks against a node, as codes.
    """
    real = metrics.where("temporal_ok")
    whole = real.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("suspicious")).alias("s"))          # one row
    ring = real.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("cycles"))
    j = hubs.join(ring, "node", "left").crossJoin(F.broadcast(whole)).withColumn("in_ring", c("cycles").isNotNull())
    shell = F.when(c("is_shell_hub"), 0.3).otherwise(0.0)
    conf = F.when(c("n") > 0, F.least(c("s") / c("n") + shell + F.when(c("in_ring"), 0.2).otherwise(0.0), F.lit(1.0))).otherwise(
        F.when(c("is_shell_hub"), 0.1).otherwise(0.0))
    j = j.withColumn("fraud_confidence", rnd(conf, 4))
    largest = (members.agg(F.coalesce(F.max("size"), F.lit(0)).alias("scc_size")) if members is not None
               else hubs.sparkSession.createDataFrame([(0,)], "scc_size long"))                    # one row
    j = j.crossJoin(F.broadcast(largest)).withColumn("evidence", F.array_join(F.filter(F.array(
        F.when(c("s") > 0, F.concat(F.lit("suspicious_cycles="), c("s"))), F.when(c("is_shell_hub"), F.lit("shell_hub")),
        F.when(c("in_ring"), F.lit("in_ring"))), lambda x: x.isNotNull()), ";"))
    return j.select("node", "in_ring", F.coalesce("cycles", F.lit(0)).alias("cycles"), "fraud_confidence", "scc_size", "evidence",
                    ((c("fraud_confidence") >= 0.5) | (c("in_ring") & (c("s") > 0))).alias("fraud_ring_flag"),
                    level(c("fraud_confidence"), (0.7, "CRITICAL"), (0.45, "HIGH"), (0.2, "MEDIUM"), default="LOW").alias("ring_risk"))


# ----------------------------------------------------------------- networks

def ego_network(transfers: DataFrame, centre: Column) -> DataFrame:
    """Edges in and out of the centre accounts. transfers(src, dst, amount, ...)."""
    return transfers.where(centre & (c("src") != c("dst")))


def undirected(edges: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First edge of every unordered pair."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    cols = F.struct(*order, *[c(n).alias(f"v_{n}") for n in edges.columns])
    first = edges.select("*", a, b).groupBy("a", "b").agg(F.min(cols).alias("f"))
    return first.select("a", "b", *[c(f"f.v_{n}").alias(n) for n in edges.columns])
