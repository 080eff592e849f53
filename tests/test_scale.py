"""Steps whose cost per task or row once grew with the table: their shares stay bounded, their rows the same."""

import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa

from fintrail.llm import lm_scoring
from fintrail.llm.common import LOWER, words_of
from fintrail.operators import features as FT, graph as G, neighbours as NN, trailing as TR, twin as TW
from fintrail.plans import tables as T

EV = ("event_id long, user_id long, ts timestamp_ntz, amount double, merchant_name string, status string, txn_kind string, "
      "transaction_type string, merchant_category string")
REF = datetime(2024, 1, 31)


def test_features_are_dealt_over_tasks_by_number_of_events(spark, monkeypatch):
    kinds = ["INCOME", "EXPENSE_ESSENTIAL", "EXPENSE_DISCRETIONARY", "EMI_PAYMENT"]
    rows = [(i, i % 40, REF - timedelta(hours=i % 700), float(100 - i % 150), f"M{i % 5}", "SUCCESS", "P2M", kinds[i % 4], "RENT") for i in range(1200)]
    ev = spark.createDataFrame(rows, EV)
    inv = spark.createDataFrame([(u, REF - timedelta(days=u % 9), 10.0 * u, "ontime", 0) for u in range(60)],
                                "user_id long, ts timestamp_ntz, taxable_value double, filing_status string, filing_delay_days int")
    eway = spark.createDataFrame([(u % 60, REF - timedelta(days=u % 13), 7.0 * u, f"H{u % 3}") for u in range(300)],
                                 "user_id long, ts timestamp_ntz, tot_inv_value double, main_hsn_code string")
    run = lambda: FT.features(ev, REF, invoices=inv, eway=eway)
    want = sorted(run().collect())
    monkeypatch.setattr(FT, "PART_ROWS", 100)
    out = run()
    assert out.rdd.getNumPartitions() == 12
    assert sorted(out.collect()) == want and len(want) == 40


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def some_events(spark):
    kinds = ["INCOME", "EXPENSE_ESSENTIAL", "EXPENSE_DISCRETIONARY", "EMI_PAYMENT"]
    rows = [(i, i % 7 or None, REF - timedelta(hours=i % 700), float(100 - i % 150), f"M{i % 5}", "SUCCESS", "P2M", kinds[i % 4], "RENT") for i in range(900)]
    return spark.createDataFrame(rows, EV)


def test_feature_parts_are_stored_before_they_are_joined(spark):
    out = FT.features(some_events(spark), REF)
    assert out.count() == 7 and "Window" not in plan_of(out)


def test_day_sums_are_made_where_the_events_of_a_day_lie(spark):
    ev = some_events(spark)
    for one, parts in ((lambda n: FT.user_days(ev, REF, parts=n), 5), (lambda n: FT.day_state(ev, n), 5)):
        dealt = one(parts)
        assert dealt.rdd.getNumPartitions() == parts
        key = lambda r: (r["user_id"] or 0, r["day"])
        assert [r.asDict() for r in sorted(dealt.drop("decayed", "decayed_n", "in_decayed", "faded", "faded_n", "in_faded").collect(), key=key)] == [
            r.asDict() for r in sorted(one(None).drop("decayed", "decayed_n", "in_decayed", "faded", "faded_n", "in_faded").collect(), key=key)]


def test_events_of_one_split_are_dealt_out(spark, tmp_path, monkeypatch):
    rows = [(i, i % 9, REF - timedelta(hours=i), "click", 2.0, f'{{"k": {i % 50}}}') for i in range(600)]
    raw = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string")
    raw.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(FT, "PART_ROWS", 100)
    got = T.event_table(spark, str(tmp_path))
    assert len(got.inputFiles()) == 6
    assert sorted(got.collect()) == sorted(T.ev(spark, str(tmp_path)).collect())


def test_latest_version_needs_no_sorted_aggregate(spark):
    t = datetime(2024, 1, 1)
    rows = [(u, t + timedelta(days=v), f"state {v}", v) for u in (1, 2, None) for v in (3, 1, 2)] + [(4, t, "one", 1)]
    got = TW.latest(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, liquidity_health string, version int"))
    assert "SortAggregate" not in plan_of(got)
    assert got.columns == ["user_id", "ts", "liquidity_health", "version"]
    assert {tuple(r) for r in got.collect()} == {(u, t + timedelta(days=3), "state 3", 3) for u in (1, 2, None)} | {(4, t, "one", 1)}


def test_components_spread_numbers_not_names(spark, monkeypatch):
    kinds, greatest = set(), G._greatest
    monkeypatch.setattr(G, "_greatest", lambda edges: (kinds.update(k for _, k in edges.dtypes), greatest(edges))[1])
    ends = [("b", "a"), ("a", "c"), ("c", "b"), ("c", "x"), ("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "a"), ("p", "q"), ("q", "p")]
    got = G.strong_components(spark.createDataFrame(ends, "src string, dst string"))
    assert kinds == {"bigint"} and dict(got.dtypes) == {"node": "string", "component": "string", "size": "bigint"}
    assert {tuple(r) for r in got.collect()} == {("a", "c", 3), ("b", "c", 3), ("c", "c", 3)}


def test_word_classes_do_not_widen_the_text():
    text = pa.array(["x" * (4 << 20)])
    words = words_of(text, LOWER)
    tracemalloc.start()
    lm_scoring._spelling(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * (4 << 20)


def test_neighbour_tasks_hold_few_distances_at_once(spark):
    def metric(a, b):
        if len(a) * len(b) > NN.PAIRS:
            raise MemoryError(f"{len(a)} x {len(b)}")
        return NN.euclidean_matrix(a, b)

    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 3))
    base = spark.createDataFrame([(i, v, v) for i, v in enumerate(x.tolist())], "b long, v array<double>, x array<double>")
    q = base.where("b < 300").select(base.b.alias("q"), "v", "x")
    got = {(r.q, r.rn): r.b for r in NN.knn_join(q, base, 2, metric=metric, exclude_self=True, pivots=1).collect()}
    d = NN.euclidean_matrix(x[:300], x)
    d[np.arange(300), np.arange(300)] = np.inf
    order = d.argsort(1)[:, :2]
    assert got == {(i, k + 1): int(order[i, k]) for i in range(300) for k in range(2)}


def shuffled_rows(df):
    """The result, and the rows written by the shuffles of its plan."""
    got, todo, n = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if node.metrics().contains("shuffleRecordsWritten"):
                n += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return got, n


def brute_force(u, k):
    """The k most similar other rows of each unit vector, by id among equal ones."""
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2)).round(12)
    np.fill_diagonal(d, np.inf)
    return {(i, n + 1): int(b) for i in range(len(u)) for n, b in enumerate(np.argsort(d[i], kind="stable")[:k])}


def as_rows(spark, x):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, v array<double>")
    return df.select(df.i.alias("q"), "v"), df.select(df.i.alias("b"), "v")


def test_queries_are_not_sent_once_per_cell(spark):
    x = np.random.default_rng(4).normal(size=(1200, 24))             # no structure: each query looks into nearly all 40 cells
    got, sent = shuffled_rows(NN.nearest(*as_rows(spark, x), 3, exclude_self=True, pivots=40))
    assert {(r.q, r.rn): r.b for r in got} == brute_force(x / np.linalg.norm(x, axis=1)[:, None], 3)
    assert sent < 10 * 1200


def clusters(n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 16))
    x[rng.permutation(n)[:n // 4]] = x[0]                            # copies all over the table tie: the smallest ids count
    return x


def test_neighbours_among_copies_and_broken_vectors(spark, monkeypatch):
    x = clusters(600)
    q, b = as_rows(spark, x)
    broken = spark.createDataFrame([(2000 + i, [bad] + [1.0] * 15) for i, bad in enumerate([float("nan"), float("inf")] * 20)], "b long, v array<double>")
    monkeypatch.setattr(NN, "HELD", 16 * 200)                        # three splits of the queries
    got = NN.nearest(q, b.union(broken), 4, exclude_self=True, pivots=12).collect()
    assert {(r.q, r.rn): r.b for r in got} == brute_force(x / np.linalg.norm(x, axis=1)[:, None], 4)


def test_neighbours_of_one_task_in_small_steps(monkeypatch):
    for name, value in (("TILE", 24), ("RUN", 8), ("PAIRS", 24 * 50), ("QUERY_STEP", 90)):
        monkeypatch.setattr(NN, name, value)
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    for x in (clusters(300), 1e6 + clusters(300), 1e-18 * clusters(300), 1e25 * clusters(300)):
        scale = np.abs(x).max()
        for metric, hits in ((NN.euclidean_matrix, b"\xff\x80"), (NN.euclidean_matrix, b"\x7f\x80"), (lambda a, b: np.abs(a[:, None] - b[None]).sum(2), b"\xff\x80")):
            block = NN._Block(pa.table({"q": np.arange(300), "x": lists(x), "bound": np.full(300, np.inf), "cells": pa.array([hits] * 300, pa.binary())}),
                              4, 0.95, 9, metric, True)
            assert block.wide == (hits == b"\xff\x80")
            for i in range(0, 300, 70):
                n = np.arange(i, min(300, i + 70))
                block.add(pa.table({"b": n, "x": lists(x[n]), "cell": pa.array(n % 8 + 1, pa.int32())}))
            got = pa.Table.from_batches(block.found()).to_pylist()
            d = (np.sqrt(((x[:, None] / scale - x[None] / scale) ** 2).sum(2)) if metric is NN.euclidean_matrix else np.abs(x[:, None] - x[None]).sum(2) / scale)
            np.fill_diagonal(d, np.inf)
            best = np.sort(d, 1)[:, :4]
            assert np.allclose(np.array([r["distance"] / scale for r in got]).reshape(300, 4), best, rtol=1e-9, atol=1e-15)
            copies = [i for i in range(300) if best[i, 3] == 0]
            assert len(copies) > 70
            for i in copies:
                assert [r["b"] for r in got if r["q"] == i] == [int(j) for j in np.flatnonzero(d[i] == 0)[:4]]


def test_neighbours_of_null_and_repeated_names(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("b", [1.0, 0.1]), (None, [1.0, 0.2]), ("c", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "i string, v array<double>")
    got = NN.nearest(df.select(df.i.alias("q"), "v"), df.select(df.i.alias("b"), "v"), 3, exclude_self=True).collect()
    found = {(r.q, r.rn): r.b for r in got}
    assert [found["a", n] for n in (1, 2, 3)] == ["b", "b", None]
    assert [found["b", n] for n in (1, 2, 3)] == [None, None, "a"]   # two equal queries, as in the SQL
    assert [found["c", n] for n in (1, 2, 3)] == [None, "b", "b"] and found[None, 1] is None


def test_smoothing_keeps_one_blend_per_user(spark):
    rows = [(u, v, (v * 7 + (u or 0)) % 10 / 10, [float(((u or 0) + v + i) % 3) / 2 for i in range(4)]) for u in (1, 2, None) for v in range(1, 6)]
    rows += [(3, 1, 0.2, [0.5] * 4), (3, 2, None, [0.1] * 4), (3, 3, 0.3, [0.4] * 4)]
    df = spark.createDataFrame(rows, "user_id long, version int, risk_score double, vector array<double>")
    out = TW.smooth_vectors(df)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {(r.user_id, r.version): r.vector for r in out.collect()}
    for u in (1, 2, None):
        blend = None
        for _, v, risk, vec in [x for x in rows if x[0] == u]:
            if blend is not None:
                a = max(0.15, min(0.65, 0.20 + abs(risk - before) * 1.5))
                vec = [max(0.0, min(1.0, (1 - a) * p + a * n)) for p, n in zip(blend, vec)]
            blend, before = vec, risk
            assert got[u, v] == blend
    assert got[3, 1] == [0.5] * 4 and got[3, 2] == got[3, 3] == [None] * 4


def test_summaries_hold_an_instant_that_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        at = [datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 9), datetime(2024, 1, 5), datetime(2024, 3, 1)]
        rows = [(i, i % 2 or None, at[i % 4 if i % 3 else 1], float(i), "INCOME", "RENT") for i in range(40)]
        ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, amount double, transaction_type string, merchant_category string")
        out = TR.event_summaries(ev)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.event_id: (r.income_7d, r.event_count_30d, r.categories_90d) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, u, t, *_ in rows:
        held = lambda n: [x[3] for x in rows if x[1] == u and x[2] <= t and (t - x[2]).days <= n]
        assert got[i] == (sum(held(7)), len(held(30)), {"RENT": sum(held(90))} if sum(held(90)) else {})
