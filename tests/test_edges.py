"""Small literal cases: limits, empty histories, ties, skew helpers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from fintrail.functions import constants as K, keyed
from fintrail.functions.numeric import cosine, micros
from fintrail.operators import (canonical as C, classify as CL, features as FT, graph as G, joins as J, models as M, neighbours as NN,
                                ordered as O, paths as P, risk as R, stateful, twin as TW, vigilance as V)

c = F.col
EV = ("event_id long, user_id long, ts timestamp_ntz, amount double, merchant_name string, status string, txn_kind string, "
      "transaction_type string, merchant_category string, source_provenance string")
REF = datetime(2024, 1, 31)


def event(i, user=1, ts=datetime(2024, 1, 20), amount=-10.0, status="SUCCESS", kind="EXPENSE_ESSENTIAL", cat="GROCERY"):
    return (i, user, ts, amount, "M1", status, "P2M", kind, cat, "bank_api")


def test_user_with_only_old_events_gets_defaults(spark):
    ev = spark.createDataFrame([event(1, ts=datetime(2023, 12, 30), amount=-5.0, kind="EXPENSE_DISCRETIONARY"),
                                event(2, user=2, ts=datetime(2022, 1, 1))], EV)
    rows = {r["user_id"]: r for r in FT.features(ev, REF).collect()}
    assert 2 not in rows                      # nothing in any window
    assert rows[1]["cash_buffer_days"] == 90.0
    assert rows[1]["income_stability_score"] == 0.3
    assert rows[1]["lifestyle_inflation_trend"] == 0.0


def test_empty_events(spark):
    assert FT.features(spark.createDataFrame([], EV), REF).count() == 0


def ring(spark, hours):
    t = datetime(2024, 1, 1)
    rows = [(s, d, 10_000.0, t + timedelta(hours=h)) for (s, d), h in zip([("A", "B"), ("B", "C"), ("C", "A")], hours)]
    return G.collapse(spark.createDataFrame(rows, "src string, dst string, amount double, ts timestamp_ntz"))


def test_ring_component_and_order(spark):
    p = ring(spark, [0, 2, 4])
    comp = G.strong_components(p).collect()
    assert {r["node"] for r in comp} == {"A", "B", "C"} and comp[0]["size"] == 3
    m = G.cycle_metrics(G.cycles(p, (3, 4))).collect()
    assert len(m) == 1 and m[0]["temporal_ok"] and list(m[0]["nodes"]) == ["A", "B", "C"]
    assert m[0]["total_flow"] == 30_000.0


def test_ring_with_earlier_second_hop_is_not_monotone(spark):
    assert not G.cycle_metrics(G.cycles(ring(spark, [2, 0, 4]), (3,))).first()["temporal_ok"]


def test_ring_order_does_not_depend_on_names(spark):
    for hours, ok in (([0, 2, 4], True), ([4, 0, 2], True), ([2, 4, 0], True), ([4, 2, 0], False)):
        assert G.cycle_metrics(G.cycles(ring(spark, hours), (3,))).first()["temporal_ok"] == ok, hours


def test_ring_of_two(spark):
    t = datetime(2024, 1, 1)
    p = G.collapse(spark.createDataFrame([("A", "B", 5.0, t), ("B", "A", 4.0, t + timedelta(hours=1)), ("B", "C", 1.0, t)],
                                         "src string, dst string, amount double, ts timestamp_ntz"))
    m = G.cycle_metrics(G.cycles(p, members=G.strong_components(p, min_size=2))).collect()
    assert len(m) == 1 and list(m[0]["nodes"]) == ["A", "B"] and m[0]["temporal_ok"] and m[0]["total_flow"] == 9.0


def test_far_dates_do_not_overflow(spark):
    rows = [(1, datetime(2024, 1, 1), 100.0), (1, datetime(2099, 1, 1), 50.0), (1, datetime(2098, 12, 2), 80.0), (2, datetime(2024, 1, 1), 7.0)]
    inv = spark.createDataFrame([(*r, "ontime", 0) for r in rows], "user_id long, ts timestamp_ntz, taxable_value double, filing_status string, filing_delay_days int")
    got = {r["user_id"]: r["gst_30d_value"] for r in FT.invoice_features(inv).collect()}
    assert got == {1: 90.0, 2: 7.0}       # half of the 80 of 30 days before, nothing of the rest


def test_far_dates_leave_numbers_in_the_state(spark):
    rows = [event(1, ts=datetime(2024, 1, 1, 5)), event(2, ts=datetime(2099, 6, 1, 7)), event(3, ts=datetime(2099, 6, 20)), event(4, ts=datetime(1969, 12, 20)),
            event(5, ts=datetime(2099, 6, 30, 23)), event(6, ts=datetime(2099, 8, 1))]
    ev = spark.createDataFrame(rows, EV)
    for r in FT.daily_features(ev).collect():
        want = FT.account_features(ev, r["ts"]).first()
        assert r["daily_avg_throughput_30d"] == pytest.approx(want["daily_avg_throughput_30d"], abs=2e-4)
    assert TW.snapshots(ev).where("isnan(risk_score) OR risk_score IS NULL").count() == 0


def test_last_purchase_of_equal_times_has_the_largest_id(spark):
    t = datetime(2024, 1, 30)
    ev = spark.createDataFrame([event(i, ts=t, amount=-float(i), kind="EXPENSE_DISCRETIONARY") for i in (10, 11, 12, 13)], EV)
    assert [r["disc_last"] for r in FT.user_days(ev, REF).select("disc_last").collect()] == [13.0]


def test_worst_message_may_be_the_newest(spark):
    rows = [(1, i, datetime(2024, 1, 1) + timedelta(hours=i), 0.9 if i == 40 else 0.1, "LOW") for i in range(41)]
    df = spark.createDataFrame(rows, "user_id int, message_id int, ts timestamp_ntz, scam_probability double, scam_risk string")
    assert V.worst_message(df).first()["message_id"] == 40


def test_cycles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2)) if a != b}
    t = datetime(2024, 1, 1)
    df = G.collapse(spark.createDataFrame([(a, b, 1.0, t) for a, b in edges], "src long, dst long, amount double, ts timestamp_ntz"))
    want = set()

    def walk(path, limit):
        if len(path) >= 2 and (path[-1], path[0]) in edges:
            want.add(tuple(path))
        if len(path) < limit:
            for a, b in edges:
                if a == path[-1] and b not in path and b > path[0]:
                    walk(path + [b], limit)
    for n in range(12):
        walk([n], 5)
    got = [tuple(r["nodes"]) for r in G.cycles(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2)) if a != b}
    reach = {n: {b for a, b in edges if a == n} for n in range(40)}
    for _ in range(40):
        for n in reach:
            reach[n] |= set().union(*[reach[m] for m in reach[n]]) if reach[n] else set()
    want = {frozenset(m for m in range(40) if m in reach[n] and n in reach[m]) for n in range(40) if n in reach[n]}
    df = spark.createDataFrame(list(edges), "src long, dst long")
    got = {}
    for r in G.strong_components(df, min_size=2).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == {w for w in want if len(w) >= 2}


@pytest.mark.parametrize("shape", ["tail", "rings", "sparse"])
def test_components_of_thin_graphs(spark, shape):
    """Chains, trees and rings that a layer at a time would take thousands of rounds."""
    rng, n = random.Random(shape), 400
    names = rng.sample(range(10_000), n)
    edges = {"tail": [(i, (i + 1) % 50) for i in range(50)] + [(i, i + 1) for i in range(50, n - 1)] + [(3, 50), (n - 1, 7), (9, 300), (300, 9)],
             "rings": [(i, i - i % 7 + (i + 1) % 7) for i in range(n - n % 7)] + [(i, i + 7) for i in range(0, 300, 7)] + [(301, 294), (20, 13)],
             "sparse": [(rng.randrange(n), rng.randrange(n)) for _ in range(480)]}[shape]
    edges = [(names[a], names[b]) for a, b in edges if a != b]
    got = {}
    for r in G.strong_components(spark.createDataFrame(edges, "src long, dst long"), min_size=2).collect():
        got.setdefault(r["component"], set()).add(r["node"])
        assert r["size"] >= 2
    assert got == {max(w): w for w in components_of(edges) if len(w) > 1}


def components_of(edges):
    """Tarjan without recursion."""
    out, index, low, stack, on = [], {}, {}, [], set()
    follow = {}
    for a, b in edges:
        follow.setdefault(a, []).append(b)
    for root in {x for e in edges for x in e}:
        if root in index:
            continue
        work = [(root, iter(follow.get(root, [])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(follow.get(w, []))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = set()
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.add(w)
                        if w == v:
                            break
                    out.append(comp)
    return out


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("d", "a", 1.0)], "src string, dst string, weight double")
    got = {r["node"]: r["pagerank"] for r in G.pagerank(df, tol=1e-12).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    names, x = sorted(got), np.full(4, 0.25)
    P_ = {("a", "b"): .5, ("a", "c"): .5, ("b", "c"): 1.0, ("d", "a"): 1.0}
    for _ in range(200):
        y = np.full(4, 0.15 / 4) + 0.85 * x[names.index("c")] / 4
        for (s, t), p in P_.items():
            y[names.index(t)] += 0.85 * p * x[names.index(s)]
        x = y
    assert all(abs(got[n] - x[i]) < 1e-6 for i, n in enumerate(names))


def path_table(spark, breaching=30, day=5):
    rows = [(p, t, 100.0 if p < breaching and t == day else 100_000.0) for p in range(100) for t in range(90)]
    return spark.createDataFrame(rows, "path_id long, day int, balance double")


def test_early_warning_share(spark):
    r = P.early_warning(path_table(spark), 40_000.0).first()
    assert r["ews_14d"] == 0.30 and r["ews_7d"] <= r["ews_14d"] <= r["ews_30d"]


@pytest.mark.parametrize("share, label", [(0.10, "GREEN"), (0.20, "AMBER"), (0.40, "ORANGE"), (0.60, "RED")])
def test_warning_severity(spark, share, label):
    assert spark.range(1).select(*V.warning_severity(F.lit(share))).first()["severity"] == label


def test_tail_loss_is_at_least_var(spark):
    r = P.value_at_risk(path_table(spark), 100_000.0).first()
    assert r["cvar"] >= r["var"] == 99_900.0


def state(spark, **over):
    row = dict(user_id=1, version=1, ts=datetime(2024, 1, 1), risk_score=0.3, liquidity_health="HIGH", cash_buffer_days=20.0, emi_burden_ratio=0.25,
               spending_volatility=0.3, income_stability=0.8, persona="genuine_healthy", previous_volatility=None)
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], "user_id long, version int, ts timestamp_ntz, risk_score double, liquidity_health string, "
                                 "cash_buffer_days double, emi_burden_ratio double, spending_volatility double, income_stability double, persona string, "
                                 "previous_volatility double")


def fired(spark, **over):
    return {r["trigger_type"] for r in R.triggers(state(spark, **over)).collect()}


def test_buffer_of_exactly_ten_does_not_alert(spark):
    assert "liquidity_drop" not in fired(spark, liquidity_health="MEDIUM", cash_buffer_days=10.0)
    assert "liquidity_drop" in fired(spark, liquidity_health="MEDIUM", cash_buffer_days=9.99)


def test_fraud_is_escalated_not_sent(spark):
    alerts = R.triggers(state(spark, persona="shell_circular", cash_buffer_days=3.0, liquidity_health="LOW"))
    consent = spark.createDataFrame([(1, True)], "user_id long, consent boolean")
    sent, up = R.notifications(alerts, consent, personalization=1.0, acceptance=1.0)
    assert "fraud_anomaly" not in {r["trigger_type"] for r in sent.collect()} and up.count() == 1
    nobody = spark.createDataFrame([(1, False)], "user_id long, consent boolean")
    assert R.notifications(alerts, nobody, personalization=1.0)[0].count() == 0


@pytest.mark.parametrize("score, band", [(900, "very_low_risk"), (750, "very_low_risk"), (749, "low_risk"), (650, "low_risk"), (550, "medium_risk"), (300, "high_risk")])
def test_bands(spark, score, band):
    assert spark.range(1).select(R.credit_band(F.lit(score)).alias("b")).first()["b"] == band


def test_scores_stay_in_range(spark):
    got = spark.createDataFrame([(p / 20,) for p in range(21)], "p double").select(TW.bureau_score(c("p")).alias("s")).collect()
    assert all(300 <= r["s"] <= 900 for r in got)


def test_as_of_before_first_snapshot_is_null(spark):
    snaps = spark.createDataFrame([(1, datetime(2024, 1, 10), 1)], "user_id long, ts timestamp_ntz, version int")
    t = spark.createDataFrame([(1, datetime(2024, 1, 9)), (1, datetime(2024, 1, 10)), (1, datetime(2024, 3, 1))], "user_id long, ts timestamp_ntz")
    got = {r["ts"]: r["snap_version"] for r in TW.as_of(t, snaps, ["version"]).collect()}
    assert list(got.values()).count(None) == 1 and got[datetime(2024, 1, 9)] is None


def test_few_timestamps_are_not_regular(spark):
    rows = [(1, datetime(2024, 1, 1) + timedelta(hours=h)) for h in range(4)] + [(2, datetime(2024, 1, 1) + timedelta(hours=h)) for h in range(40)]
    got = {r["user_id"]: r for r in O.interval_regularity(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")).collect()}
    assert not got[1]["regular_flag"] and got[1]["interval_cv"] == 1.0 and got[2]["regular_flag"]


def scam(spark, text, sender=None):
    df = spark.createDataFrame([("m", 1, None, sender, text)], "message_id string, user_id long, ts timestamp_ntz, sender_id string, text string")
    return V.scam_probability(V.message_scores(df)).first()


def test_bare_code_needs_urgency(spark):
    assert scam(spark, "your number is 482913")["otp_score"] == 0.0
    assert scam(spark, "urgent 482913")["otp_score"] > 0.0


def test_registered_sender_lowers_authority(spark):
    assert scam(spark, "RBI official notice", "TM-HDFCBK")["authority_score"] < scam(spark, "RBI official notice")["authority_score"]


def test_scam_phrase_far_into_a_long_text_counts(spark):
    assert scam(spark, "x " * 5000 + "urgent")["urgency_score"] > 0


def test_zero_vector_is_similar_to_nothing(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(c("a"), c("b")).alias("s")).first()
    assert r["s"] == 0.0


def test_duplicates_and_unknown_merchants(spark):
    ev = spark.createDataFrame([event(1), event(1), event(2)], EV)
    assert C.deduplicate(ev).count() == 2
    got = CL.enrich(ev.withColumn("merchant_name", F.lit("zzqq"))).select("merchant_category").distinct().collect()
    assert [r[0] for r in got] == ["OTHER"] and got[0][0] in K.CATEGORIES


# --------------------------------------------------------- skew-safe helpers

def hot(spark, n=5000):
    rng = np.random.default_rng(1)
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1 if i % 3 else int(rng.integers(2, 9)), t0 + timedelta(seconds=int(rng.integers(0, 400_000))),
                                   float(np.round(rng.exponential(50), 2)), "FAILED" if i % 17 == 0 else "SUCCESS") for i in range(n)],
                                 "event_id long, user_id long, ts timestamp_ntz, amount double, status string")


def test_positions_and_halo_equal_a_plain_window(spark):
    df = hot(spark).withColumn("t", micros(c("ts")))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    p = keyed.with_position(df, ["user_id"], F.floor(c("t") / 3_600_000_000), [c("ts"), c("event_id")])
    want = df.withColumn("want", F.row_number().over(w)).withColumn("mean", F.avg("amount").over(w.rowsBetween(-50, -1)))
    h = keyed.with_halo(p, "pos", 97, 50)
    hw = W.partitionBy("user_id", "chunk").orderBy("pos").rowsBetween(-50, -1)
    got = h.withColumn("m2", F.avg("amount").over(hw)).where("not is_halo").select("event_id", "pos", "m2")
    j = want.join(got, "event_id")
    assert j.count() == df.count()
    assert j.where((c("want") != c("pos")) | (F.abs(F.coalesce("mean", F.lit(0.0)) - F.coalesce("m2", F.lit(0.0))) > 1e-9)).count() == 0


def test_quantiles_equal_percentile(spark):
    df = hot(spark).withColumn("amount", F.when(c("event_id") % 3 == 0, 10.0).otherwise(c("amount")))      # one value holds a third
    probs = {"a": 0.1, "b": 0.5, "z": 0.99}
    got = {r["user_id"]: r for r in keyed.quantiles(df, ["user_id"], "amount", probs).collect()}
    for r in df.groupBy("user_id").agg(F.percentile("amount", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("p")).collect():
        g = got[r["user_id"]]
        assert np.allclose([g["a"], g["b"], g["z"]], r["p"])


def test_running_totals(spark):
    df = hot(spark, 800)
    got = {r["amount"]: r["n_before"] for r in keyed.running_totals(df, [], "amount", {"n": F.lit(1)}).collect()}
    vals = sorted(r["amount"] for r in df.select("amount").collect())
    assert all(got[v] == sum(x < v for x in vals) for v in set(vals))


@pytest.mark.parametrize("pivots", [None, 9])
def test_neighbours_equal_brute_force_with_copies(spark, pivots):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[:100] = x[0]                                            # a third are copies
    x[250] = 0.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")
    got = {}
    for r in NN.nearest(df.select(c("i").alias("q"), "v"), df.select(c("i").alias("b"), "v"), 4, exclude_self=True, pivots=pivots).collect():
        got.setdefault(r["q"], {})[r["rn"]] = (r["b"], round(r["similarity"], 6))
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n < 1e-9, 1, n)[:, None]
    sim = u @ u.T
    for q in range(300):
        order = sorted((b for b in range(300) if b != q), key=lambda b: (-round(sim[q, b], 9), b))[:4]
        assert [round(sim[q, b], 6) for b in order] == [got[q][k + 1][1] for k in range(4)]


def test_probed_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 1500)] + 0.15 * rng.normal(size=(1500, 8))
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 8))          # one cell holds a third
    x[700], x[701] = 0.0, x[702]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")
    q, b = df.select(c("i").alias("q"), "v"), df.select(c("i").alias("b"), "v")
    probes = NN.fit_probes(q, b, 5, 0.95, exclude_self=True, pivots=32)
    assert probes < 16                                          # fitted on 256 queries, far fewer cells than all
    got = {}
    for r in NN.nearest(q, b, 5, True, 32, probes).collect():
        got.setdefault(r["q"], {})[r["b"]] = r["similarity"]
    assert len(got) == 1500 and all(len(g) == 5 and i not in g for i, g in got.items())
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n < 1e-9, 1, n)[:, None]
    sim = u @ u.T
    np.fill_diagonal(sim, -2.0)
    true = np.sort(sim, 1)[:, -5]
    live = [i for i in range(1500) if n[i] > 1e-9]
    found = sum(s >= true[i] - 1e-9 for i in live for s in got[i].values())
    assert found / (5 * len(live)) >= 0.9
    assert all(abs(s - sim[i, j]) < 1e-9 for i in live[::50] for j, s in got[i].items())
    assert NN.nearest_probed(q.limit(0), b, 5).count() == 0 and NN.nearest_probed(q.limit(3), b.limit(0), 5).count() == 0


def test_probed_neighbours_fill_up_from_further_cells(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "i long, v array<double>")
    q, b = df.select(c("i").alias("q"), "v"), df.select(c("i").alias("b"), "v")
    got = NN.nearest(q, b, 5, True, 8, 1).groupBy("q").count().collect()
    assert len(got) == 8 and all(r["count"] == 5 for r in got)


def test_stateful_flags_equal_a_plain_loop(spark):
    df = hot(spark, 2000).withColumn("amount", F.when(c("event_id") % 101 == 0, 900.0).otherwise(c("amount")))
    want, seen = {}, {}
    for r in df.withColumn("t", micros(c("ts"))).orderBy("user_id", "ts", "event_id").collect():
        a, t = seen.setdefault(r["user_id"], ([], []))
        flag = r["status"] == "FAILED"
        if not flag and len(a) >= 10:
            s = np.std(a[-200:], ddof=1)
            flag = (abs(r["amount"]) - np.mean(a[-200:])) / (s or 1.0) > 3
        if not flag:
            flag = sum(x >= r["t"] - 3_600_000_000 for x in t[-50:]) > 5
        if not flag:
            a.append(abs(r["amount"]))
            t.append(r["t"])
        want[r["event_id"]] = bool(flag)
    got = {r["event_id"]: r["anomaly_flag"] for r in stateful.stateful_flags(df).collect()}
    assert got == want


def test_fold_of_many_events_equals_one_by_one():
    rng = np.random.default_rng(9)
    for seed in range(6):
        n = 1500
        amounts = np.round(rng.exponential(50, n), 2)
        amounts[rng.integers(0, n, 30)] *= 20
        if seed == 5:
            amounts[700] = np.nan
        times = np.cumsum(rng.exponential([2e8, 3e9][seed % 2], n)).round()
        failed = rng.random(n) < 0.05
        one, many = stateful.AnomalyState(), stateful.AnomalyState()
        want = [one.check(a, t, f) for a, t, f in zip(amounts, times, failed)]
        got = np.concatenate([many.fold(amounts[i:j], times[i:j], failed[i:j]) for i, j in ((0, 333), (333, 334), (334, n))])
        assert got.tolist() == want and any(want)
        assert np.array_equal(one.amounts, many.amounts, equal_nan=True) and np.array_equal(one.times, many.times)


def test_chunks_of_a_hot_user_equal_one_loop(spark):
    df = hot(spark, 4500).withColumn("amount", F.when(c("event_id") % 67 == 0, 4000.0).otherwise(c("amount")))
    df = df.withColumn("user_id", F.when(c("event_id") % 5 != 0, 1).when(c("event_id") % 7 == 0, None).otherwise(c("user_id")).cast("long"))
    whole = {(r[0], r[1], r[2]) for r in stateful.stateful_flags(df, chunk=1 << 30).collect()}
    assert any(f for _, _, f in whole) and len(whole) == 4500
    rounds = []
    for chunk, lead in ((400, 350), (1200, 0)):                  # good guesses, none
        flags, ends, n = stateful.speculative_flags(df, ends=True, chunk=chunk, lead=lead)
        assert {(r[0], r[1], r[2]) for r in flags.collect()} == whole
        rounds.append(n)
        end = {r.user_id: (list(r.amounts), list(r.times)) for r in ends.collect()}
        assert end == last_states(df)
    assert rounds[1] > 1
    # no chunk holds more than its size and the rest of an hour
    e = df.select("user_id", F.floor(micros(c("ts")) / stateful.HOUR).alias("hour"))
    places = stateful._places(e, 400, 350).selectExpr("_user", "_hour", "explode(places) AS p").where("not p.lead")
    sizes = (e.join(places, (c("user_id") == c("_user")) & (c("hour") == c("_hour"))).groupBy("user_id", "p.chunk").count()
             .agg(F.max("count"), F.count(F.lit(1))).first())
    most = e.groupBy("user_id", "hour").count().agg(F.max("count")).first()[0]
    assert sizes[0] <= 400 + most and sizes[1] >= 8
    empty, _, _ = stateful.speculative_flags(df.limit(0), ends=True)
    assert empty.count() == 0


def last_states(df):
    out = {}
    for r in df.withColumn("t", micros(c("ts"))).orderBy("user_id", "ts", "event_id").collect():
        out.setdefault(r["user_id"], stateful.AnomalyState()).check(abs(r["amount"]), float(r["t"]), r["status"] == "FAILED")
    return {k: (v.amounts.tolist(), v.times.tolist()) for k, v in out.items()}


def test_isolation_flags_five_percent_and_the_outlier(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[7] = 50.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "user_id long, a double, b double, z double")
    got = {r["user_id"]: r for r in M.isolation_flags(df, ["a", "b", "z"]).collect()}
    assert abs(sum(r["temporal_anomaly_flag"] for r in got.values()) - 20) <= 1 and got[7]["temporal_anomaly_flag"] == 1
    assert M.isolation_flags(df.where("user_id < 9"), ["a", "b", "z"]).agg(F.sum("temporal_anomaly_flag")).first()[0] == 0


def test_calendar_fills_gaps(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1).date(), 1), ("a", datetime(2024, 1, 4).date(), 2)], "k string, day date, n int")
    assert [r["n"] for r in J.calendar(df, ["k"], "day", ["n"]).orderBy("day").collect()] == [1, 0, 0, 2]


def test_daily_vectors_over_many_months_equal_single_reference_vectors(spark):
    rng = np.random.default_rng(8)
    kinds = ["INCOME", "EXPENSE_ESSENTIAL", "EXPENSE_DISCRETIONARY", "EMI_PAYMENT", "SUBSCRIPTION"]
    rows = []
    for i in range(900):
        k = kinds[int(rng.integers(0, 5))]
        amt = float(np.round(rng.exponential(80), 2)) * (3 if k == "INCOME" else -1)
        ts = datetime(2023, 10, 1) + timedelta(days=int(rng.integers(0, 230)), seconds=int(rng.integers(0, 86400)))
        rows.append(event(i, user=int(rng.integers(1, 4)), ts=ts, amount=amt, kind=k, status="FAILED" if i % 9 == 0 else "SUCCESS",
                          cat="CASH_ATM" if i % 5 == 0 else "GROCERY"))
    ev = spark.createDataFrame(rows, EV)
    daily = FT.daily_features(ev).persist()
    cols = [x for x in daily.columns if x not in ("ts", "user_id")]
    checked = 0
    for ref in (datetime(2023, 12, 31), datetime(2024, 1, 1), datetime(2024, 2, 29), datetime(2024, 3, 1), datetime(2024, 5, 3)):
        one = {r["user_id"]: r for r in FT.account_features(ev.where(c("ts") < F.lit(ref)), ref).collect()}
        for r in daily.where(c("ts") == F.lit(ref)).collect():
            checked += 1
            for x in cols:
                assert r[x] == pytest.approx(one[r["user_id"]][x], abs=2e-4), (ref, x)
    assert checked >= 5


def test_month_end_dip_over_three_months(spark):
    rows = [event(1, ts=datetime(2024, 1, 10), amount=100.0), event(2, ts=datetime(2024, 1, 26), amount=-40.0),
            event(3, ts=datetime(2024, 2, 3), amount=50.0), event(4, ts=datetime(2024, 2, 27), amount=-10.0),
            event(5, ts=datetime(2024, 3, 5), amount=70.0)]                      # March has no late part
    got = FT.account_features(spark.createDataFrame(rows, EV), datetime(2024, 3, 20)).first()
    assert got["end_of_month_liquidity_dip"] == ((-40 - 100) + (-10 - 50)) / 2


def vectors(spark, n, holes=()):
    cols = list(dict.fromkeys([*K.IMPUTE_REFERENCE, *K.IMPUTE_TARGET, *K.CADENCE_COLUMNS]))
    rng = np.random.default_rng(5)
    data = [(i, *[None if (i, x) in holes else float(v) for x, v in zip(cols, rng.normal(0, 1, len(cols)) + (40 if i == 3 else 0))], 0.0, "keep") for i in range(n)]
    return cols, data, spark.createDataFrame(data, "user_id long, " + ", ".join(f"{x} double" for x in cols) + ", temporal_anomaly_flag double, extra string")


def test_post_processing_imputes_flags_and_keeps_the_columns(spark):
    holes = {(5, "savings_rate"), (5, "gst_30d_value"), (11, "cash_buffer_days")}
    cols, data, fv = vectors(spark, 60, holes)
    out = M.post_process(fv)
    assert out.columns == fv.columns
    got = {r["user_id"]: r for r in out.collect()}
    used = [1 + cols.index(x) for x in [*K.IMPUTE_REFERENCE, *K.IMPUTE_TARGET]]
    for i, x in holes:
        at, mine = 1 + cols.index(x), data[i]
        def far(b):
            both = [(mine[k], b[k]) for k in used if mine[k] is not None and b[k] is not None]
            return sum((p - q) ** 2 for p, q in both) * len(used) / len(both)
        near = sorted((b for b in data if b[at] is not None and b[0] != i), key=lambda b: (far(b), b[0]))[:5]
        assert abs(got[i][x] - sum(b[at] for b in near) / 5) < 1e-9
    assert all(got[r[0]][x] == r[1 + k] for r in data for k, x in enumerate(cols) if (r[0], x) not in holes)
    assert got[3]["temporal_anomaly_flag"] == 1.0 and sum(r["temporal_anomaly_flag"] for r in got.values()) == 3
    few = M.post_process(vectors(spark, 6)[2]).collect()
    assert len(few) == 6 and all(r["temporal_anomaly_flag"] == 0.0 for r in few)


def test_alerts_say_why_and_what_to_do(spark):
    a = {r["trigger_type"]: r for r in R.triggers(state(spark, cash_buffer_days=4.0, liquidity_health="LOW", emi_burden_ratio=0.41)).collect()}
    assert a["liquidity_drop"]["reason"] == "Cash buffer at 4.0 days (threshold: 10)"
    assert a["emi_at_risk"]["reason"] == "EMI burden at 41% of income (threshold: 35%)"
    assert a["prequalified_micro_loan_offer"]["suggested_actions"] == K.TRIGGER_ACTIONS["prequalified_micro_loan_offer"]


def test_snapshot_beyond_the_table_looks_at_its_last_day(spark):
    p = spark.createDataFrame([(1, d, 100.0 - d) for d in range(40)] + [(2, d, 10.0) for d in range(40)], "path_id int, day int, balance double")
    r = {x["horizon"]: x for x in P.horizon_snapshots(p, (30, 60), 100.0, 160.0, 65.0).collect()}
    assert r[30]["delta_mean"] == (-29.0 - 90.0) / 2 and r[60]["delta_mean"] == (-39.0 - 90.0) / 2
    assert r[30]["default_probability"] == 0.5 and r[60]["default_probability"] == 1.0
    assert r[60]["shortage_day_mean"] == 10.5           # days 21 and 0
    zero = P.horizon_snapshots(p.where("path_id = 2"), (30,), 100.0, 160.0, 5.0).first()
    assert zero["shortage_day_mean"] is None


def test_message_evidence_rests_on_the_scores(spark):
    rows = [("m1", "URGENT: call within 24 hours, code 123456", None), ("m2", "code 123456", None), ("m3", None, None), ("m4", "", "TM-HDFCBK"),
            ("m5", "RBI official notice", " TM-HDFCBK "), ("m6", "RBI official notice", "98765"), ("m7", "x " * 50_000 + "deadline", None)]
    m = spark.createDataFrame(rows, "message_id string, text string, sender_id string")
    got = {}
    for r in V.message_evidence(m).collect():
        got.setdefault(r["message_id"], []).append((r["signal"].split("_")[0], r["matched_text"], r["confidence"], r["severity"]))
    assert sorted(got["m1"]) == [("OTP", "123456", 0.551, "CRITICAL"), ("URGENCY", "URGENT", 0.593, "MEDIUM"), ("URGENCY", "within 24 hours", 0.593, "MEDIUM")]
    assert sorted(got["m5"]) == [("AUTHORITY", "RBI", 0.19, "HIGH"), ("AUTHORITY", "official notice", 0.19, "HIGH")]
    assert [x[2:] for x in got["m6"]] == [(0.632, "CRITICAL")] * 2
    assert got["m7"] == [("URGENCY", "deadline", 0.362, "MEDIUM")]
    assert set(got) == {"m1", "m5", "m6", "m7"}                  # digits alone, nulls and empty texts give no row
    scores = {r["message_id"]: r for r in V.message_scores(m.where("text IS NOT NULL")).collect()}
    for k, x in scores.items():
        assert (k in got) == (max(x["urgency_score"], x["authority_score"], x["otp_score"]) > 0)
    assert V.message_evidence(m.limit(0)).count() == 0


def test_leading_indicators(spark):
    steady = [event(i, 1, REF - timedelta(days=i, hours=1)) for i in range(30)]
    burst = [event(100 + i, 2, REF - timedelta(days=i, hours=1), amount=-300.0 if i == 1 else -10.0) for i in range(30)]
    other = [event(200, 3, REF - timedelta(days=2), status="FAILED"), event(201, 3, REF - timedelta(days=8), status="FAILED"),
             event(202, 4, REF - timedelta(days=31)), event(203, 5, REF - timedelta(days=1), amount=None), event(204, 6, REF, status=None)]
    p = {r["user_id"]: r for r in V.spend_pressure(spark.createDataFrame(steady + burst + other, EV), REF).collect()}
    assert set(p) == {1, 2, 3, 6}
    x7 = np.array([10.0, 300.0] + [10.0] * 5)
    x30 = np.append(x7, [10.0] * 23)
    assert p[1]["volatility_change"] == 0.0
    assert p[2]["volatility_change"] == pytest.approx((x7.std() / x7.mean()) / (x30.std() / x30.mean()) - 1, abs=1e-4)
    assert p[3]["debit_failures_7d"] == 1 and p[3]["volatility_change"] == 0.0
    paths = spark.createDataFrame([(1, d, 100.0 - d) for d in range(40)] + [(2, 0, 5.0), (2, 1, 9.0), (3, 4, 1.0)], "path_id long, day int, balance double")
    assert {r[0]: r[1] for r in P.daily_burn(paths).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    df = spark.createDataFrame([(1, 0.256, 0, 0.0), (2, 0.1, 2, 3.5), (3, None, None, None)],
                               "user_id long, volatility_change double, debit_failures_7d long, avg_daily_burn double")
    got = {r["user_id"]: (r["volatility_change_pct"], r["indicators"]) for r in V.leading_indicators(df).collect()}
    assert got == {1: (26, ["SPENDING_VOLATILITY_UP"]), 2: (10, ["DEBIT_FAILURES", "CASH_BUFFER_DECLINING"]), 3: (0, ["NONE"])}


def test_gated_concentration_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    t0 = datetime(2023, 1, 1)
    rows = [(i, 1 if i % 3 else 2 + i % 5, t0 + timedelta(days=int(rng.integers(0, 500)), hours=int(rng.integers(0, 24))), float(-rng.integers(1, 99)), f"M{rng.integers(0, 9)}")
            for i in range(1200)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, amount double, merchant_name string")
    refs = [(u, t0 + timedelta(days=d), f, 200_000.0) for u in (1, 2, 4) for d in range(0, 520, 13) for f in (0.5 if d % 2 else 0.1,)]
    snaps = spark.createDataFrame(refs, "user_id long, ts timestamp_ntz, debit_failure_rate_90d double, daily_avg_throughput_30d double")
    got = {(r["user_id"], r["ts"]): r["top3"] for r in TW._gated_top3(ev, snaps).collect()}
    want = {}
    for u, ref, f, _ in refs:
        total = {}
        for _, user, ts, a, m in rows:
            if f > 0.3 and user == u and ref - timedelta(days=90) <= ts < ref:
                total[m] = total.get(m, 0.0) - a
        if total:
            want[u, ref] = sum((x / sum(total.values())) ** 2 for x in sorted(total.values(), reverse=True)[:3])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
