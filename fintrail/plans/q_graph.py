"""Queries for message, mule, stress and graph operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fintrail.functions import constants as K
from fintrail.functions.numeric import rnd
from fintrail.operators import features as FT, graph as G, joins as J, ordered as O, timeline as TL, vigilance as V
from fintrail.plans import tables as T
from fintrail.plans.q_timeline import FLOW_SQL
from fintrail.plans.registry import query
from fintrail.plans.sql import CTES, quoted, r

c = F.col

# ----------------------------------------------------------------- messages


def _hits(patterns) -> str:
    return "(" + " + ".join(f"regexp_matches(text, {quoted(['(?i)' + p])})::INT" for p in patterns) + ")"


CTES["msg0"] = f"SELECT *, {_hits(K.URGENCY_PATTERNS)} AS u, {_hits(K.AUTHORITY_PATTERNS)} AS a, {_hits(K.CODE_REQUEST_PATTERNS)} AS o0, regexp_matches(text, {quoted([K.BARE_CODE_PATTERN])}) AS bare FROM messages"
CTES["msg"] = f"""SELECT *, {r('1 - exp(-0.45 * u)')} AS urgency_score, {r('1 - exp(-0.8 * (o0 + (bare AND u > 0)::INT))')} AS otp_score,
  {r("(1 - exp(-0.5 * a)) * CASE WHEN coalesce(regexp_matches(trim(sender_id), '(?i)" + K.REGISTERED_SENDER_PATTERN + "'), FALSE) THEN 0.3 ELSE 1.0 END")} AS authority_score FROM msg0"""


def _lr(n: str) -> str:
    return f"CASE WHEN {n} > 1e-4 THEN ln((0.85 * {n} + 0.05) / (0.10 * {n} + 0.02 + 1e-9) + 1e-9) ELSE 0.0 END"


_ODDS = f"({math.log(0.05 / (1 - 0.05 + 1e-9))!r}::DOUBLE + {_lr('urgency_score')} + {_lr('authority_score')} + {_lr('otp_score')})"
CTES["scam"] = f"""SELECT *, CASE WHEN p >= 0.75 THEN 'CRITICAL' WHEN p >= 0.5 THEN 'HIGH' WHEN p >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS scam_risk, p AS scam_probability FROM (
  SELECT *, CASE WHEN urgency_score = 0 AND authority_score = 0 AND otp_score = 0 THEN 0.0 ELSE {r(f'1 / (1 + exp(-{_ODDS}))')} END AS p FROM msg)"""


@query("v1_message_scores", "SELECT message_id, urgency_score, authority_score, otp_score FROM msg")
def v1(spark, d):
    return V.message_scores(T.messages(spark, d)).select("message_id", "urgency_score", "authority_score", "otp_score")


def _cells(signal: str, patterns, first: int = 1, when: str = "") -> list[str]:
    return [f"{{'signal': '{signal}', 'pattern': {i}, 't': {when}regexp_extract(text, {quoted(['(?i)' + p])}, 0){' END' if when else ''}}}"
            for i, p in enumerate(patterns, first)]


_EVIDENCE = ", ".join(_cells(K.MESSAGE_SIGNALS[0], K.URGENCY_PATTERNS) + _cells(K.MESSAGE_SIGNALS[1], K.AUTHORITY_PATTERNS)
                      + _cells(K.MESSAGE_SIGNALS[2], K.CODE_REQUEST_PATTERNS)
                      + _cells(K.MESSAGE_SIGNALS[2], [K.BARE_CODE_PATTERN], len(K.CODE_REQUEST_PATTERNS) + 1, "CASE WHEN u > 0 THEN "))
_LEGIT = "coalesce(regexp_matches(trim(sender_id), '(?i)" + K.REGISTERED_SENDER_PATTERN + "'), FALSE)"


@query("v1_message_evidence", f"""SELECT message_id, signal, CAST(pattern AS INTEGER) AS pattern, t AS matched_text, {r('s', 3)} AS confidence,
  CASE signal WHEN '{K.MESSAGE_SIGNALS[0]}' THEN CASE WHEN s > 0.6 THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN '{K.MESSAGE_SIGNALS[1]}' THEN CASE WHEN s > 0.6 THEN 'CRITICAL' ELSE 'HIGH' END ELSE 'CRITICAL' END AS severity
  FROM (SELECT message_id, x.signal AS signal, x.pattern AS pattern, x.t AS t,
    CASE x.signal WHEN '{K.MESSAGE_SIGNALS[0]}' THEN 1 - exp(-0.45 * u)
      WHEN '{K.MESSAGE_SIGNALS[1]}' THEN (1 - exp(-0.5 * a)) * CASE WHEN {_LEGIT} THEN 0.3 ELSE 1.0 END
      ELSE 1 - exp(-0.8 * (o0 + (bare AND u > 0)::INT)) END AS s
    FROM (SELECT message_id, sender_id, u, a, o0, bare, unnest([{_EVIDENCE}]) AS x FROM msg0)) WHERE t <> ''""")
def v1_evidence(spark, d):
    return V.message_evidence(T.messages(spark, d))


@query("v2_scam_probability", "SELECT message_id, scam_probability, scam_risk, scam_probability >= 0.5 AS is_scam_alert FROM scam")
def v2(spark, d):
    return V.scam_probability(V.message_scores(T.messages(spark, d))).select("message_id", "scam_probability", "scam_risk", "is_scam_alert")


CTES["worst_msg"] = """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scam_probability DESC, ts ASC NULLS FIRST, message_id) AS pick FROM scam) WHERE pick = 1"""


def worst(spark, d):
    return V.worst_message(V.scam_probability(V.message_scores(T.messages(spark, d, T.event_table(spark, d)))))


@query("t4_worst_of_batch", "SELECT user_id, message_id, scam_probability, scam_risk FROM worst_msg")
def t4(spark, d):
    return worst(spark, d)


# -------------------------------------------------------------------- graph

CTES["pairs"] = "SELECT src, dst, sum(amount) AS weight, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS transfers FROM edges GROUP BY 1, 2"


@query("g1_edge_build", f"""SELECT src, dst, event_type, count(*) AS n, {r('sum(amount)', 2)} AS amount FROM (
  SELECT src, dst, amount, 'upi' AS event_type FROM raw_edges UNION ALL SELECT dst, src, amount, 'ewb' FROM raw_edges) WHERE src <> dst GROUP BY ALL""")
def g1(spark, d):
    e = T.raw_edges(spark, d).drop("event_type")
    back = e.select(c("dst").alias("src"), c("src").alias("dst"), "amount", "ts")
    return G.build(e, back).groupBy("src", "dst", "event_type").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("amount"), 2).alias("amount"))


@query("g2_collapse", f"SELECT src, dst, {r('weight', 2)} AS weight, min_ts, max_ts, transfers FROM pairs")
def g2(spark, d):
    return T.pairs(spark, d).withColumn("weight", rnd("weight", 2))


def _rank_ctes(iters: int = 24) -> dict[str, str]:
    out = {"pr_step": "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM pairs",
           "pr_node": "SELECT DISTINCT node FROM (SELECT src AS node FROM pairs UNION ALL SELECT dst FROM pairs)",
           "pr_0": "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM pr_node) AS x FROM pr_node"}
    for i in range(1, iters + 1):
        out[f"pr_{i}"] = f"""SELECT n.node, 0.15 / (SELECT count(*) FROM pr_node) + 0.85 * (coalesce(f.x, 0) +
          (SELECT coalesce(sum(x), 0) FROM pr_{i - 1} WHERE node NOT IN (SELECT src FROM pr_step)) / (SELECT count(*) FROM pr_node)) AS x
          FROM pr_node n LEFT JOIN (SELECT s.dst AS node, sum(v.x * s.p) AS x FROM pr_step s JOIN pr_{i - 1} v ON v.node = s.src GROUP BY 1) f USING (node)"""
    return out


CTES.update(_rank_ctes())
CTES["ranked"] = "SELECT node, round(x, 6) AS pagerank FROM pr_24"
HUB = 0.042


def ranks(spark, d):
    return G.pagerank(T.pairs(spark, d), tol=1e-8).withColumn("pagerank", F.round("pagerank", 6))


def maturity(spark, d):
    return T.profiles(spark, d).groupBy("node").agg(F.min("months_active").alias("months_active"))


CTES["hubs"] = f"""SELECT r.node, r.pagerank, m.months_active, r.pagerank >= {HUB} AND m.months_active <= 6 AS is_shell_hub FROM ranked r
  JOIN (SELECT node, min(months_active) AS months_active FROM profiles GROUP BY node) m USING (node)"""


@query("g3_pagerank", "SELECT node, pagerank, is_shell_hub FROM hubs")
def g3(spark, d):
    """Ranks of 25 near-equal regions lie around 1/25, so the hub mark is set to their scale."""
    return G.shell_hubs(ranks(spark, d), maturity(spark, d), rank=HUB).select("node", "pagerank", "is_shell_hub")


CTES["acct"] = """SELECT DISTINCT src, dst FROM (SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'S' || l_suppkey, 'C' || o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R')"""


@query("g4_strong_components", """SELECT node, component, size FROM (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (
  SELECT a.src AS node, max(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)) WHERE size >= 3""",
       reach="/*RECURSIVE*/SELECT src, dst FROM acct UNION SELECT r.src, e.dst FROM reach r JOIN acct e ON r.dst = e.src")
def g4(spark, d):
    return G.strong_components(T.account_edges(spark, d))


def _cycle_sql(src: str, n: int) -> str:
    froms = ", ".join(f"{src} e{i}" for i in range(1, n + 1))
    links = [f"e{i}.dst = e{i + 1}.src" for i in range(1, n)] + [f"e{n}.dst = e1.src"]
    least = [f"e1.src < e{i}.src" for i in range(2, n + 1)]
    apart = [f"e{i}.src <> e{j}.src" for i in range(2, n + 1) for j in range(i + 1, n + 1)]
    nodes = "[" + ", ".join(f"e{i}.src" for i in range(1, n + 1)) + "]"
    breaks = " + ".join(f"CASE WHEN e{i % n + 1}.min_ts > e{i}.max_ts THEN 0 ELSE 1 END" for i in range(1, n + 1))
    mono = f"({breaks}) <= 1"
    flow = " + ".join(f"e{i}.weight" for i in range(1, n + 1))
    lo = "least(" + ", ".join(f"e{i}.min_ts" for i in range(1, n + 1)) + ")"
    hi = "greatest(" + ", ".join(f"e{i}.max_ts" for i in range(1, n + 1)) + ")"
    days = f"greatest(1.0::DOUBLE, (epoch_us({hi}) - epoch_us({lo})) / 86400000000.0::DOUBLE)"
    return (f"SELECT array_to_string({nodes}, '>') AS cycle, array_to_string(list_sort({nodes}), ',') AS members, {nodes} AS nodes, {n} AS length, "
            f"{mono} AS temporal_ok, {r(flow, 2)} AS total_flow, {r(f'({flow}) / {days}', 2)} AS velocity FROM {froms} WHERE {' AND '.join(links + least + apart)}")


# ------------------------------------------------- rings of accounts

CTES["upi_moves"] = "SELECT event_id, user_id AS src, p.c_custkey AS dst, abs(amount) AS amount, ts FROM ev JOIN customer p ON event_id % 150 = p.c_custkey WHERE source_provenance = 'upi_api'"
CTES["apairs"] = "SELECT src, dst, sum(amount) AS weight, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS transfers FROM upi_moves WHERE src <> dst GROUP BY 1, 2"
CTES["areach"] = "/*RECURSIVE*/SELECT src, dst FROM apairs UNION SELECT r.src, e.dst FROM areach r JOIN apairs e ON r.dst = e.src"
CTES["acomp"] = """SELECT node, component, size FROM (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (
  SELECT a.src AS node, max(a.dst) AS component FROM areach a JOIN areach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)) WHERE size >= 3"""
CTES["rpairs"] = """SELECT src, dst, weight, min_ts, max_ts FROM apairs JOIN acomp a ON a.node = src JOIN acomp b ON b.node = dst WHERE a.component = b.component"""
RING_LENGTHS = (2, 3, 4, 5)
_ALL_CYCLES = " UNION ALL ".join(_cycle_sql("rpairs", n) for n in RING_LENGTHS)
CTES["ring_n"] = _ALL_CYCLES
CTES["ring"] = f"SELECT *, temporal_ok AND velocity > {G.SUSPICIOUS_PER_DAY} AS suspicious FROM ring_n"


def members(spark, d):
    """Components of at least three accounts."""
    return T.stored(spark, d, "account_components", lambda s, p: G.strong_components(T.account_pairs(s, p)))


@query("g5_cycles", "SELECT cycle, length FROM ring_n")
def g5(spark, d):
    found = G.cycles(T.account_pairs(spark, d), RING_LENGTHS, members=members(spark, d))
    return found.select(F.array_join(c("nodes").cast("array<string>"), ">").alias("cycle"), "length")


def ring(spark, d):
    m = G.cycle_metrics(G.cycles(T.account_pairs(spark, d), RING_LENGTHS, members=members(spark, d)))
    return m.withColumn("cycle", F.array_join(c("nodes").cast("array<string>"), ">"))


@query("g6_temporal_order", "SELECT cycle, temporal_ok FROM ring")
def g6(spark, d):
    return ring(spark, d).select("cycle", "temporal_ok")


@query("g7_cycle_metrics", """SELECT cycle, total_flow, velocity, suspicious, count(*) OVER (PARTITION BY members) AS recurrence FROM ring WHERE temporal_ok""")
def g7(spark, d):
    return G.recurrence(ring(spark, d).where("temporal_ok")).select("cycle", "total_flow", "velocity", "suspicious", "recurrence")


# ranks of accounts: of 150 that are paid, each has about 1/176 on average
ACCOUNT_HUB = 0.008
CTES["a_step"] = "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM apairs"
CTES["a_node"] = "SELECT node, count(*) OVER () AS n FROM (SELECT src AS node FROM apairs UNION SELECT dst FROM apairs)"
CTES["a_walk"] = """/*RECURSIVE*/SELECT node, 1.0::DOUBLE / n AS x, 0 AS i FROM a_node UNION ALL SELECT node, sum(x), max(i) FROM (
  SELECT s.dst AS node, 0.85 * w.x * s.p AS x, w.i + 1 AS i FROM a_walk w JOIN a_step s ON s.src = w.node WHERE w.i < 110
  UNION ALL SELECT a.node, 0.15 / a.n, w.i + 1 FROM a_walk w JOIN a_node a ON a.node = w.node WHERE w.i < 110) GROUP BY node"""
CTES["aranked"] = "SELECT node, round(x / sum(x) OVER (), 6) AS pagerank FROM a_walk WHERE i = 110"
CTES["ahubs"] = f"""SELECT r.node, r.pagerank, coalesce(p.months_active, 24) AS months_active, r.pagerank >= {ACCOUNT_HUB} AND coalesce(p.months_active, 24) <= 6 AS is_shell_hub
  FROM aranked r LEFT JOIN profiles p ON p.user_id = r.node"""


def account_ranks(spark, d):
    return T.stored(spark, d, "account_ranks", lambda s, p: G.pagerank(T.account_pairs(s, p), tol=1e-8).withColumn("pagerank", F.round("pagerank", 6)))


CTES["ring_all"] = "SELECT count(*) AS n, count(*) FILTER (suspicious) AS s FROM ring WHERE temporal_ok"
CTES["ring_member"] = "SELECT node, count(*) AS cycles FROM (SELECT unnest(nodes) AS node FROM ring WHERE temporal_ok) GROUP BY node"
CTES["verdict"] = f"""SELECT node, in_ring, cycles, conf AS fraud_confidence, scc_size, conf >= 0.5 OR (in_ring AND s > 0) AS fraud_ring_flag,
  concat_ws(';', CASE WHEN s > 0 THEN 'suspicious_cycles=' || s END, CASE WHEN is_shell_hub THEN 'shell_hub' END, CASE WHEN in_ring THEN 'in_ring' END) AS evidence,
  CASE WHEN conf >= 0.7 THEN 'CRITICAL' WHEN conf >= 0.45 THEN 'HIGH' WHEN conf >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS ring_risk FROM (
  SELECT h.node, m.cycles IS NOT NULL AS in_ring, coalesce(m.cycles, 0) AS cycles, a.s, is_shell_hub, (SELECT coalesce(max(size), 0) FROM acomp) AS scc_size,
    {r("""CASE WHEN a.n > 0 THEN least(1.0::DOUBLE, a.s / a.n + CASE WHEN is_shell_hub THEN 0.3 ELSE 0 END
    + CASE WHEN m.cycles IS NOT NULL THEN 0.2 ELSE 0 END) ELSE CASE WHEN is_shell_hub THEN 0.1 ELSE 0.0 END END""")} AS conf
  FROM ahubs h LEFT JOIN ring_member m USING (node) CROSS JOIN ring_all a)"""
VERDICT = ["node", "in_ring", "cycles", "fraud_confidence", "scc_size", "evidence", "fraud_ring_flag", "ring_risk"]


def verdicts(spark, d):
    """Ring verdict of every account that pays or is paid."""
    maturity_of = T.profiles(spark, d).select(c("user_id").alias("node"), "months_active")
    hubs = G.shell_hubs(account_ranks(spark, d), maturity_of, rank=ACCOUNT_HUB)
    return T.stored(spark, d, "verdicts", lambda s, p: G.verdicts(hubs, ring(s, p), members(s, p)))


@query("g8_ring_verdicts", f"SELECT {', '.join(VERDICT)} FROM verdict")
def g8(spark, d):
    return verdicts(spark, d).select(*VERDICT)




def moves(spark, d):
    return T.transfers(spark, d)


@query("g9_ego_network", """SELECT event_id, src, dst, amount FROM upi_moves WHERE src <> dst AND (src IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  OR dst IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def g9(spark, d):
    """Every edge in or out of the overdrawn accounts."""
    centre = T.table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    m = moves(spark, d)
    hit = (m.join(centre.select(c("c_custkey").alias("src"), F.lit(True).alias("a")), "src", "left")
           .join(centre.select(c("c_custkey").alias("dst"), F.lit(True).alias("b")), "dst", "left"))
    return G.ego_network(hit, F.coalesce("a", "b", F.lit(False))).select("event_id", "src", "dst", "amount")


@query("g9_ring_graph", f"""SELECT a, b, amount FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, amount,
  row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts, event_id) AS rn FROM upi_moves WHERE src <> dst
    AND src IN (SELECT c_custkey FROM customer WHERE c_custkey % 36 <= 6)) WHERE rn = 1""")
def g9_ring(spark, d):
    """First edge of each pair with a young account paying."""
    young = T.profiles(spark, d).where("months_active <= 6")
    m = J.of_users(moves(spark, d).withColumnRenamed("src", "user_id"), young).withColumnRenamed("user_id", "src").where("src <> dst")
    return G.undirected(m.select("event_id", "src", "dst", "amount", "ts"), [c("ts"), c("event_id")]).select("a", "b", "amount")


@query("t8_undirected_edges", """SELECT a, b, event_id FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, event_id,
  row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts, event_id) AS rn FROM upi_moves WHERE src <> dst) WHERE rn = 1""")
def t8(spark, d):
    return G.undirected(moves(spark, d).where("src <> dst"), [c("ts"), c("event_id")]).select("a", "b", "event_id")


# ------------------------------------------------------------ mules, stress

CTES["aflow"] = FLOW_SQL.replace("FROM edges", "FROM (SELECT * FROM upi_moves WHERE src <> dst)")
CTES["regular"] = f"""SELECT user_id, CASE WHEN ok THEN {r('sd / (mean + 1e-9)')} < 0.05 ELSE FALSE END AS regular_flag FROM (
  SELECT user_id, avg(g) AS mean, stddev_samp(g) AS sd, count(*) >= 5 AND max(g) > 0 AS ok FROM (
    SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS g FROM ev) GROUP BY user_id)"""
_MULE = r("""least(1.0::DOUBLE, CASE WHEN daily_avg_throughput_30d > 200000 THEN least((daily_avg_throughput_30d - 200000) / 200000.0, 1.0) * 0.4 ELSE 0.0 END
  + CASE WHEN discretionary_ratio <= 0.02 THEN 0.35 ELSE 0.0 END + CASE WHEN cash_buffer_days < 2 THEN 0.15 ELSE 0.0 END + CASE WHEN debit_failure_rate_90d < 0.01 THEN 0.10 ELSE 0.0 END)""")
_HUB = r("""CASE WHEN coalesce(total_outflow, 0) = 0 THEN 0.0 ELSE CASE WHEN top_receiver_share >= 0.8 THEN 0.6::DOUBLE ELSE 0.0 END
  + CASE WHEN inflow_sources > 5 AND top_receiver_share > 0.6 THEN 0.25 ELSE 0.0 END + CASE WHEN pagerank >= 0.10 THEN 0.15 ELSE 0.0 END END""")
CTES["bot"] = f"""SELECT *, CASE WHEN consistency_score >= 0.7 THEN 'CRITICAL' WHEN consistency_score >= 0.45 THEN 'HIGH' WHEN consistency_score >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS bot_risk,
  regular_flag AND consistency_score > 0.5 AS is_bot, mule_score > 0.6 OR (hub_score > 0.5 AND mule_score > 0.35) AS is_mule FROM (
  SELECT *, {r('least(1.0::DOUBLE, CASE WHEN regular_flag THEN 0.8 ELSE 0 END * 0.35 + hub_score * 0.40 + mule_score * 0.25)')} AS consistency_score FROM (
    SELECT f.user_id, coalesce(g.regular_flag, FALSE) AS regular_flag, {_MULE} AS mule_score, {_HUB} AS hub_score FROM fv f
    LEFT JOIN regular g USING (user_id) LEFT JOIN aflow ON aflow.node = f.user_id LEFT JOIN aranked k ON k.node = f.user_id))"""
BOT = ["mule_score", "hub_score", "consistency_score", "is_bot", "is_mule", "bot_risk"]


def bots(spark, d):
    """Users without gaps or transfers score as if these were zero; the hub part is the user's own account's."""
    reg = O.interval_regularity(T.event_table(spark, d)).select("user_id", "regular_flag")
    flow = TL.flow_concentration(T.transfers(spark, d).where("src <> dst")).withColumnRenamed("node", "user_id")
    j = (T.feature_table(spark, d).join(reg, "user_id", "left").join(flow, "user_id", "left")
         .join(account_ranks(spark, d).withColumnRenamed("node", "user_id"), "user_id", "left"))
    zero = {n: 0 for n in ("total_outflow", "top_receiver_share", "inflow_sources", "pagerank")}
    return V.bot_scores(j.fillna({"regular_flag": False, **zero}))


@query("v3_mule_scores", f"SELECT user_id, {', '.join(BOT)} FROM bot")
def v3(spark, d):
    return bots(spark, d).select("user_id", *BOT)


_STRESS = """-4.5 + 3.5 * least(debit_failure_rate_90d / 0.5, 1.0) + 2.8 * greatest(0.0, 1 - cash_buffer_days / 90.0) + 1.5 * least(abs(end_of_month_liquidity_dip) / 50000.0, 1.0)
  + 2.2 * least(emi_burden_ratio / 0.8, 1.0) + 1.0 * least(spending_volatility_index / 2.0, 1.0) + 2.5 * greatest(0.0, 1 - income_stability_score)"""
CTES["stressed"] = f"""SELECT *, CASE WHEN stress_score >= 0.70 THEN 'CRITICAL' WHEN stress_score >= 0.45 THEN 'HIGH' WHEN stress_score >= 0.20 THEN 'MEDIUM' ELSE 'LOW' END AS stress_risk FROM (
  SELECT user_id, {r(f'1 / (1 + exp(-({_STRESS})))')} AS stress_score, debit_failure_rate_90d > 0.10 AND abs(end_of_month_liquidity_dip) > 10000 AS velocity_spike,
    CASE WHEN cash_buffer_days < 5 THEN 'critical' WHEN cash_buffer_days < 10 THEN 'declining' WHEN cash_buffer_days < 20 THEN 'stable' ELSE 'improving' END AS buffer_trend,
    CASE WHEN debit_failure_rate_90d > 0.15 THEN 'critical' WHEN debit_failure_rate_90d > 0.07 THEN 'declining' ELSE 'stable' END AS failure_trend FROM fv)"""
STRESS = ["stress_score", "velocity_spike", "buffer_trend", "failure_trend", "stress_risk"]


@query("v4_stress", f"SELECT user_id, {', '.join(STRESS)} FROM stressed")
def v4(spark, d):
    return V.stress(T.feature_table(spark, d)).select("user_id", *STRESS)


CTES["under"] = f"""SELECT *, CASE WHEN s >= 0.80 THEN 'CRITICAL' WHEN s >= 0.65 THEN 'HIGH' WHEN s >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS underreport_risk,
  s AS underreport_score, s >= 0.65 AS is_underreporting FROM (SELECT *, {r('1 / (1 + exp(-greatest(-700.0, least(700.0, z))))')} AS s, {r('z')} AS income_z FROM (
  SELECT *, (seen - declared) / (CASE WHEN cstd > 100 THEN cstd ELSE greatest(declared * 0.3, 1000.0) END + 1e-9) AS z, {r('seen', 2)} AS observed_income FROM (
    SELECT f.user_id, greatest(f.income_90d / 3.0 * (1 - least(f.cash_dependency_index * 1.5, 0.9)), 0.0) AS seen, k.cstd,
      CASE WHEN dc.declared_income > 0 THEN dc.declared_income WHEN f.income_90d > 0 THEN f.income_90d / 3.0 WHEN k.cmean <> 0 THEN k.cmean ELSE 1.0 END AS declared
    FROM fv f LEFT JOIN (SELECT c_custkey AS user_id, c_acctbal AS declared_income FROM customer) dc USING (user_id)
    JOIN (SELECT income_band, {r('avg(income_90d / 3.0)', 2)} AS cmean, {r('coalesce(stddev_samp(income_90d / 3.0), 0.0)', 2)} AS cstd FROM fv GROUP BY 1) k USING (income_band))))"""
UNDER = ["observed_income", "income_z", "underreport_score", "is_underreporting", "underreport_risk"]


def under(spark, d):
    f = T.feature_table(spark, d)
    k = f.groupBy("income_band").agg(rnd(F.avg(c("income_90d") / 3.0), 2).alias("cohort_mean_income"),
                                     rnd(F.coalesce(F.stddev_samp(c("income_90d") / 3.0), F.lit(0.0)), 2).alias("cohort_std_income"))
    dec = T.table(spark, d, "customer").select(c("c_custkey").alias("user_id"), c("c_acctbal").alias("declared_income"))
    # without a declared income the 90-day income stands for it
    f = f.join(dec, "user_id", "left").withColumn(
        "declared_income", F.when(c("declared_income") > 0, c("declared_income")).otherwise(c("income_90d") / 3.0))
    return V.underreporting(f.join(F.broadcast(k), "income_band"))      # three bands


@query("v5_underreporting", f"SELECT user_id, {', '.join(UNDER)} FROM under")
def v5(spark, d):
    return under(spark, d).select("user_id", *UNDER)


def _kl(a: str, m: str) -> str:
    return f"CASE WHEN {a} > 1e-10 AND {m} > 1e-10 THEN {a} * ln({a} / {m}) ELSE 0.0 END"


CTES["mixes"] = """SELECT user_id, cat, coalesce(x30 / nullif(sum(x30) OVER (PARTITION BY user_id), 0), 0.0) AS p, coalesce(x90 / nullif(sum(x90) OVER (PARTITION BY user_id), 0), 0.0) AS q FROM (
  SELECT user_id, merchant_category AS cat, coalesce(sum(-amount) FILTER (ts >= TIMESTAMP '2024-01-16'), 0.0) AS x30, sum(-amount) AS x90 FROM ev WHERE amount < 0 GROUP BY 1, 2)"""
CTES["js"] = f"SELECT user_id, {r(f'''least(1.0::DOUBLE, sum(0.5 * {_kl('p', '((p + q) / 2)')} + 0.5 * {_kl('q', '((p + q) / 2)')}) / ln(2))''')} AS js_divergence FROM mixes GROUP BY user_id"
CTES["shifted"] = f"""SELECT *, CASE WHEN identity_score >= 0.70 THEN 'CRITICAL' WHEN identity_score >= 0.45 THEN 'HIGH' WHEN identity_score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS identity_risk,
  identity_score >= 0.45 AS is_shifted FROM (SELECT user_id, js_divergence, {r('js_divergence * 0.5 + change * 0.5')} AS drift_score,
    {r('least(1.0::DOUBLE, js_divergence * 0.45 + change * 0.30 + least(abs(lifestyle_inflation_trend), 1.0) * 0.25)')} AS identity_score FROM (
    SELECT f.*, coalesce(j.js_divergence, {r('least(f.merchant_category_shift_count / 10.0, 1.0)')}) AS js_divergence, least(1.0::DOUBLE, abs(discretionary_30d - discretionary_90d) / greatest(discretionary_90d, 1.0)) AS change FROM fv f LEFT JOIN js j USING (user_id)))"""
SHIFT = ["js_divergence", "drift_score", "identity_score", "is_shifted", "identity_risk"]


def shift(spark, d):
    """The recent half of the month against all of it."""
    from datetime import datetime
    e = T.event_table(spark, d)
    ref = datetime(2024, 2, 15)           # 30 days back is 16 January, 90 days back is before the first event
    return V.identity_shift(T.feature_table(spark, d).join(FT.spend_mix(e, ref, K.CATEGORIES), "user_id", "left"), K.CATEGORIES)


@query("v6_identity_shift", f"SELECT user_id, {', '.join(SHIFT)} FROM shifted")
def v6(spark, d):
    return shift(spark, d).select("user_id", *SHIFT)


_RANK = lambda n: f"CASE {n} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
CTES["vigil"] = f"""SELECT user_id, {r('least(1.0::DOUBLE, coalesce(fraud_confidence, 0) * 0.30 + coalesce(scam_probability, 0) * 0.20 + consistency_score * 0.20 + stress_score * 0.10 + underreport_score * 0.10 + identity_score * 0.10)')} AS deception_score,
  list_extract(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], 1 + greatest({', '.join(_RANK(n) for n in ('ring_risk', 'scam_risk', 'bot_risk', 'stress_risk', 'underreport_risk', 'identity_risk'))})) AS overall_risk,
  coalesce(fraud_ring_flag, FALSE) AS fraud_ring_flag, coalesce(fraud_confidence, 0.0) AS fraud_confidence, coalesce(scam_probability, 0.0) AS scam_probability
  FROM bot LEFT JOIN verdict ON verdict.node = bot.user_id JOIN stressed USING (user_id) JOIN under USING (user_id) JOIN shifted USING (user_id)
  LEFT JOIN worst_msg w USING (user_id)"""


def vigil(spark, d):
    """All users with features, whether they have a profile, transfers or messages or not."""
    j = (bots(spark, d).select("user_id", "consistency_score", "bot_risk")
         .join(verdicts(spark, d).withColumnRenamed("node", "user_id"), "user_id", "left")
         .fillna({"fraud_confidence": 0.0, "fraud_ring_flag": False})
         .join(V.stress(T.feature_table(spark, d)).select("user_id", "stress_score", "stress_risk"), "user_id")
         .join(under(spark, d).select("user_id", "underreport_score", "underreport_risk"), "user_id")
         .join(shift(spark, d).select("user_id", "identity_score", "identity_risk"), "user_id")
         .join(worst(spark, d), "user_id", "left"))
    return V.deception(j).withColumn("scam_probability", F.coalesce("scam_probability", F.lit(0.0)))


@query("v7_deception", "SELECT user_id, deception_score, overall_risk FROM vigil")
def v7(spark, d):
    return vigil(spark, d).select("user_id", "deception_score", "overall_risk")


@query("t5_worst_level", f"SELECT user_id, list_extract(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], 1 + greatest({_RANK('stress_risk')}, {_RANK('identity_risk')})) AS worst FROM stressed JOIN shifted USING (user_id)")
def t5(spark, d):
    s = V.stress(T.feature_table(spark, d)).select("user_id", "stress_risk")
    return shift(spark, d).join(s, "user_id").select("user_id", V.worst(c("stress_risk"), c("identity_risk")).alias("worst"))


@query("st10_vigilance_events", """SELECT user_id, 'vigilance_completed' AS event, deception_score AS score FROM vigil
  UNION ALL SELECT user_id, 'fraud_ring_flagged', fraud_confidence FROM vigil WHERE fraud_ring_flag UNION ALL SELECT user_id, 'scam_alert', scam_probability FROM vigil WHERE scam_probability >= 0.5""")
def st10(spark, d):
    return V.vigilance_events(vigil(spark, d))
