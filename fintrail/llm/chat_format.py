"""Chat conversations as budgeted, turn-aligned training windows with a loss mask (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from fintrail.llm.common import stored

BUDGET = 512                   # tokens of a window: a quarter for the system turn, a quarter for history, half for targets
HISTORY_TURNS = 2              # turns repeated before the targets of a window, if they fit their quarter
TURNS_PER_PART = 128           # turn numbers that are ordered together
# fixed values: the control strings of the template
BEGIN, ROLE_BEGIN, ROLE_END, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Puts a backslash into every control string, and one more into those that have some: no control string is left."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def turn_tokens(role: Column, text: Column) -> Column:
    """Words and the four control strings: the count that the budget is held against."""
    return (F.regexp_count(role, F.lit(r"\S+")) + F.regexp_count(text, F.lit(r"\S+")) + 4).cast("long")


def _part(turn: Column) -> Column:
    return F.floor(F.coalesce(turn, F.lit(-1)) / TURNS_PER_PART)


def placed_turns(conversations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Turns with their position in the conversation (from 0) and the window whose target they are.

    Prefix sums of tokens are taken in two steps, inside runs of turn numbers and over the runs' totals, so a
    conversation of any length is ordered by many tasks. A turn of more than a quarter of the budget has a window of
    its own; others share the window into whose stretch (a quarter of the budget) of the prefix sum they begin, so
    their total stays under half of it.
    """
    stretch = budget // 4
    t = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumns({"part": _part(F.col("turn")), "tokens": turn_tokens(F.col("role"), F.col("text"))})
    large = F.col("tokens") > stretch
    t = t.withColumns({"large": large.cast("long"), "small": F.when(large, 0).otherwise(F.col("tokens"))})
    inside = W.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"no": F.row_number().over(inside), "larges": F.sum("large").over(upto), "smalls": F.sum("small").over(upto)})
    totals = t.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("large").alias("l"), F.sum("small").alias("s"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"),
                           *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("n", "l", "s")])
    t = t.join(totals, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    begins = F.col("before_s") + F.col("smalls") - F.col("small")
    pos = F.col("before_n") + F.col("no") - 1
    is_system = (pos == 0) & (F.col("role") == "system")
    return t.select("conv_id", pos.alias("pos"), "role", "text", "tokens", is_system.alias("is_system"),
                    F.struct((F.col("before_l") + F.col("larges")).alias("larges"), F.col("large"),
                             F.when(F.col("large") == 1, 0).otherwise(F.floor(begins / stretch)).alias("stretch")).alias("span"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, first_pos (orders the windows), n_repeated, formatted, loss_spans.

    Every turn is the target of one window. Every window holds the system turn (the first turn, if its role is system),
    then up to `history` earlier turns that fit a quarter of the budget, then its targets; the repeated turns come
    first and are counted in n_repeated. loss_spans are (start, length) in code points of `formatted` and cover the
    text of each assistant target, not that of repeated turns.

    Turns are ordered by (turn, role, text), null turns first; null roles and texts are empty text; repeated rows are
    turns of their own; a null conv_id is one conversation. Other columns are left out. An empty table gives none.
    """
    turns = stored(placed_turns(conversations, budget), "turns")     # five branches below read it
    key = ["conv_id", "span"]
    body = turns.where(~F.col("is_system"))
    firsts = body.groupBy(*key).agg(F.min("pos").alias("first_pos"))
    turn = F.struct("pos", "role", "text", "tokens")
    # the turns just before each window's first, by their exact position: no conversation is joined with itself
    wanted = firsts.select("conv_id", "span", F.explode(F.sequence(F.col("first_pos") - history, F.col("first_pos") - 1)).alias("pos")) \
        .where("pos >= 0") if history else None
    own = body.select(*key, F.lit(1).alias("target"), turn.alias("t"))
    system = turns.where("is_system").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"),
                                             F.col("text").alias("_t"), F.col("tokens").alias("_k"))
    # in the first window it is not a repeated turn
    led = firsts.join(system, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        *key, F.when(F.col("first_pos") == 1, 1).otherwise(0).alias("target"), F.struct(F.lit(0).cast("long").alias("pos"), F.col("_r").alias("role"),
                                                 F.col("_t").alias("text"), F.col("_k").alias("tokens")).alias("t"))
    # a conversation that is a system turn alone still has a window
    alone = (turns.where("is_system").join(firsts.select(F.col("conv_id").alias("_f")).distinct(),
                                           F.col("conv_id").eqNullSafe(F.col("_f")), "left_anti")
             .select(*key, F.lit(1).alias("target"), turn.alias("t")))
    parts = own.unionByName(led).unionByName(alone)
    if history:
        b = body.select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), turn.alias("t"))
        parts = parts.unionByName(wanted.join(b, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p")))
                                  .select(*key, F.lit(2).alias("target"), "t"))
    # 0 the system turn, 1 a target, 2 history
    g = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("t.pos").alias("pos"), "target",
                                                                     F.col("t.role").alias("role"), F.col("t.text").alias("text"),
                                                                     F.col("t.tokens").alias("tokens")))).alias("all"))
    older = F.reverse(F.filter("all", lambda x: x["target"] == 2))
    # newest first, as long as the running total fits
    fitting = F.aggregate(older, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")),
                          lambda a, x: F.struct((a["sum"] + x["tokens"]).alias("sum"),
                                                F.when(a["sum"] + x["tokens"] <= budget // 4, a["n"] + 1).otherwise(a["n"]).alias("n")))
    g = g.withColumns({"sys": F.filter("all", lambda x: x["target"] == 0), "own": F.filter("all", lambda x: x["target"] == 1),
                       "old": F.reverse(F.slice(older, F.lit(1), fitting["n"]))})
    seq = F.concat("sys", "old", "own")
    block = lambda x: F.concat(F.lit(BEGIN + ROLE_BEGIN), escape(x["role"]), F.lit(ROLE_END), escape(x["text"]), F.lit(END))
    g = g.select("conv_id", F.element_at("own", 1)["pos"].alias("first_pos"),
                 (F.size("sys") + F.size("old")).alias("n_repeated"), seq.alias("seq"))
    g = g.withColumn("blocks", F.transform("seq", block))
    spans = F.aggregate(
        F.arrays_zip("seq", "blocks"),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda a, z: F.struct(
            (a["at"] + F.length(z["blocks"])).alias("at"),
            F.when((z["seq"]["role"] == "assistant") & (z["seq"]["target"] == 1),
                   F.concat(a["spans"], F.array(F.struct(
                       (a["at"] + F.length(z["blocks"]) - len(END) - F.length(escape(z["seq"]["text"]))).alias("start"),
                       F.length(escape(z["seq"]["text"])).alias("length"))))).otherwise(a["spans"]).alias("spans")))
    return g.select("conv_id", "first_pos", "n_repeated", F.array_join("blocks", "").alias("formatted"),
                    spans["spans"].alias("loss_spans"))


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """Turns (role, text) of each window's targets and the text under its mask, taken from the formatted text alone."""
    pieces = F.split("formatted", END.replace("/", "\\/"))
    w = formatted_windows.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    w = w.withColumn("own", F.slice("pieces", F.col("n_repeated") + 1, F.greatest(F.size("pieces") - F.col("n_repeated"), F.lit(0))))

    def turn(p: Column) -> Column:
        at = F.instr(p, ROLE_END)
        head = len(BEGIN + ROLE_BEGIN)
        return F.struct(unescape(F.substring(p, F.lit(head + 1), at - 1 - head)).alias("role"),
                        unescape(F.substring(p, at + len(ROLE_END), F.length(p))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return w.select("conv_id", "first_pos", F.length("formatted").alias("chars"), F.transform("own", turn).alias("turns"),
                    F.array_join(masked, "").alias("masked"))


def digests(formatted_windows: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the windows.

    A digest needs its conversation's text in one row, so this check, unlike the windows, is bounded by the longest
    conversation.
    """
    r = read_back(formatted_windows)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    r = r.select("conv_id", "first_pos", "chars", "masked", F.size("turns").alias("n"), listed.alias("listed"))
    g = r.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum(F.length("masked")).cast("long").alias("loss_chars"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("first_pos", "listed", "masked"))).alias("ws"))
    return g.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("ws.listed"), ""), 256).alias("turns_sha256"), "loss_chars",
                    F.sha2(F.array_join(F.col("ws.masked"), ""), 256).alias("loss_sha256"), "formatted_chars")
