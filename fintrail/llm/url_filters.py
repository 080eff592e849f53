"""Block and allow rules for URLs by hashed host-suffix and path-prefix expressions (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX_HEX = 8                 # hex digits of the digest that the join compares first
BROADCAST_RULES = 100_000      # rules are copied to the executors only up to this checked count

OUT = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """Text between the first `://` and the next `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column, labels: Column, chars: Column) -> Column:
    """The last `labels` labels of the host and the first `chars` characters of the path."""
    parts = F.split(host, "\\.")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")
    return F.concat(tail, F.lit("\n"), F.substring(path, F.lit(1), chars))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Digest, digest prefix, shape and rank of each rule (columns action, host, path).

    Rows with a null are no rules. Of rules with the same host and path, `block` counts.
    """
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    r = (rules.select("action", lower.alias("host"), "path").where("action is not null and host is not null and path is not null")
         .groupBy("host", "path").agg(F.max("action").alias("action")))
    d = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    return r.select(
        F.concat("host", "path").alias("rule"), F.col("action").alias("verdict"),
        F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars"),
        d.alias("digest"), F.substring(d, 1, PREFIX_HEX).alias("short"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"),
                 F.concat("host", "path").alias("r"), F.col("action").alias("a")).alias("rank"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judges every row of `pages` by its URL; all rows and columns stay.

    Adds host, path, rule (null if none fits) and verdict (`default` if none fits). A rule fits its host and all
    subdomains if the path starts with the rule's; of several that fit, the longest wins, then the one with the
    longer host. Input columns of these names are replaced. A null URL or one without `://` has an empty host and
    path and fits no rule. Repeated URLs are judged once; an empty table gives an empty result.

    Only the (labels, path length) shapes that some rule has are expanded, so very long hosts and paths cost as
    little as others. The shapes are collected: there are at most as many as rules, and few in practice.
    """
    kept = [c for c in pages.columns if c.lower() not in OUT]
    # the row travels as one column, so that none of its names meets one of ours
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).alias("none"))
    own = [F.col("row").getField(c).alias(c) for c in kept]
    judged = pages.select(row.alias("row"),
                          host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    compiled = compile_rules(rules)
    shapes = [(r.labels, r.chars) for r in compiled.select("labels", "chars").distinct().collect()]
    if not shapes:
        return judged.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = judged.select("host", "path").where("host != ''").distinct()
    fits = lambda s: (F.size(F.split("host", "\\.")) >= s["labels"]) & (F.length("path") >= s["chars"])
    all_shapes = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in sorted(shapes)])
    exprs = (urls.select("host", "path", F.explode(F.filter(all_shapes, fits)).alias("s"))
             .select("host", "path", F.sha2(_expression(F.col("host"), F.col("path"), F.col("s.labels"), F.col("s.chars")), 256).alias("full"))
             .withColumn("short", F.substring("full", 1, PREFIX_HEX)))
    small = compiled.select("short", "digest", "rank")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        small = F.broadcast(small)
    best = (exprs.join(small, "short").where(F.col("full") == F.col("digest"))
            .groupBy("host", "path").agg(F.max("rank").alias("rank")))
    return (judged.join(best, ["host", "path"], "left")
            .select(*own, "host", "path", F.col("rank.r").alias("rule"),
                    F.coalesce("rank.a", F.lit(default)).alias("verdict")))
