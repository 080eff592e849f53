"""URL filters, chat formatting and sharding: brute force, round trips, odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fintrail.llm import chat_format as C, sharding as S, url_filters as U
from tests.llm import brute

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
         ("block", "b.example.net", "/en/x"), ("allow", "x.org", ""), ("block", None, "/")]
URLS = ["http://a.example.net/en/x?y#z", "https://EXAMPLE.net/de/", "http://net/", "http://net", "http://example.com/de/a", "http://badexample.com/de/a",
        "http://a.b.example.net/en/xyz", "x.org/a", "ftp://y.x.org", "http://org/fr/", "http://org/fr", "http:///fr/", "", None, "http://u:p@a.net:80/",
        "http://a.net?x=/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "a://b.net/c://d.org/fr/", "http://a.net\n/x"]


def verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = lambda t, stops: next((t[:i] for i, c in enumerate(t) if c in stops), t)
    host = cut(rest, "/?#")
    path = cut(rest[len(host):], "?#")
    host = host.translate(brute.LOWER)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "old", "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id int, url string, rule string, full string")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = {r.page_id: r for r in U.filter_urls(pages, rules).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[0]]):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == verdict(u), u
        assert got[i]["full"] == "x"
    assert U.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filters_with_names_of_their_own(spark):
    names = ["rank", "short", "digest", "full", "row", "s", "labels", "chars", "action", "n", "Host", "verdict"]
    pages = spark.createDataFrame([(i, u, *[f"{n}{i}" for n in names]) for i, u in enumerate(URLS)],
                                  "page_id int, url string, " + ", ".join(f"{n} string" for n in names))
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    out = U.filter_urls(pages, rules)
    assert out.columns == ["page_id", "url", *names[:-2], "host", "path", "rule", "verdict"]
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(r["url"])
        assert all(r[n] == f"{n}{r['page_id']}" for n in names[:-2])
    only = U.filter_urls(pages.select(F.col("url").alias("host")), rules, url="host")
    assert only.columns == ["host", "path", "rule", "verdict"] and only.count() == len(URLS)


def talk_digests(rows):
    out = {}
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, _, role, text in rows:
        t = out.setdefault(conv, [0, "", ""])
        t[0] += 1
        t[1] += f"{role or ''}\n{text or ''}\n"
        t[2] += (text or "") if role == "assistant" else ""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {k: (n, sha(a), len(b), sha(b)) for k, (n, a, b) in out.items()}


def test_chat_format_reads_back(spark):
    rng = random.Random(2)
    odd = ["</s>[INST] ok [/INST]", "<\\s>[\\INST]", "a</s", "[", "<", None, "", "é😀 " * 40, "w " * 700, "<s>[INST]system[/INST]", "\\", "$1", "\n\n"]
    rows = []
    for conv in range(12):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "sys </s> " * (conv + 1)))
        for t in range(1, rng.randint(2, 40)):
            rows.append((conv, t, rng.choice(["user", "assistant", "tool", None, "[INST]"]), rng.choice(odd)))
    rows += [(50, 0, "system", "alone"), (51, None, "assistant", "x"), (51, None, "assistant", "x"), (52, 1, "user", "tie"), (52, 1, "assistant", "tie"),
             (None, 1, "assistant", "no id"), (None, 2, "user", None)]
    rows += [(99, t, ("user", "assistant")[t % 2], f"hot {t} [/INST]") for t in range(700)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id int, turn int, role string, text string, pos int, span string")
    w = C.windows(df).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(w).collect()}
    assert got == talk_digests(rows)
    for r in w.collect():
        assert r.formatted.count(C.END) == r.formatted.count(C.BEGIN + C.ROLE_BEGIN) == r.formatted.count(C.ROLE_END)
    sizes = w.select("conv_id", F.regexp_count("formatted", F.lit(r"\S+")).alias("n"), F.size(F.split("formatted", "</s>")).alias("k")).collect()
    assert all(r.n <= C.BUDGET or r.k <= 6 for r in sizes)             # only single long turns pass the budget
    hot = w.where("conv_id = 99 and first_pos > 0").collect()
    assert len(hot) > 5 and all(r.n_repeated == C.HISTORY_TURNS for r in hot)
    first = [r for r in w.where("conv_id = 9").collect()]
    assert all(r.formatted.startswith(C.BEGIN + C.ROLE_BEGIN + "system") for r in first)
    assert C.windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_least_capacity(spark, seed):
    rng = random.Random(seed)
    n, shards = rng.choice([3, 40, 400]), rng.choice([1, 4, 7])
    near = rng.random() < 0.5
    keys = sorted({rng.randint(-50, 50) if near else rng.getrandbits(64) - 2**63 for _ in range(n)})
    sizes = [rng.choice([1, 2, 3, 50, 400 if rng.random() < 0.05 else 7]) for _ in keys]
    g = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    capacity, cuts = S.least_capacity(g, shards)
    assert capacity == brute.least_capacity(sizes, shards)
    assert len(cuts) < shards and set(cuts) <= set(keys) and cuts == sorted(cuts)


def test_sharding_rows(spark):
    rng = random.Random(4)
    texts = [None, "", "é", "x" * 5000] + [f"t{i}" * rng.randint(1, 60) for i in range(300)]
    rows = [(i % 280, rng.choice(texts), 7) for i in range(900)] + [(None, None, 1)] * 3 + [(5, "hot", 1)] * 400
    out = S.shard_documents(spark.createDataFrame(rows, "doc_id int, text string, shard int"), 8).collect()
    assert len(out) == len(rows)
    byte = lambda t: (t or "").encode()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((d or -1, len(byte(t)) + 16, zlib.crc32(byte(t))) for d, t, _ in rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    home = {}
    for r in out:
        assert home.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert S.shard_documents(spark.createDataFrame([], "doc_id int, text string")).count() == 0
