"""The corpus pipeline, stage by stage, on a small fixture with planted cases."""

import random

import corpus_pipeline as C
from fintrail.llm import piece_transducer as P
from fintrail.llm.common import stored
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int"
WORDS = {"en": "the of and to in that was his with for it had not but from".split(), "fr": "le de la et les des une dans qui pour est pas sur été où".split()}


def fixture(spark, folder):
    rng = random.Random(8)

    def text(lang, n):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "er", "on", "al", "ix", "us"]) + str(rng.choice(["", "a", "o"])) for _ in range(n))
    rows = [(i, text(("en", "fr")[i % 2], 120), ("en", "fr")[i % 2]) for i in range(40)]
    near = rows[0][1].split(" ")
    near[60] = "changed"
    passage, item = text("en", 60), text("en", 25)
    rows += [(100, " ".join(near), "en"), (101, rows[2][1], "en"), (102, rows[4][1] + " " + passage, "en"), (103, text("fr", 90) + " " + passage, "fr"),
             (104, text("en", 80) + " " + item + " " + text("en", 30), "en"), (105, "123 456 !!", "en"), (106, None, "en"), (107, passage + " " + passage, "en")]
    rows += [(0, rows[0][1], "en"), (None, text("en", 70), "en"), (None, text("fr", 75), None)]
    df = spark.createDataFrame([(i, t, g, "s", len(t or ""), 1) for i, t, g in rows], SCHEMA)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, passage, item


def test_stages(spark, tmp_path):
    rows, passage, item = fixture(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == list(C.COLUMNS)
    assert [n for n, _ in C.STAGES] == list(seen)
    ids = {n: [r.doc_id for r in rs] for n, rs in seen.items()}
    assert sorted(str(i) for i in ids["language"]) == sorted(str(i) for i, _, _ in rows if i not in (105, 106))
    # one of each class of the rows that came in, and no other row lost
    came = [(r.doc_id, r.text) for r in seen["language"]]
    found = brute.classes([(n, t) for n, (_, t) in enumerate(came)], 5, 0.8)
    assert len(ids["near_duplicates"]) == len({c for c, _ in found})
    assert ids["near_duplicates"].count(0) == 1 and not {100, 101} & set(ids["near_duplicates"]) and ids["near_duplicates"].count(None) == 2
    came = [(r.doc_id, r.text) for r in seen["near_duplicates"]]
    kept = brute.kept_words([t for _, t in came], 35)
    want = sorted((str(i), t if len(k) == len(brute.words(t)) else " ".join(k)) for (i, t), k in zip(came, kept) if k)
    assert sorted((str(r.doc_id), r.text) for r in seen["substrings"]) == want
    assert all(passage not in r.text for r in seen["substrings"]) and 107 not in ids["substrings"]
    came = [(r.doc_id, r.text) for r in seen["substrings"]]
    hits = brute.contaminated([t for _, t in came], [(1, item)], 10)
    assert sorted(str(i) for i in ids["benchmark"]) == sorted(str(i) for (i, _), h in zip(came, hits) if not h[1])
    assert 104 not in ids["benchmark"]
    t = P.load()
    texts = sorted(r.text for r in seen["benchmark"])
    assert sorted(t.decode(r.token_ids) for r in seen["tokens"]) == texts
    assert all(r.n_tokens == len(r.token_ids) for r in seen["tokens"])


def test_run_equals_stages_and_empty_table(spark, tmp_path):
    rows, _, _ = fixture(spark, str(tmp_path / "a"))
    assert C.run(spark, str(tmp_path / "a")).count() > 30
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b/benchmark.parquet"))
    out = C.run(spark, str(tmp_path / "b"))
    assert out.count() == 0 and out.columns == ["doc_id", "token_ids", "n_tokens"]
