"""What steps leave on disk."""

import os
import random

import numpy as np

from waygraph.llm import alike, passages, simhash


def test_pipeline_drops_what_a_stage_has_read(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = [f"kept{i}" for i in range(4)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, docs, d: docs.repartition(2)) for n in names])
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 20
    assert [x.split("-")[0] for x in os.listdir(shared) if x.startswith("kept")] == ["kept2"]


def test_proposals_move_no_text(spark):
    rows = spark.createDataFrame([(i, "word " * 40 + str(i % 3)) for i in range(30)], "doc_id long, text string")
    seen = []
    real = simhash.stored
    try:
        simhash.stored = lambda df, tag: (seen.append((tag, df._jdf.queryExecution().executedPlan().toString())), real(df, tag))[1]
        simhash.proposals(rows)
    finally:
        simhash.stored = real
    plan = dict(seen)["simhash-texts"]
    assert "Exchange" in plan and plan.index("Exchange") < plan.index("MapInArrow")  # the fingerprints are dealt, not the texts


def test_a_sketch_never_rules_out_what_is_shared():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 2**63, 40000, dtype=np.uint64)
    for n, m, both in [(0, 0, 0), (1, 1, 1), (3, 900, 3), (400, 380, 350), (400, 380, 0), (5000, 6000, 4900), (20000, 20000, 0)]:
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[:both], pool[n : n + m - both])))
        assert alike.at_most(alike.sketch(a), alike.sketch(b)) >= len(np.intersect1d(a, b))
    unlike = alike.at_most(alike.sketch(pool[:2000]), alike.sketch(pool[2000:4000]))
    assert unlike < 0.8 / 1.8 * 4000  # such a pair's texts are not moved
    assert alike.sketch(np.arange(300, dtype=np.uint64) << np.uint64(20)) == b"" and alike.at_most(b"", alike.sketch(pool[:9])) > 9


def test_unlike_texts_that_share_a_shingle_are_not_moved(spark, monkeypatch):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [words(k, 80) + " aa bb cc dd ee" for k in range(12)] + [words(99, 200), words(99, 195) + " and some more words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moved, real = [], alike.verified
    monkeypatch.setattr(alike, "verified", lambda found, *a: (moved.append(found.count()), real(found, *a))[1])
    own = docs.select(alike.text_key().alias("node"), "text")
    ends = own.selectExpr("min(node) AS u").crossJoin(own.selectExpr("node AS v")).where("u <> v")
    assert alike.groups(docs, proposed=ends).count() == 2
    assert sum(moved) <= 2


def test_windows_of_passages_are_not_written(spark, monkeypatch):
    part = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(i, i, f"a{i} {part} b{i}") for i in range(4)], "doc_id long, tkey long, text string")
    tags, real = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, tag: (tags.append(tag), real(df, tag))[1])
    assert passages.shared(rows).count() == 4
    assert tags and "passage-windows" not in tags


def test_texts_without_secrets_are_not_dealt_out(spark, tmp_path):
    import corpus_pipeline
    from waygraph.llm import secrets

    text = lambda i: " ".join(f"{random.Random(i * 999 + k).getrandbits(60):o}" for k in range(60))
    rows = [(i, text(i) + (" token=Rk7Vn3Bq0Xs6Jh4P" if i == 7 else ""), "en", f"s{i % 3}", 9) for i in range(600)] + [(None, None, None, None, None), (7, "nothing", "en", "s1", 7)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    bus, status = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: (bus.waitUntilEmpty(30_000), status.executorSummary("driver").totalShuffleWrite())[1]
    before = moved()
    got = corpus_pipeline.secret_stage(spark, docs, "").collect()
    assert moved() - before < 100_000  # the texts are 700 kB
    assert sorted(got, key=str) == sorted(secrets.redact(docs, secrets.scan(docs)).collect(), key=str)
    assert [r["text"][-9:] for r in got if r["doc_id"] == 7 and r["n_chars"] != 7] == [" [SECRET]"]
