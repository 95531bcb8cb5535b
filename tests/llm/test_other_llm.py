"""Chat formatting, quality rules, language ID, top-k and the pipeline."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import chat, langid, quality, queries
from causeway.llm.topk import exact_top_k
from compared import agrees

EVENTS = "conv_id long, seq long, kind string, msg_id string, role string, text string, turn string, formatted string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    agrees(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", "m1", "user", "hi"), (1, 2, "delta", "m2", "assistant", "wro"), (1, 3, "delta", "m2", "assistant", "ng"), (1, 4, "regenerate", "m2", "assistant", ""), (1, 5, "delta", "m2", None, "ri"), (1, 6, "delta", "m2", None, "ght"),
        (1, 7, "edit", "m1", "user", "hello"), (1, 8, "message", "m3", "user", "gone"), (1, 9, "delete", "m3", None, None), (1, 10, None, None, "user", None), (None, 1, "message", None, None, "x"),
    ]
    df = spark.createDataFrame([(*r, "t", "f") for r in rows], EVENTS)
    got = sorted((r.conv_id or 0, r.place, r.role, r.text) for r in chat.fold_events(df).collect())
    assert got == [(0, 1, None, "x"), (1, 1, "user", "hello"), (1, 2, "assistant", "right"), (1, 10, "user", "")]


def test_deltas_do_not_revive_a_deleted_message(spark):
    rows = [(1, 1, "message", "a", "user", "x"), (1, 2, "delete", "a", None, None), (1, 3, "delta", "a", None, "x"), (1, 4, "delete", "b", None, None), (1, 5, "message", "b", "user", "back"), (1, 6, "delta", "c", "user", "only deltas")]
    got = sorted((r.place, r.text) for r in chat.fold_events(spark.createDataFrame([(*r, "t", "f") for r in rows], EVENTS)).collect())
    assert got == [(4, "back"), (6, "only deltas")]


def test_event_logs_fold_to_the_rows_they_stand_for(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], "" if t == 3 else None if t == 4 else f"{c} é text {t}" * (t + 1)) for c in range(12) for t in range(7)] * 2 + [(None, None, None, None)]
    events = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate", "delete"}
    got = Counter((r.conv_id, r.place.turn, r.role, r.text) for r in chat.fold_events(events).collect())
    assert got == Counter((c, t, role, text or "") for c, t, role, text in rows)


def test_formatting_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n", "\\", "a\\<|im_start|>\\\\", "", None, "<<SYS>><</SYS>>", "<<|im_end|>>", "plain\n\n", "[INST", "é<s> "]
    roles = ["user", "assistant", "us\ner\\", None, "<|im_end|>"]
    rows = [(7, i, "message", None, roles[i % len(roles)], t, "t", "f") for i, t in enumerate(texts)] + [(8, 0, "message", None, "assistant", "x" * 200000, "t", "f")] * 2
    formatted = chat.format_chats(spark.createDataFrame(rows, EVENTS))
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    assert [(t.role, t.text) for t in got[7].turns] == [(roles[i % len(roles)] or "", t or "") for i, t in enumerate(texts)]
    assert got[7].learnt == [t or "" for i, t in enumerate(texts) if roles[i % len(roles)] == "assistant"]
    assert got[8].learnt == ["x" * 200000] * 2  # repeated rows are messages of their own
    for r in formatted.collect():
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


def measured(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark):
    texts = [None, "", " \t\n", "a", "a b a b a b", "la " * 500, "x\n\nx\nx \n y", "é# ü*\x0b<>\x85b", "one two three four one two three five", "w " * 40000 + "end", "z" * 100000, "a b c a b c a b d"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "q", 2)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(df).collect()}
    assert got == {**{i: measured(t) for i, t in enumerate(texts)}, None: measured("q")}


def test_policies_and_ablations_are_masks(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, clean), (2, "short"), (3, clean + " ####### " * 20), (4, clean.upper()), (5, "short #")], "doc_id long, text string")
    rows = quality.ledger(docs)
    kept = lambda p: sorted(r.doc_id for r in quality.apply_policy(rows, p).where("kept").collect())
    assert kept("v1") == [1, 3, 4] and kept("v2") == [1]
    found = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality.ablations(rows).collect()}
    assert found["few_words"] == (2, 1, 2) and found["symbols"] == (2, 1, 2) and found["upper_case"] == (1, 1, 2)
    assert quality.ledger(docs.limit(0)).count() == 0


def test_language_id_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op5_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out and lang is not null and length(text) > 200").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog are here" if i % 2 else "le chat et le chien sont là", "en" if i % 2 else "fr", "z") for i in range(40)], "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None, "en", "z"), (2, "", None, "z"), (3, "123 !!", "en", "z"), (None, "the dog and the cat", None, "z"), (5, "le chien " * 50000, None, "z")], docs.schema)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(odd, model).collect()}
    assert got == {1: ("und", True), 2: ("und", True), 3: ("und", True), None: ("en", False), 5: ("fr", False)}
    assert langid.accepted(odd, model).columns == odd.columns and langid.accepted(odd, model).count() == 2
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert all(0 <= r.score <= 1 for r in langid.identify(docs, model).collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).round(2)
    vectors[50:120] = vectors[7]  # ties
    repeated = [(50, vectors[50]), (50, vectors[50]), (100, vectors[3]), (4, vectors[4])]  # rows of their own
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(i, v.tolist(), 0) for i, v in repeated] + [(1000, None, 0), (1050, [1.0, None] * 4, 0), (1100, [float("nan")] * 8, 0), (1150, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (1200, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = exact_top_k(df, F.col("vec_id") % 50 == 0, 5, query_block=2, shard_rows=16, fan_in=3).collect()
    ids = [*range(300), *[i for i, _ in repeated]]
    q = np.floor(256 * np.concatenate([vectors, [v for _, v in repeated]])).astype(int)
    for i in range(0, 300, 50):
        best = sorted(pair for n, own in enumerate(ids) if own == i for pair in enumerate(sorted((-int(q[n] @ q[j]), ids[j]) for j in range(len(ids)) if j != n)[:5], 1))
        assert sorted((r.rank, (-r.score, r.vec_id)) for r in got if r.query_id == i) == best
    assert {r.query_id for r in got} == set(range(0, 300, 50))  # 1200 has no candidate of its length
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e17, 3.0]), (1, [1e17, 5.0]), (2, [-1e18, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in exact_top_k(df, F.col("vec_id") == 0, 5).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63)}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns and after.count() <= before.count()
        before = after
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
