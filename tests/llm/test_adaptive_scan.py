"""The adaptive scan against all inner products: recall, exact scores, and cases that must be exact."""

import numpy as np
from pyspark.sql import functions as F

from causeway.llm import adaptive_scan
from causeway.llm.adaptive_scan import nearest


def product(a, b):
    return float(np.cumsum(np.asarray(a, float) * np.asarray(b, float))[-1])


def brute(rows, k, every):
    """Per query row its best rows, as (query_id, [(score, id)])."""
    out = []
    for i, (qid, q) in enumerate(rows):
        if qid % every == 0:
            out.append((qid, sorted((-product(q, x), vid) for j, (vid, x) in enumerate(rows) if j != i)[:k]))
    return sorted(out)


def found(df, k, every):
    got = {}
    rows = nearest(df, F.col("vec_id") % every == 0, k).orderBy("query_id", "rank").collect()
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    return got


def test_few_rows_are_all_found(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(30)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (0, rows[0][1]), (0, [9.0] * 6)]  # copies, a repeated row, a repeated id
    odd = [(200, None), (220, [0.0] * 6), (240, [None] * 6), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (None, [1.0] * 6), (300, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    got, want = found(df, 5, 20), brute(rows, 5, 20)
    assert set(got) == {q for q, _ in want}
    for q in got:
        lists = sorted(w for x, w in want if x == q)
        mine = sorted(got[q])
        assert mine == sorted((r + 1, *pair) for w in lists for r, pair in enumerate(w))
    assert {len(v) for v in found(df, 100, 20).values()} == {33, 3 * 33}
    assert found(df.limit(0), 5, 20) == {}


def test_copies_of_one_vector_fill_many_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, 20, 20)
    assert [(q, [(s, v) for _, s, v in sorted(got[q])]) for q in sorted(got)] == brute(rows, 20, 20)


def test_recall_and_scores_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "ROWS_OF_LIST", 64)
    monkeypatch.setattr(adaptive_scan, "SHARD", 50)
    monkeypatch.setattr(adaptive_scan, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 48))
    vectors = np.concatenate([centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 48)), 3 * rng.normal(size=(500, 48))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20)
    hits = total = 0
    for q, want in brute(rows, 20, 20):
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(-s == product(vectors[q], vectors[v]) for _, s, v in got[q])
        hits += len({v for _, v in want} & {v for _, _, v in got[q]})
        total += 20
    assert hits / total >= 0.95


def test_recall_on_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(df, 20, 20)
    hits = sum(len({v for _, v in want} & {v for _, _, v in got[q]}) for q, want in brute(rows, 20, 20))
    assert hits / (20 * len(got)) >= 0.95


def test_abandoning_is_rarely_wrong():
    rng = np.random.default_rng(8)
    tests = adaptive_scan.tests_of_blocks(64)
    gaps = rng.normal(size=(20000, 64))
    gaps /= np.linalg.norm(gaps, axis=1)[:, None]
    shown = np.cumsum(gaps**2, axis=1)[:, [15, 31, 47, 63]]
    assert (shown > np.array(tests)).any(axis=1).mean() < 2 * adaptive_scan.LOST and tests[0] < 0.6
