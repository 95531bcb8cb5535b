"""Near-duplicate operators against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm.jaccard_join import PRODUCTION, jaccard_join, one_of_each
from causeway.llm.line_dedup import line_dedup, winnow
from causeway.llm.near import tile_links
from causeway.llm.substring_dedup import substring_dedup
from causeway.llm.tables import split_by_keys
from causeway.llm.words import shingles
from causeway.session import checkpointed

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def split(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def sets(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 5 * both >= 4 * len(a | b)


def sentence(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(30)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentence(rng, rng.choice([3, 5, 30, 90, 200])) for _ in range(40)]
    out = list(base)
    for t in base[:25]:
        out += [t, edited(rng, t, 1), edited(rng, t, 2), edited(rng, t, 8)]
    out += ["", None, " \t\n", "one", "one", "two words", "a b c d", "a b c d e"] + [edited(rng, base[9] + " " + base[10], 1) for _ in range(40)]
    out.append(" ".join(f"w{i}" for i in range(60000)))  # a very long text and a near copy
    out.append(out[-1] + " end")
    return out


def test_shingles_are_those_of_words(texts):
    hashes, counts = shingles([(t or "").encode() for t in texts])
    ends = np.cumsum(counts)
    assert [len(set(hashes[e - c : e].tolist())) for e, c in zip(ends, counts)] == [len(sets(t)) for t in texts]


def test_tile_links_equal_brute_force(texts):
    some = [t for t in texts if split(t)][:120]
    copies = np.arange(1, len(some) + 1)
    for side in (np.zeros(len(some), int), np.arange(len(some)) % 2):
        links, root = tile_links([t.encode() for t in some], copies, side, "0.8")
        s = [sets(t) for t in some]
        for i in range(len(some)):
            met = [j for j in range(len(some)) if j != i and alike(s[i], s[j]) and (not side.any() or side[i] != side[j])]
            assert links[i] == sum(copies[j] for j in met) and (root[i] >= 0) == bool(met)


def test_jaccard_join_equals_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = [sets(t) for t in texts]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if alike(s[i], s[j]):
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: (find(i), n[i]) for i in range(len(rows))}
    assert PRODUCTION.recall(0.8) > 0.99999


def test_jaccard_join_edges(spark):
    schema = "doc_id long, text string, uid string, cid int, root string, component string"
    assert jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "x y z", "u", 1, "r", "c"), (4, "x y z", "u", 1, "r", "c"), (4, "x y z", "u", 1, "r", "c"), (5, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or -1, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    assert got == [(-1, 4, 2), (4, 4, 2), (4, 4, 2), (5, 5, 0)]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [4, 4, 5]  # the row without an id is a copy of 4


def test_substring_dedup_keeps_first_paragraphs(spark):
    rng = random.Random(8)
    p, q = sentence(rng, 60), sentence(rng, 70)
    short = sentence(rng, 10)
    rows = [
        (1, f"{short}\n{p}", "a"), (2, f"{q}\n{edited(rng, p, 1)}\n{short}", "b"), (3, f"{p}\n{p}", "c"), (4, edited(rng, q, 30), "d"), (5, None, "e"), (6, "", "f"), (7, f"tail\n{q}", "g"), (7, f"tail\n{q}", "g"), (None, p, "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert got[None].text == p and got[None].n_removed == 0  # a null id comes first
    assert got[1].text == short and got[1].kept_in == []
    assert got[2].text == f"{q}\n{short}" and got[3].text == "" and got[3].places == [0, 1]
    assert got[4].text == rows[3][1] and got[5].text is None and got[6].text == "" and got[7].text == "tail"
    assert substring_dedup(docs).count() == len(rows)
    assert substring_dedup(docs.where("doc_id = 99")).count() == 0


def brute_lines(docs, window):
    """Lines in a run of ``window`` that came before, per document in the order given."""
    seen, gone = set(), {}
    for key, text in docs:
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if x and not x.isspace()]
        for s in range(len(lines) - window + 1):
            run = tuple(x for _, x in lines[s : s + window])
            if run in seen:
                gone.setdefault(key, set()).update(range(lines[s][0], lines[s + window - 1][0] + 1))
            seen.add(run)
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [sentence(rng, 4) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice([*pool, "", "common"]) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    docs += [(60, "\n".join(pool)), (61, "x\n" + "\n".join(pool) + "\ny"), (62, "\n".join(["same"] * 50)), (63, None)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_lines(docs, 3)
    assert {k: set(r.places) for k, r in got.items() if r.places} == want
    for key, text in docs:
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want.get(key, ()))
        assert got[key].text == left


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 3).astype(np.uint64)
    marks = []
    for _ in range(2):
        lines = np.concatenate([rng.integers(0, 2**63, 5).astype(np.uint64), common, rng.integers(0, 2**63, 4).astype(np.uint64)])
        low, whole = winnow(lines, 3)
        marks.append({(lines[i], w) for i, w in zip(low, whole)})
    assert marks[0] & marks[1]


def test_line_dedup_edges(spark):
    schema = "doc_id long, text string, mark string, first string, n_removed string"
    assert line_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a\nb\nc", "m", "f", "n"), (1, "a\nb\nc", "m", "f", "n"), (2, "a\nb\nc\nd", "m", "f", "n")]
    got = sorted((r.doc_id, r.text, r.n_removed, r.mark) for r in line_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "a\nb\nc", 0, "m"), (1, "a\nb\nc", 0, "m"), (2, "d", 3, "m")]


def test_split_by_keys_loses_nothing(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") * 7)
    keys = checkpointed(spark.range(0, 700, 7).select(F.col("id").alias("k")))
    there, rest = split_by_keys(rows, F.col("k"), keys, both=True)
    assert there.count() + rest.count() == 1000
    assert rest.join(keys, "k").count() == 0


def brute_passages(docs, least):
    """Words in a run of ``least`` that came before, per document in the order given."""
    seen, gone = set(), {}
    for key, text in docs:
        w = split(text)
        for s in range(len(w) - least + 1):
            run = tuple(w[s : s + least])
            if run in seen:
                gone.setdefault(key, set()).update(range(s, s + least))
            seen.add(run)
    return gone


def test_substring_dedup_cuts_passages_wherever_they_stand(spark):
    rng = random.Random(11)
    p, q = sentence(rng, 54).split(" "), sentence(rng, 130).split(" ")
    ragged = lambda words: "".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for w in words).strip()
    around = lambda words: ragged([*sentence(rng, 60).split(" "), *words, *sentence(rng, 45).split(" ")])
    docs = [(i, around(rng.choice([p, p[:51], p[3:53], p[:49], q[:60], q[40:], q[20:100], []]))) for i in range(40)]
    docs += [(40, around(p + q + p)), (41, " ".join(["same"] * 60)), (42, " ".join(["on", "off"] * 45)), (43, " ".join(p)), (44, ragged(p[:49])), (45, None)]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame([*docs, docs[43]], "doc_id long, text string")).collect()}
    want = brute_passages(docs, 50)
    assert 41 in want and 42 in want and 43 in want and 44 not in want
    for key, text in docs:
        gone = {i for s in got[key].spans or () for i in range(s["first"], s["last"] + 1)}
        assert gone == want.get(key, set())
        assert split(got[key].text) == [w for i, w in enumerate(split(text)) if i not in gone]
        assert bool(gone) == (got[key].n_removed > 0)
        if not gone:
            assert got[key].text == text


def test_line_dedup_finds_short_runs_of_many_words(spark):
    rng = random.Random(21)
    pool = [sentence(rng, n) for n in (4, 8, 11, 12, 13, 19, 20, 30)]
    docs = [(i, "\n".join(rng.choice([*pool, "", sentence(rng, 6), sentence(rng, 6)]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen, want = set(), {}
    for key, text in docs:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x]
        for s in range(len(lines)):
            for n in (1, 2, 3):
                run = tuple(x for _, x in lines[s : s + n])
                if len(run) == n and (n == 3 or sum(len(split(x)) for x in run) >= 20):
                    if run in seen:
                        want.setdefault(key, set()).update(range(lines[s][0], lines[s + n - 1][0] + 1))
                    seen.add(run)
    assert {k: set(r.places) for k, r in got.items() if r.places} == want != brute_lines(docs, 3)


def test_one_document_of_each_class_stays(spark):
    from causeway.llm.jaccard_join import one_of_each

    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words), "a"), (None, " ".join(words), "b"), (None, " ".join(words), "c"), (1, near, "d"), (5, near, "e"), (7, None, "f"), (8, " ", "g"), (None, "quite another text", "h"), (9, "quite another text of its own", "i"), (9, "quite another text of its own", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    assert sorted(r.root for r in one_of_each(docs).collect()) in (["a", "f", "g", "h", "i", "i"], ["d", "f", "g", "h", "i", "i"])
    assert one_of_each(docs.limit(0)).count() == 0


def test_bands_of_paragraphs_in_one_worker_are_those_of_their_texts(spark, sf_dir):
    from causeway.llm.near import BANDS, band_rows
    from causeway.llm.substring_dedup import LEAST_WORDS, PRODUCTION, _paragraph_bands, _paragraphs
    from causeway.llm.tables import rows_of, text_key

    rows = rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("text is not null").withColumn("key", text_key(F.col("text")))
    units = rows.mapInArrow(_paragraphs(LEAST_WORDS), "doc_id long, key binary, place int, text string").select(F.xxhash64(text_key(F.col("text"))).alias("cid"), "text")
    want = units.mapInArrow(band_rows(PRODUCTION), BANDS)
    got = rows.select("text").mapInArrow(_paragraph_bands(LEAST_WORDS, PRODUCTION), BANDS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
