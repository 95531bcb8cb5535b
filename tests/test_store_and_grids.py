"""Stored cases, line numbers, constrained grids and draws."""

import glob
import hashlib
import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from causeway.operators import coverage
from causeway.sources import case_store, traces


def saved(spark, root, ids, mode="append", version="1.0.0"):
    rows = spark.createDataFrame([(i, f"r{k}", None if k else 'é "x"') for i in ids for k in range(3)], "case_id string, relation_id string, note string")
    docs = spark.createDataFrame([(i, version) for i in ids], "case_id string, version string")
    parts = [case_store.as_records("relations", rows, "relation_id"), *[case_store.as_records(e, docs) for e in case_store.REQUIRED]]
    case_store.save_cases(parts, root, mode)


def test_cases_are_stored_in_canonical_bytes_and_read_back(spark, tmp_path):
    root = str(tmp_path / "store")
    saved(spark, root, ["a/b", "ü 1", "c"])
    assert sorted(os.listdir(root)) == sorted([case_store.quote(i, safe="") + ".case" for i in ("a/b", "ü 1", "c")] + ["_staging"])
    assert not os.listdir(f"{root}/_staging")
    content = open(f"{root}/c.case/model/relations.jsonl", "rb").read()
    assert content.decode() == '{"note":"é \\"x\\"","relation_id":"r0"}\n{"note":null,"relation_id":"r1"}\n{"note":null,"relation_id":"r2"}\n'
    index = {e["path"]: e for e in json.load(open(f"{root}/c.case/integrity/content_index.json"))["entries"]}
    assert index["model/relations.jsonl"] == {"path": "model/relations.jsonl", "size_bytes": len(content), "digest": "sha256:" + hashlib.sha256(content).hexdigest()}
    found = {(r.case_id, r.path): (r.size_bytes, r.digest) for r in case_store.content_index(spark, root).collect()}
    assert len(found) == 15 and all(found["c", p] == (e["size_bytes"], e["digest"]) for p, e in index.items())
    rows = case_store.read_entity(spark, root, "relations", "relation_id string, note string").collect()
    assert sorted((r.case_id, r.relation_id, r.note) for r in rows) == sorted((i, f"r{k}", None if k else 'é "x"') for i in ("a/b", "ü 1", "c") for k in range(3))


def test_damaged_files_are_rows_with_a_problem(spark, tmp_path):
    root = str(tmp_path / "store")
    saved(spark, root, [f"c{i}" for i in range(12)])
    open(f"{root}/c3.case/manifest.json", "w").write("{")
    os.remove(f"{root}/c4.case/manifest.json")
    open(f"{root}/c5.case/model/relations.jsonl", "ab").write(b'\n \n{"relation_id": \n{"relation_id":"r9"}\n\xff\n')
    found = {r.case_id: (r.version, r.problem) for r in case_store.catalogue(spark, root).collect()}
    assert found.pop("c3") == (None, "manifest.json:1: JSONDecodeError") and found.pop("c4") == (None, "missing: manifest.json") and set(found.values()) == {("1.0.0", None)} and len(found) == 10
    cases = {r.case_id: r for r in case_store.load_cases(spark, root).collect()}
    assert cases["c5"].relations == 4 and cases["c5"].problems == ["model/relations.jsonl:6: JSONDecodeError", "model/relations.jsonl:8: UnicodeDecodeError"]
    assert cases["c3"].manifest is None and cases["c0"].problems == [] and cases["c0"].state_facts == 0


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    saved(spark, root, ["old"])
    with pytest.raises(Exception, match="stored already"):
        saved(spark, root, ["old", "new"])
    bad = spark.createDataFrame([(f"n{i}", "relations", "", "{}" if i else "no json") for i in range(9)], "case_id string, entity string, key string, record string")
    with pytest.raises(Exception):
        case_store.save_cases([bad], root)
    twice = spark.createDataFrame([("x", "case", "", "{}"), ("x", "case", "", '{"a":1}')], "case_id string, entity string, key string, record string")
    with pytest.raises(Exception, match="several records"):
        case_store.save_cases([twice], root)
    assert [n for n in os.listdir(root) if n != "_staging"] == ["old.case"] and not os.listdir(f"{root}/_staging")
    saved(spark, root, ["new"], "overwrite")
    assert [n for n in os.listdir(root) if n != "_staging"] == ["new.case"]
    assert case_store.scan(spark, str(tmp_path / "none"), "relations").count() == 0
    with pytest.raises(Exception, match="unknown entities"):
        case_store.scan(spark, root, "secrets").count()


def test_line_numbers_over_many_splits(spark, tmp_path):
    want = set()
    for name in ("a", "b"):
        lines = [json.dumps({"i": i, "t": "x" * (i % 40)}) for i in range(400)]
        for i in (3, 77, 78, 250, 399):
            lines[i] = '{"i": ' if i % 2 else "7"
            want.add((name, i + 1, lines[i]))
        lines[100] = lines[101] = " \t"
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(os.path.basename(r.file).split(".")[0], r.line, r.value) for r in traces.malformed_lines(spark, str(tmp_path)).collect()}
        numbers = sorted(r.line for r in traces.numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and numbers == sorted([*range(1, 401)] * 2)


DOMAINS = {"a": range(20), "b": range(20), "c": range(20), "d": range(20)}
RULES = [("a1", "eq", "a", 1), ("b", "in", "b", (1, 2)), ("cd", "requires", "c", (3, "d", 4)), ("bc", "excludes", "b", (1, "c", 5))]


def frames(spark):
    return {n: spark.createDataFrame([(v,) for v in values], f"{n} int").coalesce(1) for n, values in DOMAINS.items()}


def allowed():
    return {(a, b, c, d) for a, b, c, d in itertools.product(*DOMAINS.values()) if a == 1 and b in (1, 2) and (c != 3 or d == 4) and not (b == 1 and c == 5)}


def test_constraints_cut_as_soon_as_they_can(spark):
    steps = coverage.admissible_steps(frames(spark), RULES)
    peak = max(s.count() for s in steps)
    assert peak == len(allowed()) < 20**4 / 100
    assert {tuple(r) for r in coverage.admissible(frames(spark), RULES).collect()} == allowed()
    assert coverage.join_order({"a": 9, "b": 2, "c": 5}, [("x", "requires", "a", (1, "c", 2))]) == ["b", "c", "a"]
    assert coverage.admissible(frames(spark), []).count() == 20**4
    with pytest.raises(ValueError):
        coverage.admissible(frames(spark), [("x", "eq", "z", 1)])


def test_draws_are_those_of_the_permuted_grid(spark):
    got = [tuple(r) for r in coverage.sample(frames(spark), RULES, 25, 3).orderBy("draw").collect()]
    bits = coverage.half_bits(20**4)
    ranks = [r.p for r in spark.range(4**bits).select("id", coverage.permuted(F.col("id"), 3, bits).alias("p")).orderBy("id").collect()]
    assert sorted(ranks) == list(range(4**bits))
    grid, good = list(itertools.product(*DOMAINS.values())), allowed()
    order = [(*grid[p], i) for i, p in enumerate(ranks) if p < len(grid) and grid[p] in good]
    assert got == order[:25]
    assert {tuple(r)[:4] for r in coverage.sample(frames(spark), RULES, 10**6, 3).collect()} == allowed()
    other = [tuple(r)[:4] for r in coverage.sample(frames(spark), RULES, 25, 4).collect()]
    assert len(set(other)) == 25 and set(other) != {r[:4] for r in got}
    assert coverage.sample({**frames(spark), "d": frames(spark)["d"].limit(0)}, [], 3, 1).count() == 0


def test_a_draw_from_a_huge_grid_builds_little(spark):
    huge = {f"p{i}": spark.range(1000).coalesce(1).select(F.col("id").alias(f"p{i}")) for i in range(6)}  # 10^18 combinations
    rows = [tuple(r) for r in coverage.sample(huge, [("small", "in", "p0", tuple(range(300)))], 5, 1).collect()]
    assert len({r[:6] for r in rows}) == 5 and all(r[0] < 300 for r in rows)
