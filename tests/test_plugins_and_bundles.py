"""Coordinator, registry and stored cases."""

import json

import pytest
from pyspark.sql import functions as F

from causeway.plugins import Registry, TableSource, collect_all
from causeway.sources import bundles


def test_one_failing_source_leaves_the_others(spark):
    rows = spark.createDataFrame([("n1", "t1", "alpha")], "node_id string, trace string, tenant_id string")
    foreign = spark.createDataFrame([("n2", "t1", "beta")], rows.schema)
    none = spark.createDataFrame([], "kind string, value string")
    good, bad = TableSource("a", rows, "nodes", {"trace": "trace"}, "node_id"), TableSource("b", foreign, "nodes", {"trace": "trace"}, "node_id")
    broken = TableSource("c", rows, "nodes", {"trace": "trace"}, "no_such_column")
    got = collect_all(spark, [good, bad, broken], none, tenant="alpha")
    assert got.partial and got.status["a"] == "completed" and got.status["b"].startswith("failed") and got.status["c"].startswith("failed")
    assert got.tables["nodes"].count() == 1


def test_registry_rejects_a_second_registration():
    registry = Registry()
    registry.register("x", "1", len)
    with pytest.raises(ValueError):
        registry.register("x", "1", len)
    assert registry.get("x", "1") is len and registry.list() == [("x", "1")]


def test_stored_cases(spark, tmp_path):
    for case in ("one.case", "two.case"):
        folder = tmp_path / "cases" / case
        (folder / "model").mkdir(parents=True)
        (folder / "manifest.json").write_text(json.dumps({"format": "case", "format_version": "1.0.0", "case_id": case.split(".")[0]}))
        (folder / "model" / "relations.jsonl").write_text('{"relation_id": "r", "kind": "invokes", "source_ref": "a", "target_ref": "b"}\n')
    root = str(tmp_path / "cases")
    assert sorted(r.case_id for r in bundles.read_table(spark, root, "relations").collect()) == ["one", "two"]
    assert bundles.read_manifests(spark, root).count() == 2
    assert bundles.read_files(spark, root).where("path = 'model/relations.jsonl'").count() == 2


def test_artifact_problems(spark):
    df = spark.createDataFrame([("docs/a.md", "docs"), ("/etc/x", "docs"), ("docs/../x", "docs"), ("model/x", "docs"), ("x/y", "x"), ("manifest.json", "docs")], "path string, layer string")
    got = [r.p for r in df.select(bundles.artifact_problem(F.col("path"), F.col("layer")).alias("p")).collect()]
    assert got == [None, "unsafe path", "unsafe path", "outside its layer", "unknown layer", "reserved path"]
