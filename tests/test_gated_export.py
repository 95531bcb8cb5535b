"""Export behind a gate: what leaks stops it, and what leaves is whole."""

import os

import pytest
from pyspark.sql import functions as F

from causeway.operators import assembly, gated_export
from causeway.plans.views import tables

SECRET = b"test"


@pytest.fixture(scope="module")
def three(spark, sf_dir):
    """Tables of three cases, one of which holds a key in a field that no rule rewrites."""
    t = tables(spark, sf_dir)
    ids = [r.case_id for r in t["cases"].orderBy("case_id").limit(3).collect()]
    few = {n: df.where(F.col("case_id").isin(ids)) for n, df in t.items() if n in gated_export.ENTITIES}
    return few, ids


def _leaking(few, case_id):
    remark = F.when(F.col("case_id") == case_id, F.lit("password = hunter2")).otherwise(F.lit("none"))
    return few | {"effects": few["effects"].withColumn("remark", remark)}


def test_a_leak_refuses_the_export(spark, three, tmp_path):
    few, ids = three
    target = str(tmp_path / "out")
    with pytest.raises(gated_export.ExportRefused) as refused:
        gated_export.export(_leaking(few, ids[1]), target, "shareable", SECRET)
    assert {tuple(r) for r in refused.value.problems.collect()} == {(f"case.shareable.{ids[1].replace('.', '-')}", "effects.remark: secret")}
    assert os.listdir(tmp_path) == []


def test_cases_that_leak_are_held_back_whole(spark, three, tmp_path):
    few, ids = three
    got = gated_export.export(_leaking(few, ids[1]), str(tmp_path / "out"), "shareable", SECRET, leave_out=True, ids=["effect.at-most-once", "identity.execution-isolation"])
    assert {r.case_id: r.status for r in got["report"].collect()} == {ids[0]: "exported", ids[1]: "held back", ids[2]: "exported"}
    out = {f"case.shareable.{i.replace('.', '-')}" for i in (ids[0], ids[2])}
    for name in gated_export.ENTITIES:
        kept = few[name].where(F.col("case_id") != ids[1])
        assert got[name].count() == kept.count()
        assert dict(got[name].drop("remark").dtypes) == dict(kept.dtypes)
    assert got["derived/invariants"].count() == 4
    assert {r.case_id for r in got["derived/invariants"].select("case_id").distinct().collect()} == out
    derived = assembly.all_relations(got["nodes"], got["effects"], got["relations"])
    assert {r.relation_id for r in derived.collect()} == {r.relation_id for r in got["derived/relations"].collect()}
    tenants = {r.tenant_id for r in got["nodes"].select("tenant_id").distinct().collect()}
    assert tenants and not tenants & {r.tenant_id for r in few["nodes"].select("tenant_id").distinct().collect()}
    assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        gated_export.export(few, str(tmp_path / "out"), "shareable", SECRET)


def test_lost_and_rejected_rows_are_problems(spark, three):
    few, ids = three
    written = gated_export.sanitized(few, "internal", SECRET)
    damaged = {"nodes": written["nodes"].where(~F.col("case_id").endswith(ids[0].replace(".", "-"))), "effects": written["effects"].withColumn("note", F.lit(gated_export.REJECTED))}
    got = {(r.case_id, r.problem.split(":")[0]) for r in gated_export.problems_of(few, damaged, "internal").collect()}
    shared = {f"case.shareable.{i.replace('.', '-')}" for i in ids}
    assert (f"case.shareable.{ids[0].replace('.', '-')}", "nodes rows") in got
    assert {c for c, p in got if p == "effects.note"} <= shared and {p for _, p in got} == {"nodes rows", "effects.note"}


def test_no_cases(spark, three, tmp_path):
    few, _ = three
    got = gated_export.export({n: df.where("false") for n, df in few.items()}, str(tmp_path / "none"), "public", SECRET, ids=["effect.at-most-once"])
    assert got["report"].isEmpty() and got["derived/findings"].isEmpty()
