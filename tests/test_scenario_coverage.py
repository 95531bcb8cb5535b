"""Coverage of a registry by hand: which family a shared point counts for, and what is suggested."""

from causeway.operators import coverage

FAMILY = "seq string, family string, topology string, axes array<string>, invariants array<string>, profiles array<string>, faults array<string>"
RUN = "instance_id string, family string, profile string, faults array<string>"


def test_points_witnesses_and_suggestions(spark):
    families = spark.createDataFrame([("1", "a", "line", ["time"], ["i"], ["complete", "redacted"], ["drop"]), ("2", "b", "line", [], ["i"], ["complete"], [])], FAMILY)
    runs = spark.createDataFrame([("r1", "a", "complete", []), ("r2", "a", "complete", ["drop", "drop", "own"]), ("r3", "gone", "complete", [])], RUN)
    expected = coverage.family_points(families)
    points = {(r.dimension, r.key): r.family for r in expected.collect()}
    assert points == {
        ("family", "a"): "a", ("family", "b"): "b", ("topology", "line"): "b", ("universe_axis", "time"): "a", ("invariant", "i"): "b", ("observability", "complete"): "b", ("observability", "redacted"): "a",
        ("interaction", "a|baseline|complete"): "a", ("interaction", "a|drop|complete"): "a", ("interaction", "a|baseline|redacted"): "a", ("interaction", "a|drop|redacted"): "a",
        ("interaction", "b|baseline|complete"): "b", ("fault_operator", "drop"): "a",
    }
    real = spark.createDataFrame([("r1", "x"), ("r1", "x"), ("none", "y")], "instance_id string, realization string")
    seen = coverage.scenario_witnesses(runs, families, real)
    assert {(r.dimension, r.key): r.witnesses for r in seen.collect()} == {
        ("family", "a"): 2, ("topology", "line"): 2, ("universe_axis", "time"): 2, ("invariant", "i"): 2, ("observability", "complete"): 2, ("interaction", "a|baseline|complete"): 1,
        ("interaction", "a|drop|complete"): 1, ("interaction", "a|own|complete"): 1, ("fault_operator", "drop"): 1, ("fault_operator", "own"): 1, ("realization", "x"): 1,
    }
    got = [tuple(r) for r in coverage.suggestions(expected, seen, 2).orderBy("rank").collect()]
    assert got == [
        ("a", 3, ["observability:redacted", "interaction:a|baseline|redacted"], None, "redacted", 1), ("b", 2, ["family:b", "interaction:b|baseline|complete"], None, "complete", 2)]
    assert coverage.suggestions(expected, seen.where("dimension <> 'interaction' or key not like '%baseline%'"), 1).where("family = 'a'").first().fault is None


def test_a_fault_is_suggested_and_empty_tables_give_nothing(spark):
    families = spark.createDataFrame([("1", "a", "line", [], [], ["complete"], ["drop"])], FAMILY)
    runs = spark.createDataFrame([("r1", "a", "complete", [])], RUN)
    row = coverage.suggestions(coverage.family_points(families), coverage.scenario_witnesses(runs, families)).first()
    assert (row.fault, row.profile, row.points) == ("drop", "complete", ["interaction:a|drop|complete", "fault_operator:drop"])
    none = families.where("false")
    assert coverage.suggestions(coverage.family_points(none), coverage.scenario_witnesses(runs, none)).isEmpty()
