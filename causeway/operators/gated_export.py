"""Export of cases behind a gate: redacted, written aside, checked as written, derived anew, and only then put in place.

Everything is done for all cases at once. Nothing stands at the target before the one
rename that ends an export; a run that is refused or dies leaves a staging folder at most.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import assembly, findings, invariants, privacy
from causeway.session import checkpointed

ENTITIES = {"cases": "case_id", "nodes": "node_id", "relations": "relation_id", "contexts": "context_id", "effects": "effect_id", "observations": "observation_id"}
#: What redaction writes for a value that a rule rejects; no such value may leave.
REJECTED = "[PROHIBITED]"


class ExportRefused(ValueError):
    """Some cases may not leave; ``problems`` has a row for each (case_id, problem)."""

    def __init__(self, problems: DataFrame) -> None:
        self.problems = problems
        super().__init__(f"{problems.select('case_id').distinct().count()} cases do not satisfy the export policy")


def exported_id(case_id: Column) -> Column:
    return F.concat(F.lit("case.shareable."), F.replace(case_id, F.lit("."), F.lit("-")))


def sanitized(t: dict[str, DataFrame], policy_name: str, secret: bytes) -> dict[str, DataFrame]:
    """The tables of ``ENTITIES`` under a policy, with case ids of their own and the types they had.

    A number, a time or a flag that a rule rewrites has no value of its type afterwards and is null.
    """
    out = {}
    for name, key in ENTITIES.items():
        rows = privacy.redact(t[name], key, policy_name, secret)
        typed = rows.select(*[(F.col(f.name) if f.dataType.simpleString() == rows.schema[f.name].dataType.simpleString() else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in t[name].schema])
        out[name] = typed.withColumn("case_id", exported_id(F.col("case_id")))
    return out


def _counts(tables: dict[str, DataFrame], case_id: Column) -> DataFrame:
    parts = [df.groupBy(case_id.alias("case_id")).agg(F.count("*").alias("n")).withColumn("entity", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def problems_of(source: dict[str, DataFrame], written: dict[str, DataFrame], policy_name: str) -> DataFrame:
    """(case_id, problem) of what was written: fields that hold what the policy prohibits or rejected, and rows that were lost or doubled.

    ``case_id`` is that of the exported case. Each table is read once for its fields; all patterns are tried in place.
    """
    patterns = privacy.PROHIBITED[policy_name]
    found = []
    for name, df in written.items():
        hits = []
        for column in df.columns:
            value = F.col(column).cast("string")
            hits += [F.when(F.coalesce(value.rlike(p), F.lit(False)), F.lit(f"{name}.{column}: {label}")) for label, p in patterns.items()]
            hits.append(F.when(F.coalesce(value.contains(REJECTED), F.lit(False)), F.lit(f"{name}.{column}: rejected")))
        found.append(df.select("case_id", F.explode(F.array_compact(F.array(*hits))).alias("problem")))
    names = {name: source[name] for name in written}
    before, after = _counts(names, exported_id(F.col("case_id"))), _counts(written, F.col("case_id")).withColumnRenamed("n", "m")
    compared = before.join(after, ["case_id", "entity"], "full").where(~F.col("n").eqNullSafe(F.col("m")))
    found.append(compared.select("case_id", F.concat_ws(" ", "entity", F.lit("rows:"), F.coalesce("m", F.lit(0)), F.lit("of"), F.coalesce("n", F.lit(0))).alias("problem")))
    return reduce(DataFrame.unionByName, found).distinct()


def _written(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}


def export(t: dict[str, DataFrame], target: str, policy_name: str, secret: bytes, leave_out: bool = False, ids: list[str] | None = None) -> dict[str, DataFrame]:
    """Put redacted cases into a new folder ``target`` and return what stands there, by table.

    Besides the tables of ``ENTITIES`` the folder has what was derived anew from the redacted
    rows (``derived/relations``, ``derived/invariants``, ``derived/findings``) and ``report``: for
    each case (by its own id and that of the exported one) its status, problems and number of
    records. If a case has a problem, the export is refused and nothing is put in place; with
    ``leave_out`` such cases are held back whole and the others leave. ``ids`` are the invariants
    evaluated anew, by default all. An empty set of
    cases is exported as empty tables. A target that exists is an error.
    """
    spark = t["cases"].sparkSession
    system, place = fs.FileSystem.from_uri(target)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        raise FileExistsError(f"{target} exists already")
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    aside = fs.FileSystem.from_uri(staging)[1]
    try:
        written = _written(spark, sanitized(t, policy_name, secret), f"{staging}/all")
        problems = checkpointed(problems_of(t, written, policy_name))
        held = problems.groupBy("case_id").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
        some = not problems.isEmpty()
        if some and not leave_out:
            raise ExportRefused(problems)
        if some:
            kept = _written(spark, {n: df.join(held.select("case_id"), "case_id", "left_anti").select(df.columns) for n, df in written.items()}, f"{staging}/kept")
        else:
            kept = written
        graph = {"relations": assembly.all_relations(kept["nodes"], kept["effects"], kept["relations"])}
        graph = _written(spark, graph, f"{staging}/derived")
        derived = kept | {"graph": graph} | {k: v for k, v in t.items() if k in ("components",)}
        told = _written(spark, {"invariants": invariants.evaluate(derived, ids, isolated=True)}, f"{staging}/derived")
        _written(spark, {"findings": findings.analyze(derived, told["invariants"])}, f"{staging}/derived")
        own = t["cases"].select("case_id", exported_id(F.col("case_id")).alias("exported_id"))
        records = _counts(written, F.col("case_id")).groupBy("case_id").agg(F.sum("n").alias("records"))
        report = own.join(records.withColumnRenamed("case_id", "exported_id"), "exported_id", "left").join(held.withColumnRenamed("case_id", "exported_id"), "exported_id", "left")
        empty = F.array().cast("array<string>")
        _written(spark, {"report": report.select(
            "case_id", "exported_id", F.when(F.col("problems").isNull(), "exported").otherwise("held back").alias("status"), F.coalesce("problems", empty).alias("problems"), F.coalesce("records", F.lit(0)).alias("records"),
        )}, staging)
        for name in kept:
            system.move(f"{aside}/{'kept' if some else 'all'}/{name}", f"{aside}/{name}")
        for rest in ("all", "kept"):
            if system.get_file_info(f"{aside}/{rest}").type == fs.FileType.Directory:
                system.delete_dir(f"{aside}/{rest}")
        system.move(aside, place)
    except BaseException:
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)
        raise
    return exported(spark, target)


def exported(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of an export, by the names of their folders."""
    names = [*ENTITIES, "report", "derived/relations", "derived/invariants", "derived/findings"]
    return {name: spark.read.parquet(f"{target}/{name}") for name in names}
