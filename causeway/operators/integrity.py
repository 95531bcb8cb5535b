"""Integrity: content index, verification, deltas, referential checks, health and compatibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalars import digest, media_type

ID_PATTERN, DIGEST_PATTERN = r"^[a-z][a-z0-9._:-]{2,159}$", r"^sha256:[0-9a-f]{64}$"
CURRENT_VERSION = "1.0.0"
# Which stored versions can be brought to which.
MIGRATIONS = [("0.9.0", "1.0.0")]


def content_index(files: DataFrame) -> DataFrame:
    """Index of files (path, content): size, digest, media type and layer (first part of the path)."""
    return files.select(
        "path", media_type(F.col("path")).alias("media_type"), F.octet_length("content").cast("long").alias("size_bytes"), digest(F.col("content")).alias("digest"),
        F.split("path", "/")[0].alias("layer"),
    )


def verify(index: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): what an index and the files do not agree on. Full outer join on the path."""
    a = index.select("path", F.col("digest").alias("a"))
    b = files.select("path", F.col("digest").alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "mismatched")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null")


def delta(base: DataFrame, target: DataFrame) -> DataFrame:
    """Changes from one inventory (path, digest, size_bytes) to another: added, modified, deleted."""
    a = base.select("path", F.col("digest").alias("a"))
    b = target.select("path", F.col("digest").alias("b"), "size_bytes")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes")).where("change is not null")


def delta_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("payload_bytes"))


def index_digest(index: DataFrame, by: str) -> DataFrame:
    """A digest over the ordered entries of each group."""
    entry = F.concat_ws("|", "path", "digest", F.col("size_bytes").cast("string"))
    return index.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("e")).select(by, digest(F.concat(F.array_join("e", "\n"), F.lit("\n"))).alias("digest"))


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID_PATTERN), F.lit(False))


def valid_digest(c: Column) -> Column:
    return F.coalesce(c.rlike(DIGEST_PATTERN), F.lit(False))


def field_violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule that a row breaks."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))).alias("rule"))


def dangling(df: DataFrame, column: str, target: DataFrame, key: str, on: str = "case_id") -> DataFrame:
    """References that no row of the target has."""
    refs = df.select(on, F.col(column).alias("ref")).where("ref is not null")
    return refs.join(target.select(on, F.col(key).alias("ref")), [on, "ref"], "left_anti").groupBy(on, "ref").agg(F.count("*").alias("uses")).withColumn("column", F.lit(column))


def repeated_ids(*tables: tuple[DataFrame, str], on: str = "case_id") -> DataFrame:
    """Ids that occur more than once, over all tables together."""
    ids = reduce(DataFrame.unionByName, [df.select(on, F.col(c).alias("id")) for df, c in tables])
    return ids.groupBy(on, "id").agg(F.count("*").alias("n")).where("n > 1")


def reversed_times(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("end_us") < F.col("start_us")).select("case_id", "node_id")


def compatibility(manifests: DataFrame, problems: DataFrame, on: str = "case_id") -> DataFrame:
    """compatible, migratable or unknown by version; incompatible where the integrity check failed."""
    broken = problems.select(on).distinct().withColumn("broken", F.lit(True))
    old = F.col("version").isin([a for a, _ in MIGRATIONS])
    status = F.when(F.col("broken"), "incompatible").when(F.col("version") == CURRENT_VERSION, "compatible").when(old, "migratable").otherwise("unknown")
    return manifests.join(broken, on, "left").select(on, "version", status.alias("status"))


def migration_plan(manifests: DataFrame) -> DataFrame:
    plans = manifests.sparkSession.createDataFrame(MIGRATIONS, "version string, target string")
    return manifests.join(F.broadcast(plans), "version", "left")


def migrate(manifests: DataFrame, defaults: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(manifests brought to the current version, those that cannot be)."""
    ok = F.col("version").isin([a for a, _ in MIGRATIONS] + [CURRENT_VERSION])
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in manifests.columns else F.lit(v) for c, v in defaults.items()}
    return manifests.where(ok).withColumns(filled | {"version": F.lit(CURRENT_VERSION)}), manifests.where(~ok)


def health(problems: DataFrame, streams: DataFrame, on: str = "case_id") -> DataFrame:
    """Counts of problems and malformed records of each group, whether it can be recovered, and what to do."""
    counts = problems.groupBy(on).agg(*[F.count_if(F.col("problem") == p).alias(p) for p in ("missing", "mismatched", "unexpected")])
    bad = streams.groupBy(on).agg(F.sum("records").alias("records"), F.sum("malformed").alias("malformed"))
    rows = bad.join(counts, on, "left").fillna(0)
    advice = F.array_compact(F.array(
        F.when(F.col("missing") > 0, "restore missing files"), F.when(F.col("mismatched") > 0, "verify the source of changed files"), F.when(F.col("malformed") > 0, "repair malformed records")))
    return rows.select("*", ((F.col("missing") == 0) & (F.col("malformed") == 0)).alias("recoverable"), advice.alias("recommendations"))
