"""Protocols and registries: source adapters, their coordinator, invariant handlers, analyzer plugins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from causeway.operators import apart
from causeway.sources import traces


class SourceAdapter(Protocol):
    """Discovers, collects and normalises records of one source, all lazily."""

    source_id: str

    def discover(self, spark: SparkSession, selectors: DataFrame) -> DataFrame: ...

    def collect(self, spark: SparkSession, candidates: DataFrame) -> DataFrame: ...

    def normalize(self, records: DataFrame) -> dict[str, DataFrame]: ...


class AnalyzerPlugin(Protocol):
    """Gives findings for all cases of some tables."""

    def analyze(self, tables: dict[str, DataFrame]) -> DataFrame: ...


@dataclass
class TableSource:
    """An adapter over a DataFrame that already has canonical columns."""

    source_id: str
    rows: DataFrame
    table: str
    columns: dict[str, str]
    key: str

    def discover(self, spark: SparkSession, selectors: DataFrame) -> DataFrame:
        return traces.discover(self.rows, selectors, self.columns)

    def collect(self, spark: SparkSession, candidates: DataFrame) -> DataFrame:
        return traces.collect(self.rows, candidates, self.key)

    def normalize(self, records: DataFrame) -> dict[str, DataFrame]:
        return {self.table: records}


@dataclass
class Collection:
    """What a coordinator gathered: tables by name, status by source, and whether a source failed."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)

    @property
    def partial(self) -> bool:
        return any(s != "completed" for s in self.status.values())


def collect_all(spark: SparkSession, sources: list[SourceAdapter], selectors: DataFrame, tenant: str | None = None) -> Collection:
    """Run every source; one whose plan fails, or that holds another tenant, is left out and the others go on."""
    out = Collection()
    for source in sources:
        try:
            parts = source.normalize(source.collect(spark, source.discover(spark, selectors)))
            for df in parts.values():
                df.schema  # a plan that cannot be made fails here
                if tenant is not None and "tenant_id" in df.columns and not df.where("tenant_id is not null").where(df["tenant_id"] != tenant).isEmpty():
                    raise PermissionError(f"{source.source_id} holds records of another tenant")
        except Exception as error:  # noqa: BLE001  one source's failure is its own
            out.status[source.source_id] = f"failed: {type(error).__name__}: {error}"[:300]
            continue
        for name, df in parts.items():
            out.tables[name] = out.tables[name].unionByName(df, allowMissingColumns=True) if name in out.tables else df
        out.status[source.source_id] = "completed"
    return out


def collect_apart(spark: SparkSession, sources: list[SourceAdapter], selectors: DataFrame, tenant: str | None = None) -> Collection:
    """As :func:`collect_all`, with each source as a job of its own: one that fails in a task is left out too.

    A source's tables count only if all of them were written; rows of another tenant, in any of them, fail it.
    """

    def in_scope(name: str, tables: dict[str, DataFrame]) -> None:
        for df in tables.values():
            if tenant is not None and "tenant_id" in df.columns and not df.where(df["tenant_id"] != tenant).isEmpty():
                raise PermissionError(f"{name} holds records of another tenant")

    jobs = {s.source_id: lambda s=s: s.normalize(s.collect(spark, s.discover(spark, selectors))) for s in sources}
    if len(jobs) < len(sources):
        raise ValueError("two sources have the same id")
    out = Collection()
    for name, outcome in apart.run(spark, jobs, in_scope).items():
        out.status[name] = f"failed: {outcome.error}" if outcome.error else "completed"
        for table, df in outcome.tables.items():
            out.tables[table] = out.tables[table].unionByName(df, allowMissingColumns=True) if table in out.tables else df
    return out


def status_table(spark: SparkSession, collection: Collection) -> DataFrame:
    """(source_id, status, error): a row a source."""
    rows = [(name, said.split(":")[0], said.partition(": ")[2] or None) for name, said in collection.status.items()]
    return spark.createDataFrame(rows, "source_id string, status string, error string")


class Registry:
    """Functions by (id, version); a second registration of the same is an error."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Callable] = {}

    def register(self, name: str, version: str, function: Callable) -> None:
        if (name, version) in self._known:
            raise ValueError(f"{name} {version} is registered already")
        self._known[name, version] = function

    def get(self, name: str, version: str) -> Callable:
        return self._known[name, version]

    def list(self) -> list[tuple[str, str]]:
        return sorted(self._known)
