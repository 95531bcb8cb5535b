"""Stored cases as a Spark data source: canonical JSON and JSONL files for each case, in a folder or in one archive.

An archive holds the files of the folder, deflated: about a tenth of the disk, and one file instead of ten or more.
Reading takes both, side by side; it gives a row a record, or a row a file with its count or digest; writing puts each case into
place whole, by a rename after all tasks have ended. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The files of a stored case.
DOCUMENTS = {
    "manifest": "manifest.json",
    "case": "specification/case.json",
    "system": "specification/system_snapshot.json",
    "sources": "provenance/sources.json",
    "execution": "model/execution.json",
    "interpretations": "analysis/interpretations.json",
}
LINES = {
    "nodes": "model/nodes.jsonl",
    "relations": "model/relations.jsonl",
    "contexts": "model/contexts.jsonl",
    "observations": "evidence/observations.jsonl",
    "state_facts": "evidence/state_facts.jsonl",
    "effects": "evidence/effects.jsonl",
}
REQUIRED = ("manifest", "case", "system", "execution")
INDEX = "integrity/content_index.json"
FILES = DOCUMENTS | LINES
SUFFIX = ".case"
STAGING = "_staging"
SCHEMA = "case_id string, entity string, line long, record string, problem string"
_BATCH = 2000
#: Cases of a partition at least, and how many partitions a larger store is dealt to.
CASES, PARTITIONS = 64, 128
#: What a row says: a record, the number of records of a table (a document stays a record), or size and digest of a file.
DETAILS = ("records", "counts", "digests")
#: How a case is written.
FORMS = ("folders", "archives")
#: What a damaged archive raises, when it is opened or while a file of it is read.
DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError)
#: Renames and deletions that are under way at once.
AT_ONCE = 16


_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
_DECODER = json.JSONDecoder()


def canonical(value) -> str:
    """Keys in order, no spaces, no escapes of letters, and a line end."""
    return _CANONICAL.encode(value) + "\n"


def parsed(text: str):
    """As ``json.loads``, without its cost for each of many short texts; spaces around the text must be gone."""
    value, end = _DECODER.raw_decode(text)
    if end != len(text):
        raise json.JSONDecodeError("Extra data", text, end)
    return value


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _each(do: Callable, items: Iterable) -> list:
    """``do`` of all items side by side; the first error is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(do, items))


class _Folder:
    """A case that is written as a folder."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.system, self.path, self.made = system, path, set()

    def opened(self, name: str):
        path = f"{self.path}/{name}"
        if (place := path.rsplit("/", 1)[0]) not in self.made:
            self.system.create_dir(place, recursive=True)
            self.made.add(place)
        return self.system.open_output_stream(path)

    def close(self) -> None:
        pass


class _Archive:
    """A case that is written as one archive, as a stream; its bytes depend on its files alone."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path, buffer_size=1 << 16)
        self.files = zipfile.ZipFile(self.out, "w")

    def opened(self, name: str):
        entry = zipfile.ZipInfo(name)  # dated 1980
        entry.compress_type = zipfile.ZIP_DEFLATED
        return self.files.open(entry, "w", force_zip64=True)

    def close(self) -> None:
        self.files.close()
        self.out.close()


@contextmanager
def _files(system: fs.FileSystem, path: str) -> Iterator[Callable]:
    """What opens a file of a stored case, be it a folder or an archive; FileNotFoundError where there is none."""
    if system.get_file_info(path).type != fs.FileType.File:
        yield lambda name: system.open_input_stream(f"{path}/{name}")
        return
    with system.open_input_file(path) as whole, zipfile.ZipFile(whole) as archive:
        known = set(archive.namelist())

        def opened(name: str):
            if name not in known:
                raise FileNotFoundError(name)
            return archive.open(name)

        yield opened


@dataclass
class Cases(InputPartition):
    names: list[str]


@dataclass
class Staged(WriterCommitMessage):
    folder: str | None


class CaseReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.entities = [e for e in options.get("entities", ",".join(FILES)).split(",") if e]
        self.each, self.detail = int(options.get("casesPerPartition", "0")), options.get("detail", "records")
        if self.detail not in DETAILS:
            raise ValueError(f"unknown detail: {self.detail}")
        if unknown := set(self.entities) - set(FILES):
            raise ValueError(f"unknown entities: {sorted(unknown)}")

    def partitions(self) -> list[Cases]:
        system, root = _opened(self.root)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(SUFFIX))
        each = self.each or max(CASES, -(-len(names) // PARTITIONS))
        return [Cases(names[i : i + each]) for i in range(0, len(names), each)] or [Cases([])]

    def read(self, partition: Cases) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("case_id", pa.string()), ("entity", pa.string()), ("line", pa.int64()), ("record", pa.string()), ("problem", pa.string())])
        rows: list[tuple] = []
        for name in partition.names:
            for row in self._records(name):
                rows.append(row)
                if len(rows) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def _records(self, name: str) -> Iterator[tuple]:
        system, root = _opened(self.root)
        case_id = unquote(name[: -len(SUFFIX)])
        try:
            with _files(system, f"{root}/{name}") as opened:
                for entity in self.entities:
                    yield from self._of_entity(case_id, entity, opened)
        except DAMAGED as error:
            if self.detail == "digests":
                raise
            yield case_id, self.entities[0], None, None, f"{name}: {type(error).__name__}"

    def _of_entity(self, case_id: str, entity: str, opened: Callable) -> Iterator[tuple]:
        try:
            stream = opened(FILES[entity])
        except FileNotFoundError:
            if entity in REQUIRED and self.detail != "digests":
                yield case_id, entity, None, None, f"missing: {FILES[entity]}"
            return
        with stream:
            if self.detail == "digests":
                digest = hashlib.sha256()
                size = 0
                while part := stream.read(1 << 20):
                    digest.update(part)
                    size += len(part)
                yield case_id, entity, size, "sha256:" + digest.hexdigest(), None
                return
            counted = self.detail == "counts" and entity in LINES
            good = number = 0
            texts = enumerate(io.BufferedReader(stream) if entity in LINES else iter(stream.read, b""), 1)
            try:
                for number, raw in texts:
                    if not raw.strip():
                        continue
                    try:
                        text = raw.decode().strip()
                        parsed(text)
                    except ValueError as error:
                        yield case_id, entity, number, None, f"{FILES[entity]}:{number}: {type(error).__name__}"
                        continue
                    if counted:
                        good += 1
                    else:
                        yield case_id, entity, number, text, None
            except DAMAGED as error:  # the lines before stand
                yield case_id, entity, number + 1, None, f"{FILES[entity]}:{number + 1}: {type(error).__name__}"
            if counted:
                yield case_id, entity, good, None, None


class CaseWriter(DataSourceArrowWriter):
    """Each task stages the cases it was given, with their content index; the commit renames them into the root."""

    def __init__(self, options, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.form = options.get("form", FORMS[0])
        if self.form not in FORMS:
            raise ValueError(f"unknown form: {self.form}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, root = _opened(self.root)
        folder = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        wrote = case = None
        done: set[str] = set()
        stream, digest, size, index, entity = None, None, 0, [], None
        files = None  # of the case
        lines: list[bytes] = []  # of the file, not yet written

        def flush() -> None:
            data = b"".join(lines)
            lines.clear()
            stream.write(data)
            digest.update(data)

        def close_file() -> None:
            if stream is not None:
                flush()
                stream.close()
                index.append({"digest": "sha256:" + digest.hexdigest(), "path": FILES[entity], "size_bytes": size})

        def close_case() -> None:
            if case is not None:
                with files.opened(INDEX) as out:
                    out.write(canonical({"entries": sorted(index, key=lambda e: e["path"])}).encode())
                files.close()

        rows = (row for b in batches for row in zip(*[b.column(c).to_numpy(zero_copy_only=False) for c in ("case_id", "entity", "record", "canonical")]))
        last = name = None
        for case_id, kind, record, as_it_is in rows:
            if case_id != last:
                last, name = case_id, quote(case_id, safe="") + SUFFIX
            if (name, kind) != (case, entity):
                close_file()
                stream = None
                if name != case:
                    close_case()
                    if name in done:
                        raise ValueError(f"rows of {case_id} do not stand together")
                    case, index, files = name, [], (_Archive if self.form == "archives" else _Folder)(system, f"{folder}/{name}")
                    done.add(name)
                entity = kind
                stream, digest, size, wrote = files.opened(FILES[entity]), hashlib.sha256(), 0, folder
            elif entity in DOCUMENTS:
                raise ValueError(f"{case_id} has several records of {entity}")
            line = (record + "\n" if as_it_is and "\\u" not in record else canonical(parsed(record.strip(" \t\n\r")))).encode()
            lines.append(line)
            size += len(line)
            if len(lines) >= _BATCH:
                flush()
        close_file()
        close_case()
        return Staged(wrote)

    def commit(self, messages: list[Staged]) -> None:
        system, root = _opened(self.root)
        staged = [f for found in _each(lambda m: system.get_file_info(fs.FileSelector(m.folder)), [m for m in messages if m and m.folder]) for f in found]
        there = {f.base_name: f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(SUFFIX)}
        if not self.overwrite and (twice := there.keys() & {f.base_name for f in staged}):
            raise ValueError(f"cases are stored already: {sorted(twice)[:5]}")
        if self.overwrite:
            _each(lambda f: (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path), there.values())
        _each(lambda f: system.move(f.path, f"{root}/{f.base_name}"), staged)
        self.abort(messages)

    def abort(self, messages: list[Staged]) -> None:
        system, root = _opened(self.root)
        staging = f"{root}/{STAGING}/{self.job}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class CaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cases"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaseReader:
        return CaseReader(self.options)

    def writer(self, schema, overwrite: bool) -> CaseWriter:
        return CaseWriter(self.options, overwrite)


def scan(spark: SparkSession, root: str, *entities: str, detail: str = "records") -> DataFrame:
    """(case_id, entity, line, record, problem) of the entities asked for, all if none is named. A record is null and the
    problem says why where a line is no JSON or a required file is missing; blank lines are skipped.

    With ``detail`` "counts" a table is one row, with the number of its records as ``line``, beside those of its problems;
    with "digests" every file is one row, with its size as ``line`` and its digest as ``record``."""
    spark.dataSource.register(CaseSource)
    reader = spark.read.format("cases").option("detail", detail)
    return (reader.option("entities", ",".join(entities)) if entities else reader).load(root)


def read_entity(spark: SparkSession, root: str, entity: str, schema: str) -> DataFrame:
    """One table over all cases, of ``schema`` and ``case_id``, in no order."""
    rows = scan(spark, root, entity).where("record is not null")
    return rows.select("case_id", F.from_json("record", schema).alias("r")).select("case_id", "r.*")


def load_cases(spark: SparkSession, root: str) -> DataFrame:
    """One row a case: its documents, the number of records of each table, of parts of the system, and its problems."""
    rows = scan(spark, root, detail="counts")
    document = lambda e: F.max(F.when(F.col("entity") == e, F.col("record"))).alias(e)
    count = lambda e: F.coalesce(F.sum(F.when((F.col("entity") == e) & F.col("problem").isNull(), F.col("line"))), F.lit(0)).alias(e)
    part = lambda p: F.size(F.from_json(F.get_json_object("system", f"$.{p}"), "array<string>")).alias(p)
    out = rows.groupBy("case_id").agg(*[document(e) for e in DOCUMENTS], *[count(e) for e in LINES], F.array_sort(F.collect_set("problem")).alias("problems"))
    return out.select("*", *[part(p) for p in ("components", "boundaries", "resources")])


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, format, version, problem) of every stored case; a damaged or missing manifest is a row with its problem."""
    m = F.from_json("record", "format string, version string")
    return scan(spark, root, "manifest").select("case_id", m["format"].alias("format"), m["version"].alias("version"), "problem")


def _plain(kind: T.DataType) -> bool:
    """Whether Spark writes every value as canonical JSON does: it does so but for the case of digits after ``\\u``."""
    return isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType)) or isinstance(kind, T.ArrayType) and _plain(kind.elementType)


def as_records(entity: str, rows: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of one table in the form that is stored; ``key`` orders the lines of a file. ``canonical`` says that a record
    needs no new encoding; without that column, and where it is not true, a record may be any JSON."""
    columns = sorted(c for c in rows.columns if c != "case_id")
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    plain = all(_plain(f.dataType) for f in rows.schema if f.name != "case_id")
    return rows.select("case_id", F.lit(entity).alias("entity"), (F.col(key) if key else F.lit("")).cast("string").alias("key"), record.alias("record"), F.lit(plain).alias("canonical"))


def by_case(parts: list[DataFrame]) -> DataFrame:
    """Records (see :func:`as_records`) in the order in which they are stored, all of a case in one task.

    The number of tasks is fixed: files cost by their number, so small records must not be put together into few tasks.
    Parts that are all dealt by ``case_id`` to as many tasks already stay where they are, so no record is shuffled."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows if "canonical" in rows.columns else rows.withColumn("canonical", F.lit(False))
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id").sortWithinPartitions("case_id", "entity", "key", "record").drop("key")


def save_cases(parts: list[DataFrame], root: str, mode: str = "append", form: str = "folders") -> None:
    """Store cases given as records, each as a folder or as an archive (``FORMS``). The rows of a case stream into its files."""
    rows = by_case(parts)
    rows.sparkSession.dataSource.register(CaseSource)
    rows.write.format("cases").option("form", form).mode(mode).save(root)


def content_index(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, path, size_bytes, digest) of the files of stored cases, from their content."""
    path = F.create_map(*[F.lit(x) for pair in FILES.items() for x in pair])
    rows = scan(spark, root, detail="digests")
    return rows.select("case_id", path[F.col("entity")].alias("path"), F.col("line").alias("size_bytes"), F.col("record").alias("digest"))
