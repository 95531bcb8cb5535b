"""Token-ID files: documents in order of doc_id, their ids range-coded in shards that Spark writes and reads."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.memory import trimmed
from causeway.llm.rangecoder import read_shard, write_shard
from causeway.llm.tables import rows_of
from causeway.llm.tokens import default_path, encoder, grouped
from causeway.session import shared_folder

END_ID = 2
#: Ids of a shard, unless one document has more.
SHARD_IDS = 1 << 22


def _shards(path: str, end_id: int, shard_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            data = write_shard(doc_ids, np.array([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), "<u4"))
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "shard", "n_tokens", "data"])

        for batch in trimmed(batches):
            own = batch.column("doc_id").to_pylist()
            for first, texts in grouped([t or "" for t in batch.column("text").to_pylist()]):
                for doc_id, got in zip(own[first:], encode(texts)):
                    doc_ids.append(doc_id)
                    ids.append(got + end)
                    size += len(got) // 4 + 1
                    if size >= shard_ids:
                        yield close()
                        doc_ids, ids, size, number = [], [], 0, number + 1
        if doc_ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text of ``docs`` (null: empty), add ``end_id`` and write token files into ``folder``.

    Rows are dealt by ranges of (doc_id, text hash) and sorted, so the files, taken by
    (part, shard), hold all documents in ascending order of doc_id, null ids first. Each
    file is a value of :func:`rangecoder.write_shard` in a Parquet row, which any store
    that Spark writes to can hold. Repeated rows are documents of their own; other
    columns are ignored. An empty table writes no file.
    """
    rows = rows_of(docs).withColumn("key", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    placed.mapInArrow(_shards(path or default_path(), end_id, shard_ids), "part int, shard int, n_tokens long, data binary").write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits) of what was written."""
    files = spark.read.parquet(folder)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = files.select("part", "shard", "n_tokens").withColumn("own", before(Window.partitionBy("part").orderBy("shard"), "n_tokens"))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", before(Window.orderBy("part"), "n"))
    starts = within.join(parts, "part").select("part", "shard", (F.col("own") + F.col("base")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for data, first in zip(batch.column("data"), batch.column("first").to_pylist()):
                doc_ids, sizes, ids = read_shard(data.as_py())
                starts, raw = np.cumsum(sizes) - sizes, memoryview(ids.astype("<u4").tobytes())
                for at in range(0, len(doc_ids), 1000):
                    some = slice(at, at + 1000)
                    texts = [bytes(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts[some], sizes[some])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[some], pa.int64()), pa.array(starts[some] + first), pa.array(sizes[some].astype(np.int64)), pa.array(texts, pa.binary()),
                         pa.array([zlib.crc32(x) for x in texts], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                    )

    rows = files.join(starts, ["part", "shard"]).select("first", "data")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def through_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path, end_id)
    return read_token_files(spark, folder)
