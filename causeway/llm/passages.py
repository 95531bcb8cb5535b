"""Repeated runs of units (words or lines), found by winnowing and told apart by exact context.

Every window of units is filed under its minimal fingerprint, which is a function of what
the window holds; so equal windows meet under one fingerprint, and consecutive windows of
a document with one minimum are one row. Of all windows under a fingerprint the first
occurrence stays; windows that occurred before and overlap make up the whole run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.memory import trimmed
from causeway.llm.tables import split_by_keys
from causeway.session import checkpointed

#: A row: windows of ``width`` units, from unit ``start`` of a document on, with one fingerprint.
MARKS = "fp long, doc_id long, key binary, start int, width int, hashes binary"
_RUNS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("source", pa.int64())])


def _fresh(rows: list, last: tuple | None) -> list[int]:
    """Places of the rows that differ from the one before: a document given twice is one."""
    out = []
    for i, row in enumerate(rows):
        if row != last:
            out.append(i)
            last = row
    return out


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that occurred before; rows come in the order fp, doc_id, key, start, width."""
    last, open_fp, open_hashes, open_docs = None, None, np.zeros(0, np.uint64), []
    for batch in trimmed(batches):
        for at in range(0, len(batch), 5000):
            part = batch.slice(at, 5000)
            rows = list(zip(*(part.column(c).to_pylist() for c in ("fp", "doc_id", "key", "start", "width"))))
            keep = _fresh(rows, last)
            last = rows[-1]
            if not keep:
                continue
            blobs = part.column("hashes").to_pylist()
            rows, blobs = [rows[i] for i in keep], [blobs[i] for i in keep]
            if rows[0][0] != open_fp:
                open_hashes, open_docs = np.zeros(0, np.uint64), []
            sizes = np.array([len(b) // 8 for b in blobs])
            hashes = np.concatenate([open_hashes, np.frombuffer(b"".join(blobs), np.uint64)])
            before = len(open_hashes)
            row = np.repeat(np.arange(len(rows)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            docs = open_docs + [r[1] for r in rows]
            owner = np.concatenate([np.arange(before), before + row])
            _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            origin = first[of][before:]
            source, again = owner[origin], np.flatnonzero(origin < before + np.arange(len(row)))
            if len(again):
                r, p, s = row[again], place[again], source[again]
                new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1])]))
                ends = np.concatenate([new[1:], [len(again)]]) - 1
                found = [rows[i] for i in r[new]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary()),
                        pa.array([x[3] + int(i) for x, i in zip(found, p[new])], pa.int32()), pa.array([x[3] + int(i) + x[4] - 1 for x, i in zip(found, p[ends])], pa.int32()),
                        pa.array([docs[i] for i in s[new]], pa.int64()),
                    ],
                    schema=_RUNS,
                )
            fp = rows[-1][0]
            fresh = np.sort(first)
            mine = [i for i in fresh if (i < before and fp == open_fp) or (i >= before and rows[owner[i] - before][0] == fp)]
            open_fp, open_hashes, open_docs = fp, hashes[mine], [docs[owner[i]] for i in mine]


def texts_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts with null ids beside them, where nobody asks whose texts they are."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.binary()), b.column("text")], ["doc_id", "key", "text"])


def _fingerprints(marks: Callable):
    """The fingerprints alone of what ``marks`` makes of texts; nothing else has to leave the worker to count them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in marks(texts_alone(batches)):
            yield batch.select(["fp"])

    return run


def repeated_runs(rows: DataFrame, marks: Callable, live: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, first, last, source): runs of units all of whose windows occurred earlier.

    ``marks`` makes rows as in ``MARKS`` of batches of ``rows``; ``live``, by default the
    same, may leave out parts of documents that neither count as occurrences nor go.
    Earlier is in the order (doc_id, key, place); ``source`` is the doc_id of the first
    occurrence. Only windows under a fingerprint that occurs more than once move.
    """
    counted = rows.select("text").mapInArrow(_fingerprints(marks), "fp long").groupBy("fp").agg(F.count("*").alias("n"))
    again = checkpointed(counted.where("n > 1").select("fp"))
    wanted, _ = split_by_keys((rows if live is None else live).mapInArrow(marks, MARKS), F.col("fp"), again)
    return wanted.repartition("fp").sortWithinPartitions("fp", "doc_id", "key", "start", "width").mapInArrow(_later, "doc_id long, key binary, first int, last int, source long")
