"""Line dedup by winnowing: runs of lines that occurred before are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.memory import trimmed
from causeway.llm.passages import MARKS, repeated_runs
from causeway.llm.substring_dedup import drop_lines
from causeway.llm.tables import rows_of, text_key, without
from causeway.llm.words import constants, mix

#: Repeated runs of this many lines or more are found without fail.
WINDOW = 3
#: Shorter runs are found without fail if their lines have so many words together.
LEAST_WORDS = 20


def winnow(lines: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of line hashes: the place of its minimum (the last of equals), and its own hash."""
    views = np.lib.stride_tricks.sliding_window_view(lines, window)
    low = window - 1 - views[:, ::-1].argmin(axis=1)
    with np.errstate(over="ignore"):
        return low + np.arange(len(views)), mix((views * constants(window, 31)).sum(axis=1, dtype=np.uint64))


def _filled(text: str) -> list[tuple[int, str]]:
    return [(i, x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()]


def _line_marks(window: int, least_words: int):
    """Windows of ``window`` lines, and shorter ones of ``least_words`` words, a row for each selected minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                counts, lines = [], []
                for text in part.column("text").to_pylist():
                    before = len(lines)
                    lines += [x.encode() for _, x in _filled(text)]
                    counts.append(len(lines) - before)
                if lines:
                    hashes = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in lines]), np.uint64)
                    words = np.cumsum([0, *[len(x.split()) for x in lines]])
                    row = np.repeat(np.arange(len(counts)), counts)
                    first = np.cumsum(counts) - counts  # of all lines, the first of a text
                    for width in range(1, min(window, len(lines)) + 1):
                        low, whole = winnow(hashes, width)
                        good = row[: len(low)] == row[width - 1 :]
                        if width < window:
                            good &= words[width:] - words[:-width] >= least_words
                        spot = np.flatnonzero(good)
                        if not len(spot):
                            continue
                        new = np.flatnonzero(np.concatenate([[True], (low[spot[1:]] != low[spot[:-1]]) | (spot[1:] != spot[:-1] + 1)]))
                        start = spot[new]
                        with np.errstate(over="ignore"):
                            fp = mix(hashes[low[start]] + np.uint64(width))
                        take = pa.array(row[start])
                        offsets = (np.append(new, len(spot)) * 8).astype(np.int32)
                        blobs = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole[spot].tobytes())])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(fp.view(np.int64)), part.column("doc_id").take(take), part.column("key").take(take), pa.array((start - first[row[start]]).astype(np.int32)), pa.array(np.full(len(new), width, np.int32)), blobs],
                            [c.split()[0] for c in MARKS.split(", ")],
                        )

    return run


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose column ``text`` loses the runs in ``_cw__cw_runs`` (counted without blank lines); places become the lines lost."""
    for batch in trimmed(batches):
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            texts, places = [], []
            for text, runs in zip(part.column("text").to_pylist(), part.column("_cw__cw_runs").to_pylist()):
                drop = None
                if text is not None and runs:
                    lines = [i for i, _ in _filled(text)]
                    drop = {i for r in runs for i in range(lines[r["first"]], lines[r["last"]] + 1)}
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                texts.append(text)
                places.append(drop and sorted(drop))
            part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield part.set_column(part.schema.get_field_index("_cw_places"), "_cw_places", pa.array(places, pa.list_(pa.int32())))


def line_dedup(docs: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with repeated runs of lines cut out of ``text``, and three more columns.

    Lines that hold more than white space are hashed, and of every ``window`` of them
    the minimum is the fingerprint (the last of equals); a window of fewer lines has one
    too if they hold ``least_words`` words together. Consecutive windows with one minimum
    are one row. Occurrences of a fingerprint are joined and told apart by the windows
    around it; those that match extend each other both ways to the whole run. A run of
    ``window`` lines or ``least_words`` words or more that equals one that comes earlier
    in the order (doc_id, text, line) is deleted, with the blank lines inside it, so that
    the earliest occurrence stays. Runs within one document count too; where such a run
    overlaps the earlier one, its first period stays. Runs of fewer lines and words are
    left alone.

    Added: ``places`` (line numbers removed, null if none), ``n_removed`` and
    ``copied_from`` (doc_ids of the first occurrences). Null texts and texts without
    such runs stay as they are; one that is removed in full becomes empty. Rows equal in
    doc_id and text are one document and get the same result each. A null doc_id
    comes first. Other columns pass; one named like an added column is replaced.
    """
    rows = rows_of(docs).where("text is not null").withColumn("key", text_key(F.col("text")))
    runs = repeated_runs(rows, _line_marks(window, least_words))
    gone = runs.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("_cw_runs"), F.sort_array(F.collect_set("source")).alias("copied_from"))
    cut = drop_lines(without(docs, "n_removed"), gone.withColumn("places", F.lit(None).cast("array<int>")), _cut_runs)
    return cut.drop("_cw_runs").withColumn("n_removed", F.coalesce(F.array_size("places"), F.lit(0)).cast("long"))
