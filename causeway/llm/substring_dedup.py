"""Substring dedup: repeated passages of words, and repeated or nearly repeated paragraphs, go, but for their first occurrence."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.memory import trimmed
from causeway.llm.near import BANDS, Banding, band_rows, near_links
from causeway.llm.passages import repeated_runs, texts_alone
from causeway.llm.tables import rows_of, split_by_keys, text_key, without
from causeway.llm.words import constants, mix, word_hashes
from causeway.session import checkpointed

#: A pair of Jaccard 0.8 meets in one of 20 bands of four rows with chance 0.99997.
PRODUCTION = Banding(bands=20, rows=4, threshold="0.8")
#: Shorter paragraphs are left alone: headings and short sentences repeat by nature.
LEAST_WORDS = 40
#: A passage of so many words or more that occurred before goes, wherever it stands: twice FINGER.
PASSAGE_WORDS = 50
#: Words in a fingerprint of a passage.
FINGER = 25
_POSITION_BITS = 24
_WORD = re.compile(rb"[^ \t-\r]+")


def _paragraphs(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                rows, places, out = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    for place, line in enumerate(text.split("\n")):
                        if len(line) >= 2 * least_words - 1 and len(line.encode().split()) >= least_words:
                            rows.append(row)
                            places.append(place)
                            out.append(line)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(rows)), part.column("key").take(pa.array(rows)), pa.array(places, pa.int32()), pa.array(out)],
                        ["doc_id", "key", "place", "text"],
                    )

    return run


def _paragraph_bands(least_words: int, banding: Banding):
    """Bands of the paragraphs of texts, in one worker; a paragraph's cid is Spark's xxhash64 of its text_key."""
    paragraphs, bands = _paragraphs(least_words), band_rows(banding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units() -> Iterator[pa.RecordBatch]:
            for batch in paragraphs(texts_alone(batches)):
                keys = [hashlib.md5(t).digest() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                cid = np.array([xxhash.xxh64_intdigest(k, seed=42) for k in keys], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cid), batch.column("text")], ["cid", "text"])

        yield from bands(units())

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose column ``text`` loses the lines numbered in ``_cw_places``."""
    for batch in trimmed(batches):
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            texts = []
            for text, places in zip(part.column("text").to_pylist(), part.column("_cw_places").to_pylist()):
                if text is not None and places:
                    drop = set(places)
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
                texts.append(text)
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def beside(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows of ``docs`` that may have a match in ``gone``, with its further columns as _cw_; the rows that have none; those columns)."""
    extra = [c for c in gone.columns if c not in ("doc_id", "key")]
    gone = checkpointed(gone.withColumn("_cw_hash", F.xxhash64("doc_id", "key")))
    touched, rest = split_by_keys(without(docs, *extra), F.xxhash64("doc_id", text_key(F.col("text"))), gone.select("_cw_hash"), both=True)
    there = gone.select(F.col("doc_id").alias("_cw_id"), F.col("key").alias("_cw_key"), *[F.col(c).alias(f"_cw_{c}") for c in extra])
    joined = touched.join(there, touched["doc_id"].eqNullSafe(F.col("_cw_id")) & (text_key(touched["text"]) == F.col("_cw_key")), "left")
    return joined.select(*[touched[f"`{c}`"] for c in touched.columns], *[F.col(f"_cw_{c}") for c in extra]), rest, extra


def drop_lines(docs: DataFrame, gone: DataFrame, cut=_cut) -> DataFrame:
    """``docs`` with its columns, ``text`` without the lines listed in ``gone``.

    ``gone`` has doc_id, key (see :func:`text_key`), places (line numbers) and any more
    columns, which are added. A row of ``docs`` without a match keeps its text.
    """
    rows, rest, extra = beside(docs, gone)
    changed = rows.mapInArrow(cut, rows.schema).select(*[f"`{c}`" for c in rest.columns], *[F.col(f"_cw_{c}").alias(c) for c in extra])
    return changed.unionByName(rest.select("*", *[F.lit(None).cast(rows.schema[f"_cw_{c}"].dataType).alias(c) for c in extra]))


def _passage_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of PASSAGE_WORDS words, filed under the least fingerprint in them (the last of equals).

    A column ``places``, if there, lists lines of which no window may hold a word.
    """
    for batch in trimmed(batches):
        places = batch.column("places").to_pylist() if "places" in batch.schema.names else None
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 19):
                size += len(texts[to])
                to += 1
            found = _chunk_marks(texts[at:to], None if places is None else places[at:to])
            if found is not None:
                fp, row, start, blobs = found
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(start.astype(np.int32)), pa.array(np.full(len(fp), PASSAGE_WORDS, np.int32)), blobs],
                    ["fp", "doc_id", "key", "start", "width", "hashes"],
                )
            at = to


def _chunk_marks(texts: list[bytes], places: list | None):
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = len(words) - PASSAGE_WORDS + 1
    if n < 1:
        return None
    with np.errstate(over="ignore"):
        fives = sum(words[j : len(words) - 4 + j] * c for j, c in enumerate(constants(5, 51)))
        fives = mix(fives)
        g = mix(sum(fives[5 * j : len(fives) - 20 + 5 * j] * c for j, c in enumerate(constants(5, 52))))
        a, b = constants(2, 53)
        windows = mix(g[:n] * a + g[FINGER : FINGER + n] * b)
    if len(g) >> _POSITION_BITS:
        raise ValueError("a text of more than 16 million words")
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))  # of equals the last is the least
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[:-10], least[10:])[:n]
    chosen = (low - (least & low)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    good = doc[:n] == doc[PASSAGE_WORDS - 1 :]
    if places is not None and any(places):
        barred = np.zeros(len(words) + 1, np.int64)
        for i, lines in enumerate(places):
            if lines:
                drop = np.zeros(texts[i].count(b"\n") + 1, bool)
                drop[lines] = True
                barred[1 + ends[i] - counts[i] : 1 + ends[i]] = np.repeat(drop, [len(x.split()) for x in texts[i].split(b"\n")])
        barred = np.cumsum(barred)
        good &= barred[PASSAGE_WORDS:] == barred[:n]
    at = np.flatnonzero(good)
    if not len(at):
        return None
    new = np.flatnonzero(np.concatenate([[True], (chosen[at[1:]] != chosen[at[:-1]]) | (at[1:] != at[:-1] + 1)]))
    offsets = np.concatenate([new, [len(at)]]) * 8
    blobs = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(windows[at].tobytes())])
    first = at[new]
    return g[chosen[first]], doc[first], first - (ends - counts)[doc[first]], blobs


def _without_spans(text: bytes, lines: list | None, spans: list | None) -> tuple[bytes, list[int]]:
    """(what is left, numbers of the lines that lost words)."""
    drop, out, touched, word = set(lines or ()), [], [], 0
    gone = np.zeros(max((s["last"] for s in spans or ()), default=-1) + 2, bool)
    for s in spans or ():
        gone[s["first"] : s["last"] + 1] = True
    for number, line in enumerate(text.split(b"\n")):
        found = [m.span() for m in _WORD.finditer(line)]
        lost = [i for i in range(len(found)) if word + i < len(gone) and gone[word + i]]
        word += len(found)
        if number in drop or lost:
            touched.append(number)
        if number in drop or (lost and len(lost) == len(found)):
            continue
        if lost:
            kept, at = [], 0
            for i in lost:  # a word goes with the white space after it
                kept.append(line[at : found[i][0]])
                at = found[i + 1][0] if i + 1 < len(found) else len(line)
            line = b"".join([*kept, line[at:]])
            if lost[-1] == len(found) - 1:
                line = line.rstrip(b" \t\r\x0b\x0c")
        out.append(line)
    return b"\n".join(out), touched


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose column ``text`` loses the lines in ``_cw_places`` and the words in ``_cw_spans``; places become all lines touched."""
    for batch in trimmed(batches):
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            texts, touched = [], []
            for text, lines, spans in zip(*(part.column(c).to_pylist() for c in ("text", "_cw_places", "_cw_spans"))):
                if text is not None and (lines or spans):
                    left, lines = _without_spans(text.encode(), lines, spans)
                    text = left.decode()
                texts.append(text)
                touched.append(lines)
            part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            at_places = part.schema.get_field_index("_cw_places")
            yield part.set_column(at_places, part.schema.field(at_places).with_nullable(True), pa.array(touched, part.schema.field(at_places).type))


def passages_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, key, spans, kept_in): passages of PASSAGE_WORDS words or more of what ``gone`` leaves that occurred earlier."""
    touched, rest, _ = beside(rows.select("doc_id", "text", "key"), gone.select("doc_id", "key", "places"))
    live = touched.withColumnRenamed("_cw_places", "places").unionByName(rest.withColumn("places", F.lit(None).cast("array<int>")))
    runs = repeated_runs(rows.select("doc_id", "key", "text"), _passage_marks, live.select("doc_id", "key", "text", "places"))
    return runs.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"), F.collect_set("source").alias("kept_in"))


def substring_dedup(docs: DataFrame, banding: Banding = PRODUCTION, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with repeated passages and paragraphs cut out of ``text``, and four more columns.

    A word is a run of characters other than white space of ASCII; a paragraph is a line
    of at least ``least_words`` words. Two paragraphs are alike if the Jaccard coefficient
    of their sets of five-word shingles reaches the threshold; bands give candidates with
    the stated recall, then all pairs of a candidate component are compared exactly. Of
    each connected component of alike paragraphs the first occurrence, in the order of
    (doc_id, text, line), stays; all others are removed. Of what is left, every run of
    PASSAGE_WORDS words or more that occurred earlier is cut out word by word, wherever
    in lines it starts and ends; windows are compared by 64-bit hashes of all their words.

    Added: ``places`` (numbers of the lines removed in full or in part, null if none),
    ``spans`` (first and last word, counted through the text, of the cut passages; they
    may overlap), ``n_removed`` (how many lines lost words) and ``kept_in`` (doc_ids that hold
    the copies that stayed, but for null ones). A text that is null or has no repetition
    stays as it is; one that is removed in full becomes empty. Rows equal in doc_id and
    text are one document and get the same result each. A null doc_id comes first. Other
    columns pass; one named like an added column is replaced.
    """
    rows = rows_of(docs).where("text is not null").withColumn("key", text_key(F.col("text")))
    paragraphs = rows.mapInArrow(_paragraphs(least_words), "doc_id long, key binary, place int, text string")
    bands = rows.select("text").mapInArrow(_paragraph_bands(least_words, banding), BANDS)
    near = near_links(paragraphs.select("text"), text_key(F.col("text")), banding, bands)
    found = paragraphs.select("doc_id", "key", "place", text_key(F.col("text")).alias("uid"))
    found = found.join(near.select("uid", "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    spot = F.struct("doc_id", "key", "place")
    firsts = found.groupBy("root").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first < last")
    later = found.join(firsts, "root").where(spot > F.col("first"))
    lines = checkpointed(later.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set("place")).alias("places"),
        F.collect_set(F.col("first")["doc_id"]).alias("kept_in"),
    ))
    both = lines.withColumn("spans", F.lit(None).cast("array<struct<first:int,last:int>>")).unionByName(
        passages_gone(rows, lines).withColumn("places", F.lit(None).cast("array<int>")))
    gone = both.groupBy("doc_id", "key").agg(
        F.first("places", ignorenulls=True).alias("places"), F.first("spans", ignorenulls=True).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"),
    )
    return drop_lines(without(docs, "n_removed"), gone, _cut_spans).withColumn("n_removed", F.coalesce(F.array_size("places"), F.lit(0)).cast("long"))
