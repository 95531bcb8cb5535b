"""Language identification by the nearest of several centroids a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.memory import small_batches, trimmed

DIMENSIONS, CENTROIDS = 4096, 4
#: Documents that the centroids are fitted on: a language at most, and in all. They are
#: a sample by hash of the labelled rows; everything else covers all rows.
SAMPLE_OF_LANGUAGE, SAMPLE = 400, 2000
UNKNOWN = "und"


_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def term_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed byte n-grams (one to three) of a whole text in lower case, where
    all that lies between letters is one space."""
    b = np.frombuffer(f" {text.lower()} ".encode(errors="replace").translate(_LETTERS), np.uint8)
    b = b[(b != 32) | np.concatenate([[True], b[:-1] != 32])].astype(np.uint32)
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    out = np.zeros(dimensions, np.int64)
    pair = b[:-1] * np.uint32(257) + b[1:]
    for code, factor in ((b + np.uint32(1), 2654435769), (pair, 2246822519), (pair[:-1] * np.uint32(263) + b[2:], 3266489917)):
        out += np.bincount((code * np.uint32(factor)) >> shift, minlength=dimensions)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Unit centroids with their languages, and the least cosine each language accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the nearest centroid, cosine, rejected) of texts with a letter."""
        cosine = _weighted(np.stack([term_counts(t, len(self.idf)) for t in texts]), self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return best, score, score < self.least[best]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means, begun from the farthest points."""
    centers = [x.mean(axis=0)]
    while len(centers) < min(k, len(x)):
        near = np.max(x @ (np.stack(centers) / np.linalg.norm(np.stack(centers), axis=1, keepdims=True)).T, axis=1)
        centers.append(x[near.argmin()])
    c = np.stack(centers)
    for _ in range(15):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(counts: np.ndarray, languages: list[str], k: int = CENTROIDS) -> Model:
    """``counts``: a row a labelled text. The least accepted cosine is half the least seen in a language."""
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x, labels = _weighted(counts, idf), np.array(languages)
    parts, names, least = [], [], []
    for name in sorted(set(languages)):
        own = x[labels == name]
        c = _cluster(own, k)
        parts.append(c)
        names += [name] * len(c)
        least += [float((own @ c.T).max(axis=1).min()) / 2] * len(c)
    return Model(idf, np.concatenate(parts).astype(np.float32), names, np.array(least, np.float32))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, dimensions: int = DIMENSIONS, of_language: int = SAMPLE_OF_LANGUAGE, in_all: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang) that are not held out; None without any."""
    usable = docs.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    most = max(20, min(of_language, in_all // len(sizes)))
    chance = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, most / n)))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30) < chance[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            rows = [(lang, np.minimum(term_counts(t, dimensions), 2**31 - 1).astype("<u4").tobytes()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "counts"])

    rows = drawn.select("lang", "text").mapInArrow(features, "lang string, counts binary").collect()  # bounded by the sample
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    return fit(np.stack([np.frombuffer(r["counts"], "<u4") for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, key of the text, lang_pred, score (0 to 1) and ``rejected`` of every row of ``docs``.

    ``docs`` has doc_id, text and, where no model is given, lang to learn from. The
    prediction sees the whole text and nothing else: TF-IDF over hashed byte n-grams,
    normalised, against the centroids by cosine. ``rejected`` is true where the nearest
    centroid is farther than its language accepts, and for texts that are null or have
    no letter, which get "und" and score 0. Without labelled rows all get that. Repeated
    rows and null ids come back as they are; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = model or train(docs)
    return docs.select("doc_id", "text").mapInArrow(_identify(model), "doc_id long, lang_pred string, score double, rejected boolean")


def _predictions(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    at = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    if at:
        for i, best, score, out in zip(at, *model.predict([texts[i] for i in at])):
            names[i], scores[i], rejected[i] = model.languages[best], float(score), bool(out)
    return names, scores, rejected


def _identify(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                names, scores, rejected = _predictions(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"]
                )

    return run


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`identify` does not reject; no shuffle."""
    small_batches(docs.sparkSession)
    model = model or train(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rejected = _predictions(model, part.column(part.schema.get_field_index("text")).to_pylist())[2]
                yield part.filter(pa.array([not r for r in rejected]))

    return docs.mapInArrow(keep, docs.schema)
