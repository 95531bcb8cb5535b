"""Byte-level BPE by rank, encoded and decoded with DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from causeway.llm.memory import trimmed
from causeway.llm.tables import rows_of
from causeway.llm.tokens import default_path, grouped

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words of each of two generations that a worker keeps, words and bytes of one query of short words, bytes of the longest short word.
MOST_KEPT, WORDS_A_QUERY, BYTES_A_QUERY, LONGEST = 400_000, 20_000, 1 << 19, 256
#: Characters of the texts that share one round of queries.
GROUP_CHARS = 1 << 21

#: A state is a word's list of tokens. Its token-position rows meet the merge table, and the
#: word's leftmost pair of least rank is contracted, until no word has a pair.
ENCODE = """
WITH RECURSIVE state AS (
    SELECT word, tokens, 0 AS round FROM start
    UNION ALL
    SELECT s.word, list_concat(list_append(s.tokens[:pos - 1], merged), s.tokens[pos + 2:]), s.round + 1
    FROM state s JOIN (
        SELECT word, (min(key) & 65535) AS pos, (min(key) >> 16)::INT AS merged
        FROM (SELECT r.word, m.key + r.pos AS key
              FROM (SELECT word, (unnest(tokens[:-2])::BIGINT << 32) + unnest(tokens[2:]) AS pair, generate_subscripts(tokens[2:], 1) AS pos FROM state) r
              JOIN merges m USING (pair))
        GROUP BY word) b USING (word)
)
SELECT word, arg_max(tokens, round) AS tokens FROM state GROUP BY word
"""
#: The same for long words, whose rows stay and are changed by key. All occurrences of a
#: pair are contracted in one round, from the left and without overlap, unless a token that
#: arises may go into a pair of lesser rank: then ("alone") the leftmost one is.
ENCODE_LONG = """
WITH RECURSIVE state(word, pos, token) USING KEY (word, pos) AS (
    SELECT word, pos, token FROM start_rows
    UNION
    SELECT word, pos, token FROM (
        WITH live AS (
            SELECT word, pos, (token::BIGINT << 32) + lead(token) OVER w AS pair, lead(pos) OVER w AS next, row_number() OVER w AS place
            FROM recurring.state SEMI JOIN (SELECT DISTINCT word FROM state) USING (word) WHERE token >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)),
        best AS (SELECT l.*, m.merged, m.alone FROM live l JOIN merges m USING (pair) QUALIFY m.merged = min(m.merged) OVER (PARTITION BY word)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS nth FROM best),
        chosen AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY word, place - nth ORDER BY place) % 2 = 1 AND (nth = 1 OR NOT alone))
        SELECT word, pos, merged AS token FROM chosen UNION ALL SELECT word, next, -1 FROM chosen))
SELECT word, list(token ORDER BY pos) AS tokens FROM state WHERE token >= 0 GROUP BY word
"""
DECODE = """
SELECT doc, string_agg(v.text, '' ORDER BY pos) AS text FROM ids JOIN vocabulary v USING (token) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token, whose id is the pair's rank.

    ``alone`` marks the pairs whose merged token may go into a pair of lesser rank.
    """
    rows = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    first, second, merged = (np.array(c, np.int64) for c in zip(*rows))
    least = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, first, merged)
    np.minimum.at(least, second, merged)
    return pa.table({"pair": (first << 32) + second, "merged": merged.astype(np.int32), "key": merged << 16, "alone": least[merged] < merged})


class Codec:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.digits = [b"%d" % i for i in range(max(self.ranks.values()) + 1)]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.db.register("merges_in", merge_table(self.ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        # the bytes of a token as characters 0 to 255, which string_agg can put together
        ids = pa.array(list(self.ranks.values()), pa.int32())
        self.db.register("vocabulary_in", pa.table({"token": ids, "text": [t.decode("latin-1") for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as little-endian unsigned 32-bit integers."""
        out = [np.uint32(self.ranks[w]).tobytes() if w in self.ranks else b"" for w in words]
        todo = [i for i, w in enumerate(words) if w and not out[i]]
        for long in (False, True):
            some, size = [], 0
            for i in [i for i in todo if (len(words[i]) > LONGEST) == long]:
                some.append(i)
                size += len(words[i])
                if len(some) >= WORDS_A_QUERY or size >= BYTES_A_QUERY:
                    self._query(words, some, long, out)
                    some, size = [], 0
            self._query(words, some, long, out)
        return out

    def _query(self, words: list[bytes], some: list[int], long: bool, out: list[bytes]) -> None:
        if not some:
            return
        sizes = np.array([len(words[i]) for i in some])
        ends, number = np.cumsum(sizes), np.arange(len(some), dtype=np.int32)
        token = self.single[np.frombuffer(b"".join(words[i] for i in some), np.uint8)]
        if long:
            pos = np.arange(len(token)) - np.repeat(ends - sizes, sizes)
            self.db.register("start_rows", pa.table({"word": np.repeat(number, sizes), "pos": pos.astype(np.int32), "token": token}))
        else:
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(token))
            self.db.register("start", pa.table({"word": number, "tokens": tokens}))
        got = self.db.sql(ENCODE_LONG if long else ENCODE).to_arrow_table()
        lists = got.column("tokens").combine_chunks()
        ids, offsets = lists.values.to_numpy().astype("<u4").tobytes(), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
        for word, first, end in zip(got.column("word").to_pylist(), offsets, offsets[1:]):
            out[some[word]] = ids[first:end]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        parts = [self.pattern.findall(t) for t in texts]
        wanted = set().union(*parts)
        missing = wanted.difference(self.kept)
        if len(self.kept) + len(missing) > MOST_KEPT:  # the older generation goes
            self.old, self.kept, missing = self.kept, {}, wanted
        self.kept.update((part, self.old[part]) for part in missing.intersection(self.old))
        new = list(missing.difference(self.old))
        self.kept.update(zip(new, self.contract([p.encode() for p in new])))
        got = [b"".join(map(self.kept.__getitem__, part)) for part in parts]
        for part in new:
            if len(part) > 64:
                del self.kept[part]
        return got

    def decimals(self, ids: bytes) -> bytes:
        """Ids in decimals, joined by commas."""
        return b",".join(map(self.digits.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        sizes = np.array([len(x) // 4 for x in ids])
        token = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(len(token), dtype=np.int32), "token": token}))
        out = [b""] * len(ids)
        for doc, text in self.db.execute(DECODE).fetchall():
            out[doc] = text.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, token ids, their decimals' SHA-256 and the SHA-256 of the bytes decoded from the ids.

    Each match of the pattern is encoded by itself: as one token if it is one, else its
    bytes are contracted pair by pair, the leftmost of least rank first. A null text is
    empty and has no ids. A match of over 256 bytes goes through a recursion over rows
    that contracts all occurrences of a pair at once, with the same result. Repeated
    rows and null ids come back as they are; other columns, whatever their names, are ignored.
    An empty table gives an empty result.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or default_path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in trimmed(batches):
            doc_ids = batch.column("doc_id")
            for first, texts in grouped([t or "" for t in batch.column("text").to_pylist()], GROUP_CHARS):
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(first, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                        pa.array([hashlib.sha256(own.decimals(x)).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids)]),
                    ],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return rows_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
