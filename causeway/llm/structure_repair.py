"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state); the states accept role initials ``(s?(ua)+)?``.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from causeway.session import checkpointed

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: A longer conversation, or one that a partition's end cuts, is repaired in pieces of at most so many rows and bytes (or of one row).
PIECE_ROWS, PIECE_BYTES = 512, 4 << 20

# The states: nothing yet, a system turn, a user turn that waits for its answer, an answered one.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = ["user", "user", "assistant", "user"]  # what an inserted or reroled turn is, by state
_AFTER = [2, 2, 3, 2]
_ENDS = (0, 3)
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"

Node = tuple[int, int]
Edges = Callable[[Node], Iterable[tuple[Node, int, str]]]


def cheapest(source: Node, ends: Iterable[Node], ahead: Edges, back: Edges) -> tuple[int, str] | None:
    """Cost and audit of the cheapest way from ``source`` to one of ``ends``, ties by the least audit.

    Forward and reverse heaps take turns; once they meet, all nodes that an equally cheap
    way may cross are settled, and the least concatenated audit of all crossings counts.
    Ways without cost lead to the next layer only, so nodes of equal cost are settled
    layer by layer and their labels are final.
    """
    labels: tuple[dict, dict] = {source: (0, "")}, {e: (0, "") for e in ends}
    heaps = [[(0, source[0], source)], [(0, -e[0], e) for e in labels[1]]]
    heapq.heapify(heaps[1])
    settled: tuple[set, set] = set(), set()
    best = None
    while all(heaps):
        side = 0 if heaps[0][0][0] < heaps[1][0][0] else 1
        cost, _, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        if best is not None and cost + heaps[1 - side][0][0] > best:
            break
        settled[side].add(node)
        if node in labels[1 - side]:
            total = cost + labels[1 - side][node][0]
            best = total if best is None else min(best, total)
        audit = labels[side][node][1]
        for there, more, letters in (back if side else ahead)(node):
            new = (cost + more, letters + audit if side else audit + letters)
            if there not in labels[side] or new < labels[side][there]:
                labels[side][there] = new
                heapq.heappush(heaps[side], (new[0], -there[0] if side else there[0], there))
    if best is None:
        return None
    crossings = []
    for node in settled[0] | {source}:
        cost, audit = labels[0][node]
        for there, more, letters in [(node, 0, ""), *ahead(node)]:
            if there in settled[1] and cost + more + labels[1][there][0] == best:
                crossings.append(audit + letters + labels[1][there][1])
    return best, min(crossings)


def _lattice(rows: list[tuple[str, bool, int]]) -> tuple[Edges, Edges]:
    """Ways out of and into a node. A row is its role's initial, whether it must go, and what it costs when it stays."""
    n = len(rows)

    def of_row(i: int, q: int) -> Iterator[tuple[int, int, str]]:
        initial, must_go, stays = rows[i]
        yield q, DELETE, "D"
        if not must_go:
            if (q, initial) in _STEP:
                yield _STEP[q, initial], stays, "K"
            yield _AFTER[q], REROLE + stays, "R"

    def ahead(node: Node) -> Iterator[tuple[Node, int, str]]:
        i, q = node
        yield (i, _AFTER[q]), INSERT, "I"
        if i < n:
            for to, cost, letter in of_row(i, q):
                yield (i + 1, to), cost, letter

    def back(node: Node) -> Iterator[tuple[Node, int, str]]:
        i, q = node
        for before in range(4):
            if _AFTER[before] == q:
                yield (i, before), INSERT, "I"
            if i:
                for to, cost, letter in of_row(i - 1, before):
                    if to == q:
                        yield (i - 1, before), cost, letter

    return ahead, back


def repair_rows(rows: list[tuple[str, bool, int]]) -> tuple[int, str]:
    """Cost and audit for a whole conversation."""
    return cheapest((0, 0), [(len(rows), q) for q in _ENDS], *_lattice(rows))


def _table(rows: list[tuple[str, bool, int]]) -> list[dict]:
    """Cost and audit of a piece from each state to each state that can follow."""
    lattice, out = _lattice(rows), []
    for q in range(4):
        for to in range(4):
            found = cheapest((0, q), [(len(rows), to)], *lattice)
            if found is not None:
                out.append({"state": q, "to": to, "cost": found[0], "audit": found[1]})
    return out


def repaired_lines(state: int, audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of what an audit leaves, from a state on."""
    given = iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(given)
        if letter == "D":
            continue
        wanted = role if letter == "K" else _WANTED[state]
        yield f"{wanted}:{text}"
        state = _STEP[state, role[:1]] if letter == "K" else _AFTER[state]


_STATS = "n_rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, first_turn long, last_turn long, turns long"
_PIECES = f"part int, piece int, whole boolean, {_STATS}, cost long, audit string, repaired_sha256 string, ways array<struct<state: int, to: int, cost: long, audit: string>>, roles array<string>, texts array<string>"


class _Piece:
    """Rows of one conversation that stand together, with their counts."""

    def __init__(self, conv_id, number: int, tail: str | None = None, turn: int | None = None) -> None:
        self.conv_id, self.number, self.rows, self.turns_of_rows, self.bytes = conv_id, number, [], [], 0
        self.stats = dict(n_rows=0, blank=0, duplicate=0, truncated=0, illegal=0, head=None, tail=None, first_turn=None, last_turn=None, turns=0)

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        s, initial, bare = self.stats, role[:1], text.rstrip(_SPACE)
        fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            s[fault] += 1
        if s["n_rows"]:
            s["illegal"] += s["tail"] + initial not in _LEGAL
        else:
            s["head"] = initial
        s["n_rows"] += 1
        s["tail"] = initial
        if turn is not None:
            s["first_turn"] = turn if s["first_turn"] is None else s["first_turn"]
            s["turns"] += turn != s["last_turn"]
            s["last_turn"] = turn
        self.rows.append((initial, fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))
        self.turns_of_rows.append((role, text))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.bytes >= PIECE_BYTES

    def closed(self, part: int, whole: bool) -> dict:
        out = {"conv_id": self.conv_id, "part": part, "piece": self.number, "whole": whole, **self.stats}
        if whole:
            out["cost"], out["audit"] = repair_rows(self.rows)
            out["repaired_sha256"] = hashlib.sha256("\n".join(repaired_lines(0, out["audit"], self.turns_of_rows)).encode()).hexdigest()
        else:
            out["ways"] = _table(self.rows)
            out["roles"], out["texts"] = [r for r, _ in self.turns_of_rows], [t for _, t in self.turns_of_rows]
        return out


def _pieces(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, first, mark, out = TaskContext.get().partitionId(), None, True, None, []
        for batch in batches:
            for conv_id, turn, role, digest, is_row, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is None:
                    piece = _Piece(conv_id, 0)
                elif piece.conv_id != conv_id:
                    out.append(piece.closed(part, not first and piece.number == 0))
                    piece, first = _Piece(conv_id, 0), False
                if not is_row:
                    mark = (turn, role, digest)
                    continue
                for copy in range(copies):
                    if piece.full():
                        out.append(piece.closed(part, False))
                        piece = _Piece(conv_id, piece.number + 1)
                        if len(out) >= 64:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    piece.add(turn, role, text, copy > 0 or mark != (turn, role, digest))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if piece is not None:
            yield pa.RecordBatch.from_pylist([piece.closed(part, False)], schema)

    return run


def _joined(schema: pa.Schema):
    """One conversation from its pieces: the lattice of pieces and states is walked as that of rows is."""

    def run(pieces: pa.Table) -> pa.Table:
        rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["piece"]))
        total = dict(conv_id=rows[0]["conv_id"], **{c: sum(r[c] for r in rows) for c in ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")})
        filled = [r for r in rows if r["n_rows"]]
        for a, b in zip(filled, filled[1:]):
            total["illegal"] += a["tail"] + b["head"] not in _LEGAL
        timed = [r for r in rows if r["turns"]]
        total["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        total["first_turn"], total["last_turn"] = (timed[0]["first_turn"], timed[-1]["last_turn"]) if timed else (None, None)
        out: list[dict[int, list]] = [{} for _ in range(len(rows) + 1)]
        into: list[dict[int, list]] = [{} for _ in range(len(rows) + 1)]
        for i, r in enumerate(rows):
            for w in r["ways"]:
                out[i].setdefault(w["state"], []).append(((i + 1, w["to"]), w["cost"], w["audit"]))
                into[i + 1].setdefault(w["to"], []).append(((i, w["state"]), w["cost"], w["audit"]))
        total["cost"], total["audit"] = cheapest((0, 0), [(len(rows), q) for q in _ENDS], lambda v: out[v[0]].get(v[1], ()), lambda v: into[v[0]].get(v[1], ()))
        total["steps"] = list(_steps(rows, total["audit"]))
        return pa.Table.from_pylist([total], schema)

    return run


def _steps(rows: list[dict], audit: str) -> Iterator[dict]:
    """The part of the audit that each piece has: its rows, and what is inserted before them; the last one has the rest."""
    state, at, last = 0, 0, rows[-1]
    for r in rows:
        begin, start, left = at, state, r["n_rows"]
        turn = 0
        while at < len(audit) and (left or r is last):
            letter = audit[at]
            if letter != "I":
                initial = r["initials"][turn]
                turn, left = turn + 1, left - 1
            if letter == "K":
                state = _STEP[state, initial]
            elif letter in "IR":
                state = _AFTER[state]
            at += 1
        yield {"part": r["part"], "piece": r["piece"], "state": start, "audit": audit[begin:at]}


def _hashed(schema: pa.Schema):
    """A digest for each conversation of a partition that is sorted by conversation and piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, held, any_line = None, None, False
        done = lambda: pa.RecordBatch.from_pylist([{"conv_id": held, "repaired_sha256": digest.hexdigest()}], schema)
        for batch in batches:
            for row in batch.to_pylist():
                if digest is None or row["conv_id"] != held:
                    if digest is not None:
                        yield done()
                    digest, held, any_line = hashlib.sha256(), row["conv_id"], False
                for line in repaired_lines(row["state"], row["audit"], zip(row["roles"], row["texts"])):
                    digest.update((b"\n" if any_line else b"") + line.encode())
                    any_line = True
        if digest is not None:
            yield done()

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage by crc32(``conv_id:turn``) % 20: 0 drops a row (copies 0), 1 empties
    its text, 2 removes ``[.!?]``, 3 repeats it (copies 2), 4 makes its role user. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text, copies); see :func:`damaged`.

    Gives conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows stand in the order of turn (nulls first), role and SHA-256 of the text; copies
    of a row stand together and all but the first are duplicates. A row with no copies
    stands for nothing but its conversation, which is then returned with zeros, an empty audit
    and the digest of nothing. An empty role fits nowhere: such a row is deleted or
    reroled, as one of an unknown initial. A null conv_id is a conversation. Other
    columns are ignored; an empty table gives none.

    Equal rows are counted before anything is sorted. Then all rows are dealt by ranges of
    (conv_id, turn, role, digest), so a huge conversation lies in many tasks, in order. A
    conversation that lies inside one task is repaired there. Of one that is cut, or longer than a piece,
    each piece gives the cheapest way between every two states; the ways are put together with
    the same search, and the text is hashed as a sorted stream. The audit of one
    conversation is one value, so it must fit in a task.
    """
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    named = lambda ddl: T.StructType([conv, *T.StructType.fromDDL(ddl).fields])
    there = F.col("copies") > 0
    counted = rows.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keyed = counted.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.lit(True).alias("is_row"), "text", "copies")
    seen = keyed.where(there).groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("no_turn"))
    marks = seen.select("conv_id", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "digest", F.lit(False).alias("is_row"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    order = ["conv_id", "turn", "role", "digest"]
    stream = keyed.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "is_row")
    schema = named(_PIECES)
    pieces = checkpointed(stream.mapInArrow(_pieces(to_arrow_schema(schema)), schema))

    cut = pieces.where("not whole")
    schema = named(f"{_STATS}, cost long, audit string, steps array<struct<part: int, piece: int, state: int, audit: string>>")
    joined = cut.select("conv_id", "part", "piece", *[f.split()[0] for f in _STATS.split(", ")], "ways", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"))
    joined = checkpointed(joined.groupBy("conv_id").applyInArrow(_joined(to_arrow_schema(schema)), schema))
    steps = joined.select(F.col("conv_id").alias("conv"), F.inline("steps"))
    held = cut.select("conv_id", "part", "piece", "roles", "texts").join(steps.withColumnsRenamed({"part": "of_part", "piece": "of_piece"}), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("of_part")) & (F.col("piece") == F.col("of_piece")))
    schema = named("repaired_sha256 string")
    digests = held.select("conv_id", "part", "piece", "state", "audit", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_hashed(to_arrow_schema(schema)), schema)
    ended = joined.join(digests.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")))
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).cast("long")
    columns: list[Column | str] = ["conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pieces.where("whole").select(*columns).unionByName(ended.select(*columns))

