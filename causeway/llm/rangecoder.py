"""Adaptive context-mixing range coder for token ids.

A block of ids is coded by itself: its model begins anew, it has its own dictionary of the
ids that occur, and checksums. The ids are dealt to lanes, consecutive stretches that are
range-coded side by side as numpy arrays and share one model.

The model learns in phases, each as long as all before it, from all that the block has
coded so far. Order 2: a hash of the last two ids gives the id that followed them last and
how often it was right in turn (its trust); a flag, whose chance is learnt for each trust,
says whether it is right again. Where it is not, orders 1 and 0 are mixed: an id counts as
often as it came after the last id, plus its share of a weight spread in proportion to all
occurrences; so order 0 fades where order 1 knows much. The weight that suits a phase is
written before it. Coding is carryless with a 64-bit range and 32-bit words of output; all
of the model is integers, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block at most, of a lane about, and lanes at most.
BLOCK, LANE_IDS, MOST_LANES = 1 << 22, 1024, 4096
#: Counts of order 1 at most; where ids in a block are so many that each after each would be more, last ids share rows.
CELLS = 1 << 24
SLOT_BITS, MOST_TRUST = 20, 4
#: What one occurrence after the last id counts, and the weights of order 0 in occurrences.
ONE, WEIGHTS = 64, (2, 8, 32, 128, 512)
MAGIC = b"CWTK\x03"
_U32, _U64, _WORD, _LOW = np.uint32, np.uint64, np.uint64(32), np.uint64(0xFFFFFFFF)
_CHANCE = np.uint64(16)


class _Model:
    """What a block has shown so far; ids are their places in its dictionary."""

    def __init__(self, n: int):
        self.n, self.rows = n, max(1, min(n, CELLS // n))
        self.seen, self.sums = np.zeros(self.rows * n, _U32), np.zeros(self.rows, np.int64)
        self.often = np.zeros(n, np.int64)
        self.table = np.zeros((self.rows, n + 1), _U32)
        self.guess, self.trust = np.zeros(1 << SLOT_BITS, _U32), np.zeros(1 << SLOT_BITS, np.uint8)
        self.asked, self.right = np.full(MOST_TRUST + 1, 2, np.int64), np.full(MOST_TRUST + 1, 1, np.int64)

    def slots(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (before * _U32(0x9E3779B1) + last * _U32(0x85EBCA77)) >> _U32(32 - SLOT_BITS)

    def _shares(self, weight: int) -> np.ndarray:
        return 1 + self.often * (weight * ONE) // max(1, int(self.often.sum()))

    def best_weight(self, last: np.ndarray, now: np.ndarray) -> int:
        """Place of the weight that codes the ids in the fewest bits, by every 16th of them."""
        row, now = last[::16] % _U32(self.rows), now[::16]
        own, total = ONE * self.seen[row.astype(np.int64) * self.n + now].astype(np.float64), ONE * self.sums[row].astype(np.float64)
        bits = []
        for weight in WEIGHTS:
            shares = self._shares(weight)
            bits.append(float((np.log2(total + shares.sum()) - np.log2(own + shares[now])).sum()))
        return int(np.argmin(bits))

    def mix(self, weight: int) -> None:
        """Cumulative frequencies after each last id, and the chances of the order-2 guesses."""
        part = self.table[:, 1:]
        np.multiply(self.seen.reshape(self.rows, self.n), _U32(ONE), out=part)
        part += self._shares(weight).astype(_U32)
        np.cumsum(part, axis=1, out=part)
        self.flat, self.totals = self.table.reshape(-1), np.ascontiguousarray(self.table[:, -1]).astype(_U64)
        self.chance = np.clip(self.right * 65536 // self.asked, 64, 65472).astype(_U64)
        self.chance[0] = 0  # an empty slot is not asked

    def learn(self, before: np.ndarray, last: np.ndarray, now: np.ndarray) -> None:
        row = last % _U32(self.rows)
        np.add.at(self.seen, row.astype(np.int64) * self.n + now, _U32(1))
        self.sums += np.bincount(row, minlength=self.rows)
        self.often += np.bincount(now, minlength=self.n)
        slot = self.slots(before, last)
        trust, right = self.trust[slot], self.guess[slot] == now
        self.asked += np.bincount(trust, minlength=MOST_TRUST + 1)
        self.right += np.bincount(trust[right], minlength=MOST_TRUST + 1)
        # of several in one slot the last one counts
        self.guess[slot] = now
        self.trust[slot] = np.where(right & (trust > 0), np.minimum(trust + 1, MOST_TRUST), 1)


class _Range:
    """Range coders of all lanes."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U64)

    def flag(self, hit: np.ndarray, bound: np.ndarray) -> None:
        self.range = np.where(hit, bound, self.range - bound)
        self.low += np.where(hit, _U64(0), bound)

    def bound(self, chance: np.ndarray) -> np.ndarray:
        return (self.range >> _CHANCE) * chance

    def narrow(self, i: np.ndarray, step: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.low[i] += step * first
        self.range[i] = step * size

    def shift(self) -> tuple[np.ndarray, np.ndarray]:
        """(lanes whose top word is settled, or made so by giving up the part beyond it; those words)."""
        i = np.flatnonzero(self.range <= _LOW)
        low = self.low[i]
        rest = low & _LOW
        self.low[i], self.range[i] = rest << _WORD, np.minimum(self.range[i], _U64(1 << 32) - rest) << _WORD
        return i, low >> _WORD


def _shape(n: int) -> tuple[int, int]:
    """(lanes, ids of each) of a block; the last ones are filled up."""
    lanes = max(1, min(MOST_LANES, -(-n // LANE_IDS)))
    return lanes, -(-n // lanes)


def _phases(steps: int):
    first = to = max(1, steps // 64)
    at = 0
    while at < steps:
        yield at, min(to, steps)
        at, to = to, to + max(first, to)


def _dictionary(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids that occur in ascending order, place of each id)."""
    most = int(ids.max())
    if most >= 1 << 22:
        values, places = np.unique(ids, return_inverse=True)
        return values, places.astype(_U32)
    there = np.zeros(most + 1, bool)
    there[ids] = True
    return np.flatnonzero(there).astype(_U32), (np.cumsum(there, dtype=_U32) - _U32(1))[ids]


def encode_block(ids: np.ndarray) -> bytes:
    """One block, of at least one id, with all that decoding it needs but the number of its ids."""
    values, places = _dictionary(ids)
    lanes, steps = _shape(len(ids))
    rows = np.zeros(lanes * steps, _U32)
    rows[: len(ids)] = places
    columns = np.zeros((steps + 2, lanes), _U32)  # two rows that nothing precedes
    columns[2:] = rows.reshape(lanes, steps).T
    model, coder, weights = _Model(len(values)), _Range(lanes), bytearray()
    out, done = np.zeros((lanes, int(steps * 1.6) + 8), _U32), np.zeros(lanes, np.intp)

    def flush() -> None:
        i, words = coder.shift()
        if len(i):
            out[i, done[i]] = words
            done[i] += 1

    for at, to in _phases(steps):
        before, last, now = (columns[at + k : to + k].ravel() for k in range(3))
        slot = model.slots(before, last)
        trust = model.trust[slot]
        hit = (trust > 0) & (model.guess[slot] == now)
        weights.append(model.best_weight(last[~hit], now[~hit]))
        model.mix(WEIGHTS[weights[-1]])
        row = last % _U32(model.rows)
        place = row.astype(np.int64) * (model.n + 1) + now
        first = model.flat[place]
        size = model.flat[place + 1] - first
        for t in range(0, len(now), lanes):
            s = slice(t, t + lanes)
            coder.flag(hit[s], coder.bound(model.chance[trust[s]]))
            flush()
            i = np.flatnonzero(~hit[s])
            coder.narrow(i, coder.range[i] // model.totals[row[s][i]], first[s][i].astype(_U64), size[s][i].astype(_U64))
            flush()
        model.learn(before, last, now)
    lane = np.arange(lanes)
    out[lane, done], out[lane, done + 1] = coder.low >> _WORD, coder.low & _LOW
    done += 2
    known = zlib.compress(np.diff(values, prepend=_U32(0)).astype("<u4").tobytes(), 6)
    words = b"".join(out[i, : done[i]].astype("<u4").tobytes() for i in range(lanes))
    return struct.pack("<IB", len(known), len(weights)) + bytes(weights) + known + done.astype("<u4").tobytes() + words


def decode_block(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    size, n_weights = struct.unpack_from("<IB", data)
    weights, at = data[5 : 5 + n_weights], 5 + n_weights
    values = np.cumsum(np.frombuffer(zlib.decompress(data[at : at + size]), "<u4"), dtype=_U32)
    at += size
    lanes, steps = _shape(n)
    counts = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u4", -1, at + 4 * lanes), np.zeros(4, "<u4")])
    begin = np.cumsum(counts) - counts
    code = words[begin].astype(_U64) << _WORD | words[begin + 1]
    begin += 2
    model, coder = _Model(len(values)), _Range(lanes)
    columns = np.zeros((steps + 2, lanes), _U32)

    def refill() -> None:
        i, _ = coder.shift()
        if len(i):
            code[i] = (code[i] << _WORD) | words[begin[i]]
            begin[i] += 1

    for (at, to), weight in zip(_phases(steps), weights):
        model.mix(WEIGHTS[weight])
        for t in range(at, to):
            before, last, now = columns[t], columns[t + 1], columns[t + 2]
            slot = model.slots(before, last)
            bound = coder.bound(model.chance[model.trust[slot]])
            hit = code - coder.low < bound
            coder.flag(hit, bound)
            refill()
            now[:] = model.guess[slot]
            i = np.flatnonzero(~hit)
            row = last[i] % _U32(model.rows)
            total = model.totals[row]
            step = coder.range[i] // total
            wanted = np.minimum((code[i] - coder.low[i]) // step, total - _U64(1)).astype(_U32)
            row = row.astype(np.int64) * (model.n + 1)
            place, left = row.copy(), model.n
            while left > 1:  # the last start that is not beyond what is wanted
                half = left >> 1
                place += (model.flat[place + half] <= wanted) * half
                left -= half
            first = model.flat[place]
            coder.narrow(i, step, first.astype(_U64), (model.flat[place + 1] - first).astype(_U64))
            refill()
            now[i] = place - row
        model.learn(*(columns[at + k : to + k].ravel() for k in range(3)))
    return values[columns[2:].T.ravel()[:n]]


def write_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file: marks, document index, block table (ids, bytes, CRC-32 of the ids and of the bytes), blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    parts, table = [], b""
    for at in range(0, len(ids), block):
        some = ids[at : at + block]
        with np.errstate(over="ignore"):
            parts.append(encode_block(some))
        table += struct.pack("<IIII", len(some), len(parts[-1]), zlib.crc32(some), zlib.crc32(parts[-1]))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes()
    packed = zlib.compress(index, 1)
    return MAGIC + struct.pack("<IIII", len(doc_ids), len(parts), len(packed), zlib.crc32(packed + table)) + packed + table + b"".join(parts)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of a file; a ValueError if a checksum is wrong."""
    if data[:5] != MAGIC or len(data) < 21:
        raise ValueError("not a token file")
    docs, n, packed_size, check = struct.unpack_from("<IIII", data, 5)
    at = 21 + packed_size
    if zlib.crc32(data[21 : at + 16 * n]) != check:
        raise ValueError("the index of a token file is damaged")
    index = zlib.decompress(data[21:at])
    known, numbers = np.frombuffer(index, np.uint8, docs), np.frombuffer(index[docs:], "<i8")
    blocks, at = [], at + 16 * n
    for i in range(n):
        count, size, of_ids, of_bytes = struct.unpack_from("<IIII", data, 21 + packed_size + 16 * i)
        part = data[at : at + size]
        at += size
        if zlib.crc32(part) != of_bytes:
            raise ValueError("a block of a token file is damaged")
        with np.errstate(over="ignore"):
            blocks.append(decode_block(part, count))
        if zlib.crc32(blocks[-1].astype("<u4")) != of_ids:
            raise ValueError("a block of a token file does not give its ids back")
    ids = np.concatenate(blocks) if blocks else np.zeros(0, _U32)
    return [int(d) if k else None for d, k in zip(numbers[:docs], known)], numbers[docs:], ids
