"""Structure repair against a plain dynamic program, whole and in pieces."""

import hashlib
import random
import zlib

import pytest

from causeway.llm import structure_repair as sr

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def by_hand(rows):
    """Least (cost, audit, lines) over all edits; rows: (role, text, fault)."""
    def inserted(states):
        while True:
            new = dict(states)
            for q, (cost, audit, lines) in states.items():
                for role in ("user", "assistant"):
                    if (q, role[0]) in STEP:
                        to = STEP[q, role[0]]
                        new[to] = min(new.get(to, (10**9,)), (cost + 2, audit + "I", lines + [role + ":"]))
            if new == states:
                return states
            states = new

    states = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        def offer(q, label):
            after[q] = min(after.get(q, (10**9,)), label)
        for q, (cost, audit, lines) in states.items():
            offer(q, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = int(fault == "truncated")
            for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if (q, new[:1]) in STEP:
                    offer(STEP[q, new[:1]], (cost + price + more, audit + letter, lines + [f"{new}:{text}"]))
        states = inserted(after)
    cost, audit, lines = min(v for q, v in states.items() if q in ("", "a"))
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def whole_by_hand(conversations):
    out, grouped = {}, {}
    for conv, turn, role, text in conversations:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows = grouped.setdefault(conv, [])
        if kind:
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in grouped.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faulty, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *counts.values(), illegal, *by_hand(faulty))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in sr.repair(sr.damaged(df)).collect()}
    assert got == whole_by_hand(rows)


def made(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["ok.", "no", "", " \t", "why?", "é!", "ok. ", "a\nb.", "x" * 3000 + "."]
    rows = []
    for conv in conversations:
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([None, turn, turn, turn, turn + 7]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]), rng.choice([*texts, None, f"{turn}."])))
    return rows


def test_equals_brute_force(spark):
    check(spark, made(1, [None, *range(150)], 12) + [(5000 + i, i % 2, "user", "same.") for i in range(40)])


def test_all_rows_dropped_and_empty_table(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    check(spark, [(7, turn, "user", "gone.")])
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert sr.repair(sr.damaged(df)).count() == 0


@pytest.mark.parametrize("most", [1, 3])
def test_search_in_pieces_equals_whole(spark, most):
    """Pieces of every size give what the whole gives: the search over tables is the same."""
    rng = random.Random(most)
    for _ in range(30):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.choice([0, 0, 1])) for _ in range(rng.randrange(0, 14))]
        pieces = []
        for k in range(0, len(rows), most):
            part = rows[k : k + most]
            pieces.append({"n_rows": len(part), "ways": sr._table(part), "part": 0, "piece": k, "initials": [r[0] for r in part]})
        if not pieces:
            continue
        out, into = [{} for _ in range(len(pieces) + 1)], [{} for _ in range(len(pieces) + 1)]
        for i, p in enumerate(pieces):
            for w in p["ways"]:
                out[i].setdefault(w["state"], []).append(((i + 1, w["to"]), w["cost"], w["audit"]))
                into[i + 1].setdefault(w["to"], []).append(((i, w["state"]), w["cost"], w["audit"]))
        found = sr.cheapest((0, 0), [(len(pieces), 0), (len(pieces), 3)], lambda v: out[v[0]].get(v[1], ()), lambda v: into[v[0]].get(v[1], ()))
        assert found == sr.repair_rows(rows)
        assert "".join(s["audit"] for s in sr._steps(pieces, found[1])) == found[1]


def test_long_conversation_over_many_partitions(spark):
    """One conversation has most rows: it is cut by pieces and by partitions."""
    rows = made(3, [1], 2) + [(2, t, ["user", "assistant"][t % 2], f"{t % 700}.") for t in range(1500)] + [(3, None, "user", "again.")] * 700 + made(4, range(10, 30), 6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
