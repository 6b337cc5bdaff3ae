import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as cr
from tidemark.llm import queries

WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) over rows (initial, truncated, must_go), from the end backwards over all edits, without any survivor rule."""
    dead = (10 ** 9, "")
    after = None
    for i in range(len(rows), -1, -1):
        now = {}
        for inserts in range(3, -1, -1):
            for state in "ESUA":
                found = [(0, "")] if i == len(rows) and state in "EA" else [dead]
                to = "A" if state == "U" else "U"
                if inserts < 3:
                    c, a = now[to, inserts + 1]
                    found.append((c + 3, "I" + a))
                if i < len(rows):
                    initial, truncated, must_go = rows[i]
                    c, a = after[state, 0]
                    found.append((c + 4, "D" + a))
                    if not must_go:
                        more = 3 * truncated
                        if initial == "s" and state == "E":
                            c, a = after["S", 0]
                            found.append((c + more, "K" + a))
                        c, a = after[to, 0]
                        if initial == to.lower():
                            found.append((c + more, "K" + a))
                        found.append((c + more + 3, "R" + a))
                now[state, inserts] = min(found)
        after = now
    return after["E", 0]


def brute(table):
    """Report rows by conversation from plain rows (conv_id, turn, role, text, present)."""
    convs = {}
    for conv, turn, role, text, present in table:
        convs.setdefault(conv, [])
        if present:
            role, text = (" " if x is None else x for x in (role, text))
            convs[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, held in convs.items():
        held.sort()
        counts, seen, rows = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, _, role, _, text in held:
            bare = text.strip(WS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            rows.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        turns = [t for known, t, *_ in held if known]
        cost, audit = cheapest(tuple(rows))
        state, lines, at = "E", [], 0
        for e in audit:
            if e != "I":
                role, text = held[at][2], held[at][4]
                at += 1
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if state == "U" else "user"
            if e == "I":
                text = ""
            state = role[0].upper()
            lines.append(f"{role}:{text}")
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
                     "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
                     "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def check(spark, table, parts=3):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, present boolean").repartition(parts)
    got = {r["conv_id"]: r.asDict() for r in cr.repair(df).collect()}
    want = brute(table)
    assert got.keys() == want.keys()
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w} == w, conv
    return df


def odd_table(seed, convs=60, turns=9):
    rng = random.Random(seed)
    table = []
    for conv in range(convs):
        for turn in range(rng.randrange(turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "  \n", "", None, "Well!  \r\n", "a?b", "é", "Yes.", f"{rng.random()}."])
            table += [(conv, rng.choice([turn, turn, turn + 3, None]), role, text, rng.random() < 0.9)] * rng.choice([1, 1, 1, 2])
    return [*table, (None, 3, "user", "x", True), (None, None, None, None, True), (-5, 1, "user", "Hi.", False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_is_the_cheapest_and_least(spark, seed):
    df = check(spark, odd_table(seed))
    turns = cr.repaired_turns(df).collect()
    want = {r["conv_id"]: r["repaired_sha256"] for r in cr.repair(df).collect()}
    for conv, sha in want.items():
        lines = [f"{r['role']}:{r['text']}" for r in sorted((r for r in turns if r["conv_id"] == conv),
                                                            key=lambda r: (r["block"], r["place"]))]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == sha


def test_conversations_cut_by_blocks_and_partitions(spark, monkeypatch):
    """Blocks of three rows: every longer conversation is composed of parts."""
    monkeypatch.setattr(cr, "bounded_batches",
                        lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    try:
        check(spark, odd_table(5, convs=25, turns=14), parts=5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_conversation_with_equal_rows(spark):
    """One conversation with most rows, a third of them equal: copies travel as a count and are all deleted."""
    rng = random.Random(8)
    table = [(1, t, rng.choice(["user", "assistant"]), f"line {t}.", True) for t in range(600)]
    table += [(1, 7, "user", "the same", True)] * 400 + [(2, 1, "user", "Hi.", True)]
    check(spark, table)


def test_survivors_share_their_past():
    """Ties stay open only as long as they matter: the tree keeps a short suffix of a long search."""
    rng = random.Random(3)
    rows = [(rng.choice("usa"), rng.random() < 0.3, rng.random() < 0.1) for _ in range(5000)]
    s = cr.Survivors(cr.NOTHING)
    depth = 0
    for r in rows:
        s.push(*r, 0)
        depth = max(depth, s.depth - s.root.depth)
    assert depth < 200
    small = rows[:300]
    s = cr.Survivors(cr.NOTHING)
    for r in small:
        s.push(*r, 0)
    got = min((c + 3 * cr.TAIL[e], a + "I" * cr.TAIL[e]) for e, (c, a) in s.paths().items())
    assert got == cheapest(tuple(small))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", True, 5, 6)],
                               "conv_id long, turn long, role string, text string, present boolean, n int, fp int")
    assert cr.repair(df).collect()[0]["audit"] == "KI"
    assert cr.repair(df.where("conv_id < 0")).count() == 0
    only = cr.repair(df.withColumn("present", F.lit(None).cast("boolean"))).collect()[0]
    assert (only["cost"], only["audit"], only["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = []
    for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist():
        conv, turn, role, text = (r[c] for c in ("conv_id", "turn", "role", "text"))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        table += [(conv, turn, role, text, fault != 0)] * (2 if fault == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in queries.op12_conversation_repair(spark, sf).collect()}
    want = brute(table)
    assert {c: {k: got[c][k] for k in w} for c, w in want.items()} == want and got.keys() == want.keys()
