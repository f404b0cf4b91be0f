"""Conversation repair: alignment against an exhaustive search, the query against a plain Python account of its contract."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import conversation_repair as repair
from tablewright.llm import queries

SF = "/root/testdata/sf0.001"
NEXT = {"-": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, entry="-", exits="-a"):
    """Dijkstra over (rows done, state) by (cost, audit); rows are (initial, must go, truncated)."""
    heap, seen = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in exits:
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        for t in NEXT[q]:
            if t != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", i, t))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            for t in NEXT[q] if not gone else "":
                if initial == t:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, t))
                elif t != "s":
                    heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, t))
    return None


def _codes(rows):
    return "".join(chr(65 + 4 * max("-sua".find(i), 0) + (2 if gone else cut)) for i, gone, cut in rows)


def _random_rows(r, n):
    return [(r.choice("suauaux"), r.random() < .15, int(r.random() < .2)) for _ in range(n)]


def test_alignment_is_the_cheapest_and_least():
    r = random.Random(7)
    for _ in range(1500):
        rows = _random_rows(r, r.randint(1, 9))
        got = repair.segment(_codes(rows))
        for p in repair.STATES:
            for q in repair.STATES:
                assert got.get((p, q)) == cheapest(rows, p, q), (rows, p, q)


@pytest.mark.parametrize("size", [1, 3, 256])
def test_segments_compose(size):
    r = random.Random(size)
    for n in [5, 17, 60]:
        for _ in range(20):
            codes = _codes(rows := _random_rows(r, n))
            walk = repair._Conversation(1, 0)
            for i in range(0, n, size):
                got = repair.segment(codes[i:i + size])
                walk.add_segment([got.get((p, q), (-1, ""))[0] for p in repair.STATES for q in repair.STATES],
                                 [got.get((p, q), (-1, ""))[1] for p in repair.STATES for q in repair.STATES], [0, 0, 0, 0, 0, 0])
            walk.solve()
            assert walk.best == cheapest(rows)


def account(rows):
    """The contract in plain Python: {conv_id: row}; rows are (conv_id, turn, role, text)."""
    out, by_id = {}, {}
    for conv, turn, role, text in rows:
        mine = by_id.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, mine in by_id.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, faults, coded = set(), [], []
        for _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            coded.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        given = [t for t, _, _ in mine if t is not None]
        cost, audit = cheapest(coded) if mine else (0, "")
        made, at, length = [], iter(mine), len(audit) - audit.count("D")
        for e in audit:
            role, text = (None, "") if e == "I" else next(at)[1:]
            if e != "D":
                want = {"s": "system", "u": "user", "a": "assistant"}[repair.target(len(made), length)]
                made.append(f"{role if e == 'K' else want}:{text}")
        initials = [r[:1] for _, r, _ in mine]
        out[conv] = (max(given) - min(given) + 1 - len(set(given)) if given else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def _got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_the_account(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(queries.QUERIES["op11_conversation_repair"](spark, SF)) == account(rows)


ODD = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 5, "tool", ""), (None, 1, "user", "A?\n \x0b"), (None, None, "", "b"),
       (None, 2, "assistant", "é中😀!"), (3, 1, "system", "x " * 40_000), (3, 1, "system", "S."), (3, 2, "system", "S."), (4, None, "user", " \t"), (4, None, "ugly", ".")]
LONG = [(9, i // 2, random.Random(i).choice(["user", "assistant", "user", "system"]), f"t{i % 50}{'.' * (i % 3)}") for i in range(700)]


@pytest.mark.parametrize("size", [4, 256])
def test_odd_rows_long_conversations_and_extra_columns(spark, size):
    """One conversation holds nearly all rows and is cut into segments."""
    data = ODD + LONG
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in data], "conv_id long, turn long, role string, text string, key string, phase int, pos int").repartition(7)
    rows = repair.turns(df)
    damaged = repair.damage(rows)
    assert _got(repair.repair_report(damaged, rows, size=size)) == account(data)
    made = {}
    for r in repair.repair_turns(damaged, size=size).orderBy("conv_id", "position").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = {k: v[-1] for k, v in account(data).items()}
    none = hashlib.sha256(b"").hexdigest()
    assert {k: hashlib.sha256("\n".join(made.get(k, [])).encode()).hexdigest() if k in made else none for k in want} == want


def test_empty_table_and_conversations_without_rows(spark):
    empty = repair.turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.repair_report(repair.damage(empty), empty).collect() == []
    some = repair.turns(spark.createDataFrame([(5, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    row = repair.repair_report(some.where(F.lit(False)), some).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
