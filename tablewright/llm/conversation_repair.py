"""Conversation structure repair by Wagner-Fischer alignment with the alternating grammar.

A conversation is its rows by turn (nulls first; ties by role, then SHA-256 of
the text).  Edits: Keep (K) costs 0, Rerole to user or assistant (R) 3, Delete
(D) 4, Insert an empty user or assistant turn (I) 3; a truncated row that is
not deleted adds 3, blank and repeated rows must go.  The cheapest edits whose
role initials read ``(s?(ua)+)?`` win; of equal costs the ASCII-least audit,
the initials of the edits in order.

1. Rows without their texts (key, turn, role, digest, flags) are numbered
   inside their conversation by a range partition and dealt into segments of
   ``SEGMENT`` rows, so a conversation with a third of all rows is many groups.
2. A segment is aligned with every feasible length of the alternating string
   in one Wagner-Fischer table: strings of all lengths share their ends, so
   cell (i, r) is the cost of rows i.. against the last r letters.  Ukkonen's
   band keeps the cells whose surplus of letters or rows costs no more than
   the incumbent bound, which doubles until a path within it exists; all paths
   of that cost are then inside the band.  Audits are traced from the front,
   least edit first, and compared across lengths.
3. Segments meet in (entry, exit) states of the grammar: a segment gives the
   best (cost, audit) for each, and these compose like matrices.  For equal
   entry, exit and cost no audit is a prefix of another, so the least audit of
   the whole is made of least audits.
4. One pass, partitioned by conversation and sorted, reads a conversation's
   segments and then streams its rows: the repaired turns, or their SHA-256.
   No conversation is held in memory, only its audit.  SHA-256 is sequential,
   so the texts of one conversation pass through one task.

Defined results: a null role or text counts as one space, null conv_ids are one
conversation, null turns come first.  Repeated rows are faults of their
conversation, not errors.  Texts of any length stream through.  An empty table
gives no rows.  Other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices
from tablewright.operators.numbering import number_within

#: Rows of a segment.
SEGMENT = 256
#: Fixed values of the cost model.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant.
STATES = "-sua"
ROLES = {"u": "user", "a": "assistant"}
_NO_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
_INF = 1 << 60


# ---------------------------------------------------------------- damage

def turns(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text): nulls of role and text count as one space, ``key`` is never null."""
    space = F.lit(" ")
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), space).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of :func:`turns` after the damage that crc32(`conv_id:turn`) % 20 deals out."""
    kind = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    return (rows.withColumn("_kind", kind).where("_kind <> 0")
            .withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("_kind", "_copy"))


# ---------------------------------------------------------------- alignment

def _tables(codes: str, last: str, bound: int) -> list[tuple[int, list[int]]]:
    """Rows (low r, costs) of the banded table: rows i.. of ``codes`` against the last r letters of a string that ends in ``last``."""
    n, below, above = len(codes), bound // DELETE, bound // INSERT
    out = [(0, [INSERT * r for r in range(above + 1)])]
    for i in range(n - 1, -1, -1):
        low, (nlow, nxt) = max(0, n - i - below), out[-1]
        kind, fault = divmod(ord(codes[i]) - 65, 4)
        row, left = [], _INF
        for r in range(low, n - i + above + 1):
            at = r - nlow
            best = nxt[at] + DELETE if 0 <= at < len(nxt) else _INF
            best = min(best, left + INSERT)
            if fault < 2 and r and 0 <= at - 1 < len(nxt):
                same = STATES[kind] == (last if r % 2 else ("a" if last == "u" else "u"))
                best = min(best, nxt[at - 1] + (0 if same else REROLE) + TRUNCATED * fault)
            row.append(best)
            left = best
        out.append((low, row))
    return out[::-1]


def _cell(table: list[tuple[int, list[int]]], i: int, r: int) -> int:
    low, row = table[i]
    return row[r - low] if low <= r < low + len(row) else _INF


def _trace(codes: str, table: list, last: str, i: int, r: int) -> str:
    """The ASCII-least audit among the cheapest paths from cell (i, r)."""
    out, n = [], len(codes)
    while i < n or r:
        cost = _cell(table, i, r)
        if i < n and _cell(table, i + 1, r) + DELETE == cost:
            out.append("D")
            i += 1
        elif r and _cell(table, i, r - 1) + INSERT == cost:
            out.append("I")
            r -= 1
        else:
            kind = (ord(codes[i]) - 65) // 4
            out.append("K" if STATES[kind] == (last if r % 2 else ("a" if last == "u" else "u")) else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def _best(codes: str, entry: str, last: str) -> tuple[int, str]:
    """Cheapest (cost, audit) that takes the grammar from ``entry`` to ``last``, u or a: every feasible length in one banded table."""
    n, bound = len(codes), 8
    while True:
        table = _tables(codes, last, bound)
        first = "a" if entry == "u" else "u"
        low, row = table[0]
        starts = [(row[r - low], "", 0, r) for r in range(low, low + len(row))
                  if (r == 0 and entry == last) or (r and first == (last if r % 2 else ("a" if last == "u" else "u")))]
        if entry == "-":                                   # a system turn may come first; rows before it go
            for k, c in enumerate(codes):
                kind, fault = divmod(ord(c) - 65, 4)
                if DELETE * k > bound:
                    break
                if STATES[kind] == "s" and fault < 2:
                    lo, after = table[k + 1]
                    starts += [(DELETE * k + TRUNCATED * fault + after[r - lo], "D" * k + "K", k + 1, r) for r in range(max(lo, 1), lo + len(after))
                               if (last if r % 2 else ("a" if last == "u" else "u")) == "u"]
        cost = min((s[0] for s in starts), default=_INF)
        if cost <= bound:
            return cost, min(head + _trace(codes, table, last, i, r) for c, head, i, r in starts if c == cost)
        bound *= 2


@functools.lru_cache(maxsize=1 << 14)
def segment(codes: str, entries: str = STATES, exits: str = STATES) -> dict[tuple[str, str], tuple[int, str]]:
    """Best (cost, audit) of a segment for each (entry, exit) of the grammar; rows are letters A + 4 * kind + fault."""
    n, out = len(codes), {}
    for p in entries:
        for q in exits:
            if q in "ua":
                out[p, q] = _best(codes, p, q)
            elif p == q:
                out[p, q] = (DELETE * n, "D" * n)
            elif p == "-" and q == "s":
                kept = [(DELETE * (n - 1) + TRUNCATED * f, "D" * k + "K" + "D" * (n - k - 1))
                        for k, (kind, f) in enumerate(divmod(ord(c) - 65, 4) for c in codes) if kind == 1 and f < 2]
                if kept:
                    out[p, q] = min(kept)
    return out


def join_segments(a: dict, b: dict) -> dict:
    """Composition of two neighbouring segments."""
    out = {}
    for (p, r), (cost, audit) in a.items():
        for q in STATES:
            if (r, q) in b:
                more, rest = b[r, q]
                old = out.get((p, q))
                if old is None or cost + more < old[0] or cost + more == old[0] and audit + rest < old[1]:
                    out[p, q] = (cost + more, audit + rest)
    return out


def target(k: int, length: int) -> str:
    """Letter k of the grammar string of ``length``: odd ones begin with s."""
    k -= length % 2
    return "s" if k < 0 else "ua"[k % 2]


# ---------------------------------------------------------------- segments of compact rows

def _code(first_seen: Column) -> Column:
    """Letter of a row: role kind and first fault (0 none, 1 truncated, 2 blank, 3 duplicate)."""
    kind = F.greatest(F.instr(F.lit("sua"), F.col("initial")), F.lit(0)) * F.when(F.col("initial") == "", 0).otherwise(1)
    fault = F.when(F.col("blank"), 2).when(~first_seen, 3).when(F.col("cut"), 1).otherwise(0)
    return F.char(F.lit(65) + 4 * kind + fault)


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(key, seg, codes) of rows (key, turn, role, text)."""
    compact = rows.select("key", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.substring("role", 1, 1).alias("initial"),
                          (~F.col("text").rlike(_NO_BLANK)).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("cut"))
    compact = compact.withColumn("_row", F.monotonically_increasing_id())                # equal rows may lie in several ranges
    placed = number_within(compact, ["key"], ["turn", "role", "digest", "_row"], "pos")
    again = (placed.groupBy("key", "role", "digest").agg(F.min("pos").alias("seen"), F.count(F.lit(1)).alias("times"))
             .where("times > 1").drop("times"))
    coded = placed.join(again, ["key", "role", "digest"], "left")
    coded = coded.select("key", "pos", F.expr(f"(pos - 1) div {size}").alias("seg"), _code(F.coalesce(F.col("seen") == F.col("pos"), F.lit(True))).alias("code"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    return coded.groupBy("key", "seg").agg(F.array_join(ordered, "").alias("codes"))


def _solved(size: int):
    def run(frames):
        for x in frames:
            costs, audits, marks = [], [], []
            for seg, codes in zip(x["seg"], x["codes"]):
                entries, exits = "-" if seg == 0 else STATES, "-a" if len(codes) < size else STATES
                merged = "".join(chr(ord(c) - 1) if (ord(c) - 65) % 4 == 3 else c for c in codes)      # both faults must go
                got = segment(merged, entries, exits)
                costs.append([got.get((p, q), (-1, ""))[0] for p in STATES for q in STATES])
                audits.append([got.get((p, q), (-1, ""))[1] for p in STATES for q in STATES])
                kinds = [(ord(c) - 65) // 4 for c in codes]
                faults = [(ord(c) - 65) % 4 for c in codes]
                marks.append([faults.count(2), faults.count(3), faults.count(1),
                              sum(not _legal(a, b) for a, b in zip(kinds, kinds[1:])), kinds[0], kinds[-1]])
            yield x.assign(costs=costs, audits=audits, marks=marks)[["key", "seg", "costs", "audits", "marks"]]
    return run


def _legal(a: int, b: int) -> bool:
    return STATES[a] + STATES[b] in ("su", "ua", "au")


# ---------------------------------------------------------------- one pass over each conversation

class _Conversation:
    """Folds the segments of one conversation, then follows its audit along the rows."""

    def __init__(self, conv_id, gaps):
        self.conv_id, self.gaps = conv_id, gaps
        self.stack, self.marks, self.end = [], [0, 0, 0, 0], None
        self.best, self.at, self.made = None, 0, 0

    def add_segment(self, costs, audits, marks) -> None:
        got = {(p, q): (int(costs[4 * i + j]), audits[4 * i + j]) for i, p in enumerate(STATES) for j, q in enumerate(STATES) if costs[4 * i + j] >= 0}
        self.stack.append((1, got))
        while len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:      # balanced: neighbours of equal weight meet
            (w, b), (_, a) = self.stack.pop(), self.stack.pop()
            self.stack.append((2 * w, join_segments(a, b)))
        self.marks = [a + int(b) for a, b in zip(self.marks, marks)]
        if self.end is not None and not _legal(self.end, int(marks[4])):
            self.marks[3] += 1
        self.end = int(marks[5])

    def solve(self) -> None:
        if self.best is None:
            parts = [m for _, m in self.stack]
            whole = functools.reduce(join_segments, parts) if parts else {("-", "-"): (0, "")}
            self.best = min(whole[k] for k in (("-", "-"), ("-", "a")) if k in whole)
            self.length = len(self.best[1]) - self.best[1].count("D")

    def _made(self, edit: str, role: str, text: str):
        letter, k = target(self.made, self.length), self.made
        self.made += 1
        return k, edit, role if edit == "K" else ROLES[letter], text

    def inserted(self):
        self.solve()
        while self.at < len(self.best[1]) and self.best[1][self.at] == "I":
            self.at += 1
            yield self._made("I", "", "")

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.best[1][self.at]
        self.at += 1
        if edit != "D":
            yield self._made(edit, role, text)


_IN = "key string, phase int, seg long, conv_id {0}, gaps long, costs array<long>, audits array<string>, marks array<long>, turn long, role string, digest binary, text string"
_REPORT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id {0}, position long, edit string, role string, text string"


def _walk(frames):
    """(conversation, repaired turns so far or None at its end) in the order of the sorted rows."""
    now, key = None, None
    for x in frames:
        for r in x.itertuples(index=False):
            if r.key != key:
                if now is not None:
                    yield now, now.inserted()
                    yield now, None
                now, key = _Conversation(r.conv_id, int(r.gaps)), r.key
            elif r.phase == 1:
                now.add_segment(r.costs, r.audits, r.marks)
            else:
                yield now, now.row(r.role, r.text)
    if now is not None:
        yield now, now.inserted()
        yield now, None


def _report(frames):
    import pandas as pd
    names, out, size = [c.split()[0] for c in _REPORT.split(", ")], [], 0
    sha, first = hashlib.sha256(), True
    for now, made in _walk(frames):
        if made is None:
            out.append((now.conv_id, now.gaps, *now.marks, *now.best, sha.hexdigest()))
            sha, first, size = hashlib.sha256(), True, size + len(now.best[1]) + 200
            if size > 1 << 20:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        else:
            for _, _, role, text in made:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
    if out:
        yield pd.DataFrame(out, columns=names)


def _repaired(frames):
    import pandas as pd
    names, out, size = [c.split()[0] for c in _TURNS.split(", ")], [], 0
    for now, made in _walk(frames):
        for k, edit, role, text in made or ():
            out.append((now.conv_id, k, edit, role, text))
            size += len(text) + 100
            if size > 1 << 22:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=names)


def _sorted(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Markers of all conversations, then solved segments, then rows, by conversation."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    distinct = (rows.groupBy("key").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("n")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0))
    markers = (ids.groupBy("key").agg(F.max("conv_id").alias("conv_id")).join(distinct, "key", "left")
               .select("key", F.lit(0).alias("phase"), "conv_id", gaps.alias("gaps")))
    solved = (segments(rows, size).mapInPandas(_solved(size), "key string, seg long, costs array<long>, audits array<string>, marks array<long>")
              .withColumn("phase", F.lit(1)))
    texts = rows.select("key", F.lit(2).alias("phase"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    both = markers.unionByName(solved, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    fields = [f.strip() for f in _IN.format(id_type).replace("array<long>", "array<bigint>").split(", ")]
    both = both.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in fields])
    return both.repartition("key").sortWithinPartitions("key", "phase", "seg", "turn", "role", "digest")


def _run(rows: DataFrame, ids: DataFrame | None, size: int, step, schema: str) -> DataFrame:
    schema = schema.format(rows.schema["conv_id"].dataType.simpleString())
    return _sorted(rows, rows if ids is None else ids, size).mapInArrow(in_slices(step, schema=schema), schema)


def repair_report(rows: DataFrame, ids: DataFrame | None = None, size: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``ids`` (by default of ``rows``): faults, cost, audit and digest of the repaired turns.

    Both are of the form of :func:`turns`.  A conversation without rows has
    zeros, the empty audit and the digest of the empty string.
    """
    return _run(rows, ids, size, _report, _REPORT)


def repair_turns(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The repaired turns: conv_id, position, edit (K, R or I), role, text."""
    return _run(rows, None, size, _repaired, _TURNS)
