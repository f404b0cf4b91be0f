"""Operator tests on tiny hand-made tables: NULLs, ties, edges, cycles, empty inputs."""

import datetime as dt
import hashlib
import itertools
import os

import pytest
from pyspark.sql import functions as F

from tablewright.functions import tsql as Q
from tablewright.operators import dml as M
from tablewright.operators import joins as J
from tablewright.operators import windows as W
from tablewright.operators.numbering import number_rows
from tablewright.plans import ballots as B
from tablewright.plans import compare as C
from tablewright.plans import fingerprint as FP
from tablewright.plans import fractions as FR
from tablewright.plans import graph as G
from tablewright.plans import reports as R
from tablewright.plans import search as SR
from tablewright.plans import sets as ST
from tablewright.plans import star as S


def _key(t):
    return tuple((x is None, "" if x is None else x) for x in t)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)


# ---------------------------------------------------------------- numbering, latest row


def test_number_rows_is_consecutive_in_order(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    out = number_rows(df, [F.col("k").desc()], "n", num_partitions=5).collect()
    pairs = sorted((r["n"], r["k"]) for r in out)
    assert [p[0] for p in pairs] == list(range(1, 5001))
    assert [p[1] for p in pairs] == list(range(4999, -1, -1))


def test_latest_row_both_forms(spark):
    """Ties on the last day, a key with one row, a NULL day, which loses against any day, and a key of NULL days only."""
    day = [None, *[dt.date(2022, 3, k) for k in range(1, 6)]]
    readings = spark.createDataFrame(
        [("roof", day[k], 100 + 7 * k) for k in (2, 5, 0, 3)] + [("roof", day[5], 90)] + [("well", day[1], 4)]
        + [("shed", None, 1)], "meter string, day date, level int")
    one = W.latest(readings, ["meter"], ["day", "level"])
    assert rows(one, "meter", "level") == [("roof", 135), ("shed", 1), ("well", 4)]
    ties = W.latest(readings.where("day is not null"), ["meter"], ["day"], ties=True)
    assert rows(ties, "meter", "level") == [("roof", 90), ("roof", 135), ("well", 4)]


# ---------------------------------------------------------------- dialect helpers


def test_null_concat_rules(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    out = df.select(Q.plus("x", F.lit(" ("), "y", F.lit(")")).alias("p"),
                    Q.concat_nn("x", Q.plus(F.lit(" ("), "y", F.lit(")"))).alias("c"),
                    F.concat_ws(",", "x", "y").alias("w")).collect()
    assert [tuple(r) for r in out] == [(None, "a", "a"), ("a (b)", "a (b)", "a,b")]


def test_tsql_substring_and_charindex(spark):
    df = spark.createDataFrame([("abcdef",)], "s string")
    r = df.select(Q.tsql_substring("s", -1, 4).alias("a"), Q.tsql_substring("s", 3, 2).alias("b"),
                  Q.charindex("cd", "s").alias("c"), Q.charindex("zz", "s").alias("d"),
                  Q.blank_len(F.lit("ab  ")).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("ab", "cd", 3, 0, 2)


# ---------------------------------------------------------------- DML


def test_merge_every_outcome_of_a_two_column_key(spark):
    """Changed, unchanged, new and gone rows over a two-column key with NULL values, all source columns kept."""
    shelf = "aisle string, bin int, item string, qty int"
    old = {("a", 1): ("nail", 40), ("a", 2): ("bolt", None), ("b", 1): ("wire", 7)}
    new = {("a", 1): ("nail", 12), ("b", 1): ("wire", 7), ("b", 3): ("tape", None)}
    target, source = (spark.createDataFrame([(*k, *v) for k, v in x.items()], shelf) for x in (old, new))
    merged, changes = M.merge(target, source, ["aisle", "bin"])
    assert rows(merged, *source.columns) == sorted(((*k, *v) for k, v in new.items()), key=_key)
    by_action = {}
    for r in changes.collect():
        by_action.setdefault(r["action"], set()).add((r["del_aisle"] or r["ins_aisle"], r["del_bin"] or r["ins_bin"]))
    assert by_action["INSERT"] == new.keys() - old.keys() and by_action["DELETE"] == old.keys() - new.keys()
    assert by_action["UPDATE"] <= old.keys() & new.keys() and ("a", 1) in by_action["UPDATE"]
    assert rows(M.upsert(target, source, ["aisle", "bin"]), *source.columns) == sorted(
        ((*k, *v) for k, v in {**old, **new}.items()), key=_key)


# ---------------------------------------------------------------- search


def test_find_occurrences_edges(spark):
    text = "Foo_bar foo\r\nfoofoo [foo] foo"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    allhits = SR.find_occurrences(df, ["id"], "text", "foo", whole_word=False)
    assert rows(allhits, "Pos") == [(1,), (9,), (14,), (17,), (22,), (27,)]
    words = SR.find_occurrences(df, ["id"], "text", "foo", whole_word=True)
    assert rows(words, "Pos") == [(9,), (22,), (27,)]       # "Foo_" and "foofoo" are not whole words
    r = words.where("Pos = 27").first()
    assert r.Total == len(text) and r.Snip == text.replace("\r\n", "  ") and r.PCT == round(27 * 100 / len(text))
    special = spark.createDataFrame([(1, "a[b_c] a[b_c]")], "id int, text string")
    assert rows(SR.find_occurrences(special, ["id"], "text", "[b_c]", whole_word=False), "Pos") == [(2,), (9,)]


# ---------------------------------------------------------------- star schema


def test_star_nulls_and_no_dates(spark):
    staging = spark.createDataFrame(
        [("x", 1.0), (None, 2.0), ("", None), ("x", 4.0), ("x", 5.0), ("", 6.0), (None, 7.0), ("x", 8.0), ("x", 9.0),
         ("x", 10.0), ("", 11.0), (None, 12.0)],
        "cat string, amount double")
    star = S.build_star(staging, "T")
    actions = {c.name: c.action for c in star.columns}
    assert actions == {"cat": "dimension", "amount": "measure"}
    assert rows(star.dims["cat"], "T_cat_Dim_ID", "cat") == [(1, ""), (2, "x")]       # NULL and '' share a row
    assert rows(star.date_dim, "Date_Value") == [(dt.date(9999, 12, 31),)]
    view = rows(star.view, "cat", "amount")
    assert len(view) == 12 and ("", None) in view                                     # NULL measure kept
    assert rows(star.violations, "violations") == [(0,)]


def test_star_datetime_column_gets_date_part(spark):
    staging = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4), 1), (None, 2)], "ts timestamp, n int")
    star = S.build_star(staging, "E")
    assert [p[:2] for p in star.fact_columns] == [("E_ts", "datepart"), ("ts", "straight"), ("n", "straight")]
    got = rows(star.view, "E_ts", "n")
    assert got == [(dt.date(2024, 1, 2), 1), (dt.date(9999, 12, 31), 2)]


# ---------------------------------------------------------------- compare


def test_prune_orphans_and_compare(spark):
    src = spark.createDataFrame([("t", "", "TABLE", "a"), ("c1", "t", "COLUMN", "x"), ("u", "", "TABLE", "b"),
                                 ("c9", "u", "COLUMN", "y")], C.SNAPSHOT_COLS)
    tgt = spark.createDataFrame([("t", "", "TABLE", "a"), ("c1", "t", "COLUMN", "z"), ("v", "v", "TABLE", "c"),
                                 ("c5", "v", "COLUMN", "q")], C.SNAPSHOT_COLS)
    out = rows(C.compare(src, tgt), "Result", "Item")
    # u only in source; its child c9 is pruned (no parent u in target).
    # v names itself as parent, so it counts as a child of a missing parent and is pruned,
    # and an item that is its own parent is no parent for c5, which is pruned as well
    assert out == [("different Properties", "tc1"), ("only in source", "u")]


def test_compare_values_modes(spark):
    a = spark.createDataFrame([("k1", "t", "abc"), ("k2", "t", "abc"), ("k3", "t", "x")], "Item string, ItemType string, Value string")
    b = spark.createDataFrame([("k1", "t", "abcd"), ("k2", "t", "abd"), ("k4", "t", "y")], "Item string, ItemType string, Value string")
    assert rows(C.compare_values(a, b), "Result", "Item") == [
        ("different lengths", "k1"), ("different values", "k2"), ("only in here", "k3"), ("only in other", "k4")]
    assert len(C.compare_values(a, b, values_only=True).collect()) == 2


# ---------------------------------------------------------------- fingerprint


def test_fingerprint_empty_and_order_free(spark):
    empty = spark.createDataFrame([], "a int, b string")
    r = FP.fingerprint(empty, "e", ordered=True).first()
    assert r.row_count == 0 and r.ordered_md5 == hashlib.md5(b"").hexdigest() and r.hash_sum == "0:0"
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    r1 = FP.fingerprint(df, "t", ordered=True).first()
    r2 = FP.fingerprint(df.orderBy(F.col("a").desc()).repartition(3), "t", ordered=True).first()
    assert (r1.hash_sum, r1.ordered_md5) == (r2.hash_sum, r2.ordered_md5)
    hs = sorted(hashlib.md5(t.encode()).hexdigest() for t in ["1:1|1:x", "1:2|N"])
    assert r1.ordered_md5 == hashlib.md5("".join(hs).encode()).hexdigest()


# ---------------------------------------------------------------- matching sets


def test_matching_sets_against_brute_force(spark):
    """Random subsets of five letters: equal, nested, overlapping and disjoint owners, repeated rows."""
    import random
    rng = random.Random(11)
    sets = {o: frozenset(rng.sample("vwxyz", rng.randint(1, 4))) for o in range(40)}
    sets[40], sets[41] = frozenset("q"), frozenset("pr")                  # disjoint from all others
    pairs = [(o, e) for o, s in sets.items() for e in s]
    df = spark.createDataFrame(pairs + pairs[::3], "owner_no int, letter string")
    leader = {s: min(o for o in sets if sets[o] == s) for s in sets.values()}
    members = sorted((leader[s], o) for o, s in sets.items() if leader[s] != o)
    assert rows(ST.equal_pairs(df, "owner_no", "letter"), "leader", "owner") == members
    assert {r["owner"] for r in ST.duplicate_sets(df, "owner_no", "letter").collect()} == {o for pair in members for o in pair}
    nested = [(min(a, b), max(a, b), len(s), "Left subset of right" if a < b else "Right subset of left")
              for (s, a), (t, b) in itertools.permutations(leader.items(), 2) if s < t]
    got = rows(ST.subset_pairs(df, "owner_no", "letter"), "left", "right", "match_count", "relation")
    assert got == sorted(nested + [(a, b, len(sets[b]), "Match") for a, b in members])


# ---------------------------------------------------------------- ballots


def _irv_python(ballots):
    counts = {}
    for b in ballots:
        counts[tuple(b)] = counts.get(tuple(b), 0) + 1
    total = sum(counts.values())
    out, rnd, cur = [], 1, dict(counts)
    while True:
        firsts = {}
        for b, n in cur.items():
            if b:
                firsts[b[0]] = firsts.get(b[0], 0) + n
        order = sorted(firsts.items(), key=lambda t: (-t[1], t[0]))
        out += [(rnd, c, v) for c, v in order]
        if order[0][1] * 2 > total or len(order) == 1:
            return out
        bottom = min(order, key=lambda t: (t[1], t[0]))[0]
        nxt = {}
        for b, n in cur.items():
            nb = tuple(c for c in b if c != bottom)
            nxt[nb] = nxt.get(nb, 0) + n
        cur, rnd = nxt, rnd + 1


def test_instant_runoff_matches_python(spark):
    ballots = [["a", "b", "c"]] * 4 + [["b", "c", "a"]] * 3 + [["c", "b", "a"]] * 2 + [["d", "c", "b", "a"]] * 2
    votes = spark.createDataFrame([(i, c, r + 1) for i, b in enumerate(ballots) for r, c in enumerate(b)],
                                  "voter int, cand string, rnk int")
    prof = B.ballot_profiles(votes, "voter", "cand", "rnk")
    got = [(r["round"], r["candidate"], r["votes"]) for r in B.instant_runoff(prof).collect()]
    assert got == _irv_python(ballots)


def test_instant_runoff_first_round_majority(spark):
    votes = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1)], "voter int, cand string, rnk int")
    got = B.instant_runoff(B.ballot_profiles(votes, "voter", "cand", "rnk")).collect()
    assert {r["round"] for r in got} == {1}


# ---------------------------------------------------------------- fractions


def test_best_fractions_pi_and_whole_number(spark):
    df = spark.createDataFrame([(3.14159265358979,), (2.0,)], "x double")
    out = rows(FR.best_fractions(df, "x", 1000), "value", "Numerator", "Denominator")
    pi = [(n, d) for v, n, d in out if v > 3]
    assert (1, 7) in pi and (16, 113) in pi          # 22/7 and 355/113 as 3 + 1/7, 3 + 16/113
    assert not [r for r in out if r[0] == 2.0]        # a whole number has no useful fraction


def _fractions(x, top, loop):
    """All denominators, as the recipe has them."""
    ip = int(x)
    frac, best, out = x - ip, abs(x - int(x) - 1) if loop else None, []
    for d in range(1, top + (not loop)):
        n = int(abs(d * frac) + 0.5) if abs(d * frac) < 2 ** 51 else 0
        n = -n if frac < 0 else n
        diff = abs(frac - n / d)
        if best is not None and diff < best and (loop or n):
            out.append((x, ip, n, d))
        best = diff if best is None else min(best, diff)
    return out


@pytest.mark.parametrize("top, loop", [(2000, False), (100, True), (1, False), (2, True)])
def test_fraction_walk_equals_all_denominators(spark, top, loop):
    import math
    import random
    r = random.Random(top)
    values = [k / 100 for k in range(0, 101, 7)] + [2.07, 0.5, -0.5, 0.25, 2.0, 0.0, 1 / 3, 2 / 3, -7 / 9, 1e-9, 0.0005, 0.001, 1 - 1e-6, math.pi, -math.e, 1 / 1999, 1999 / 2000,
              (5 ** 0.5 - 1) / 2, 0.15, 0.35, 0.375, 123456.789] + [r.uniform(-3, 3) for _ in range(40)] + [r.randint(1, 300) / r.randint(1, 300) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = rows(FR.best_fractions(df, "x", top, loop), "value", "Integer_Part", "Numerator", "Denominator")
    assert got == sorted({f for v in values for f in _fractions(v, top, loop)})


def test_fractions_stay_in_their_row(spark):
    plan = FR.best_fractions(spark.createDataFrame([(0.3,)], "x double"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


# ---------------------------------------------------------------- graphs


def test_callers_cycle_and_self_edge(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("x", "y")], "red string, ring string")
    got = rows(G.callers(e, "a", 10), "red", "ring", "round")
    assert got == [("a", "b", 0), ("b", "c", 1), ("c", "a", 2), ("c", "c", 2)]
    assert rows(G.callers(e, "a", 1), "red", "ring") == [("a", "b"), ("b", "c")]


def test_neighborhood_drops_large_generation(spark):
    edges = [("F", f"c{i}", 0) for i in range(3)] + [(f"c0", f"g{i}", 1) for i in range(11)] + [("p", "F", 0)]
    e = spark.createDataFrame(edges, "pk string, fk string, nullable int")
    rel, lines = G.neighborhood(e, "F")
    gens = sorted(r["gen"] for r in rel.collect())
    assert 6 not in gens                              # 11 grandchildren > 10: left out
    texts = [r["line"] for r in lines.collect()]
    assert "c0-->F" in texts and "%% 3 CHILD relationships" in texts


def test_denormalize_left_join_for_nullable_fk(spark):
    t = {"f": spark.createDataFrame([(1, 10), (2, None)], "id int, d_id int"),
         "d": spark.createDataFrame([(10, "ten")], "d_id2 int, d_name string")}
    fks = [{"child": "f", "child_cols": ["d_id"], "parent": "d", "parent_cols": ["d_id2"], "nullable": True}]
    out = G.denormalize(t, fks, "f", {"d": ["d_name"]})
    assert out.columns == ["id", "d_name"]
    assert rows(out, "id", "d_name") == [(1, "ten"), (2, None)]


# ---------------------------------------------------------------- aliases


def _alias_python(names, max_pos=30):
    alias = {n: n[:1] for n in names}
    for pos in range(2, max_pos + 1):
        groups = {}
        for n, a in alias.items():
            groups.setdefault(a.lower(), []).append(n)
        for members in groups.values():
            chars = {m[pos - 1:pos].lower() for m in members}
            if len(members) > 1 and len(chars) > 1:
                for m in members:
                    alias[m] = alias[m] + m[pos - 1:pos]
    l3 = {}
    for n, a in alias.items():
        l3.setdefault(a[:3].lower(), []).append(n)
    cand = sorted((n for n, a in alias.items() if len(a.rstrip()) > 4 and len(l3[a[:3].lower()]) > 1),
                  key=lambda n: (len(n.rstrip()), n))
    num = {}
    out = dict(alias)
    for n in cand:
        k = alias[n][:3].lower()
        num[k] = num.get(k, 0) + 1
        out[n] = alias[n][:3] + str(num[k])
    return out


def test_short_alias_matches_python(spark):
    names = ["Orders", "OrderLines", "OrderLinesHistory", "Customer", "CustomerAddress", "Country", "Region",
             "regions", "Part", "PartSupplier", "PartSupply", "Nation"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["alias"] for r in R.short_alias(df, "name").collect()}
    assert got == _alias_python(names)


# ---------------------------------------------------------------- hot-group-safe windows


def test_number_and_rank_within_match_windows(spark):
    from pyspark.sql import Window
    from tablewright.operators import numbering as N
    data = [(k, v, i) for i, (k, v) in enumerate([("a", 3), ("a", 1), ("a", 3), (None, 2), (None, 2), ("b", 5),
                                                  ("a", 2), ("b", 5), ("b", 1), (None, 7)])]
    df = spark.createDataFrame(data, "k string, v int, id int")
    got = N.number_within(df, ["k"], [F.col("v").desc(), F.col("id")], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "id")))
    assert rows(got, "id", "rn") == rows(want, "id", "rn")
    got = N.rank_within(df, ["k"], ["v"], "rk")
    want = df.withColumn("rk", F.rank().over(Window.partitionBy("k").orderBy(F.col("v").desc())))
    assert rows(got, "id", "rk") == rows(want, "id", "rk")


@pytest.mark.parametrize("parts", [1, 3, 8, 40])
def test_segmented_scan_equals_windows(spark, parts):
    """Groups, runs of ties and minima that cross partition boundaries, some over several partitions; NULLs, NaN, decimals, dates, text."""
    import random
    from pyspark.sql import Window
    from tablewright.operators import numbering as N
    r = random.Random(parts)
    data = [("hot" if i % 3 else r.choice(["a", "b", None, "c"]), r.choice([1.0, 2.0, float("nan"), None, 3.0]) if i % 5 else 1.0,
             None if r.random() < .2 else dt.date(2020, 1, 1) + dt.timedelta(r.randrange(400)), None if r.random() < .3 else r.choice("xyzé"), i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, v double, d date, s string, id int").withColumn("n", (F.col("id") * 7 % 31).cast("decimal(9,2)"))
    rank = Window.partitionBy("k").orderBy(F.col("v").desc())
    total = Window.partitionBy("k").orderBy(F.col("v").desc(), "id")
    got = N.number_within(df, ["k"], [F.col("v").desc(), F.col("id")], "rn", num_partitions=parts)
    assert rows(got, "id", "rn") == rows(df.withColumn("rn", F.row_number().over(total)), "id", "rn") and got.columns == [*df.columns, "rn"]
    got = N.rank_within(df, ["k"], ["v"], "rk", num_partitions=parts)
    assert rows(got, "id", "rk") == rows(df.withColumn("rk", F.rank().over(rank)), "id", "rk")
    before = total.rowsBetween(Window.unboundedPreceding, -1)
    for c in ("d", "s", "n", "v"):
        got = N.running_min_within(df, ["k"], [F.col("v").desc(), "id"], c, "m", num_partitions=parts).select("id", F.col("m").cast("string").alias("m"))
        assert rows(got, "id", "m") == rows(df.withColumn("m", F.min(c).over(before).cast("string")), "id", "m"), c
    everything = N.rank_within(df, [], ["s"], "rk", desc=False, num_partitions=parts)
    assert rows(everything, "id", "rk") == rows(df.withColumn("rk", F.rank().over(Window.orderBy("s"))), "id", "rk")
    assert N.number_within(df.limit(0), ["k"], ["id"], num_partitions=parts).count() == 0


def test_segmented_scan_moves_rows_once(spark):
    """After the one range exchange that is written, rows are only looked up: no exchange, no sort, no join with their groups."""
    from tablewright.operators import numbering as N
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    for got in (N.number_within(df, ["k"], ["id"]), N.rank_within(df, ["k"], ["id"]), N.running_min_within(df, ["k"], ["id"], "id")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1 and "Sort" not in plan and "Window" not in plan


def test_compare_null_property_and_case_only_difference(spark):
    src = spark.createDataFrame([("t", "", "TABLE", "Abc"), ("c1", "t", "COLUMN", None)], C.SNAPSHOT_COLS)
    tgt = spark.createDataFrame([("t", "", "TABLE", "abc"), ("c1", "t", "COLUMN", "x")], C.SNAPSHOT_COLS)
    out = rows(C.compare(src, tgt), "Result", "Item", "Source_Properties", "Target_Properties")
    # a NULL property on one side is reported (the filter compares ISNULL(…, '')) but labelled 'match',
    # as in the recipe, whose label CASE compares the NULL with <>; case-only changes count as different
    assert out == [("different Properties", "t", "Abc", "abc"), ("match", "tc1", "", "x")]


def _relations(data):
    sets = {}
    for o, e in data:
        sets.setdefault(o, set()).add(e)
    leader = {}
    for o in sorted(sets):
        leader[o] = next(x for x in sorted(sets) if sets[x] == sets[o])
    out = [(leader[o], o, len(sets[o]), "Match") for o in sets if leader[o] != o]
    for a in set(leader.values()):
        for b in set(leader.values()):
            if sets[a] < sets[b]:
                out.append((min(a, b), max(a, b), len(sets[a]), "Left subset of right" if a < b else "Right subset of left"))
    return leader, sorted(out)


@pytest.mark.parametrize("per_list", [2, 1000])
def test_subsets_with_an_element_that_all_hold(spark, per_list):
    import random
    r = random.Random(9)
    data = [(o, "all") for o in range(60)] + [(o, r.choice("abcdef")) for o in range(60) for _ in range(r.randint(0, 4))]
    df = spark.createDataFrame(data, "o int, e string")
    assert rows(ST.subset_pairs(df, "o", "e", per_list), "left", "right", "match_count", "relation") == _relations(data)[1]
    big = spark.createDataFrame([(o, "all") for o in range(3000)] + [(o, f"own{o}") for o in range(0, 3000, 2)], "o int, e string")
    membership, elements = ST.set_classes(big, "o", "e")
    found = ST.subset_candidates(membership, elements, 100)
    assert found.count() == 1500 and found.select("a").distinct().count() == 1


def test_colliding_signatures_give_the_right_classes(spark):
    import random
    r = random.Random(1)
    data = [(o, e) for o in range(40) for e in r.sample("abcd", r.choice([1, 2, 2, 3]))]
    df = spark.createDataFrame(data, "o int, e string")
    for weak in (lambda e: [], lambda e: [F.max(F.length(e))], ST._sums):
        membership, elements = ST.set_classes(df, "o", "e", weak)
        assert dict(rows(membership, "owner", "leader")) == _relations(data)[0]
        assert {(o, e) for o, e in rows(elements, "leader", "element")} == {(o, e) for o, e in data if _relations(data)[0][o] == o}


def test_identical_single_element_sets(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "A"), (5, "B")], "o int, e string")
    assert rows(ST.equal_pairs(df, "o", "e"), "leader", "owner") == [(1, 2), (1, 3)]
    subs = rows(ST.subset_pairs(df, "o", "e"), "left", "right", "relation")
    assert subs == [(1, 2, "Match"), (1, 3, "Match"), (1, 5, "Left subset of right"), (4, 5, "Left subset of right")]


# ---------------------------------------------------------------- skew: one key holds a third of the rows


def test_hot_key_results_are_whole(spark):
    from pyspark.sql import Window
    from tablewright.operators import numbering as N
    n = 6000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 97).alias("k"),
        ((F.col("id") * 7919) % 10007).alias("v"), F.col("id"))
    latest = W.latest(df, ["k"], ["v", "id"])
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id").desc()))) \
             .where("r = 1").drop("r")
    assert rows(latest, "k", "v", "id") == rows(want, "k", "v", "id")
    got = N.number_within(df, ["k"], [F.col("v"), F.col("id")], "rn")
    assert got.count() == n
    hot = [r["rn"] for r in got.where("k = -1").collect()]
    assert sorted(hot) == list(range(1, n // 3 + 1))
    sets = spark.range(n).select((F.col("id") % 2000).alias("o"), F.when(F.col("id") < 4000, "x").otherwise("y").alias("e"))
    eq = ST.equal_pairs(sets, "o", "e")            # owners 0..1999 all hold {x, y}: one hot class
    assert eq.count() == 1999 and {r["leader"] for r in eq.select("leader").distinct().collect()} == {0}


# ---------------------------------------------------------------- templates, sinks, forecasts


def test_template_merge_case_insensitive_and_ordered(spark):
    from tablewright.plans.templates import template_merge
    df = spark.createDataFrame([(9, "tea", "$0 \\1"), (4, "rye", "x")], "rank int, Crop string, price string")
    out = template_merge(df, "<[CROP]|[Price]|[crop]>", ["rank"], "").first()["text"]
    assert out == "<rye|x|rye><tea|$0 \\1|tea>"


def test_incremental_new_without_completed_items(spark):
    from tablewright.sources.sinks import incremental_new
    items = spark.createDataFrame([("0001_a",), ("0003_b",), ("x_c",)], "name string")
    ledger = spark.createDataFrame([("0002_a", False)], "name string, done boolean")
    got = rows(incremental_new(items, "name", ledger, "name", done=F.col("done")), "name")
    assert got == [("0001_a",), ("0003_b",)]          # nothing completed → high-water mark 0; non-numbers skipped
    got = rows(incremental_new(items, "name", ledger.withColumn("done", F.lit(True)), "name", done=F.col("done")), "name")
    assert got == [("0003_b",)]


def test_key_capacity_formula(spark):
    keys = spark.createDataFrame([("t1", "id", "smallint", 16384), ("t2", "id", "int", 1000), ("t3", "id", "tinyint", 64)],
                                 "table_name string, column_name string, data_type string, last_value bigint")
    got = rows(R.key_capacity(keys, 25), "table_name", "pct")
    assert got == [("t1", 50.0), ("t3", 50.0)]


def test_exhaustion_forecast_small(spark):
    d = dt.date
    stats = spark.createDataFrame([("T", 100, d(2024, 1, 1), 1100), ("T", 600, d(2024, 1, 11), 1100),
                                   ("T", 599, d(2024, 1, 10), 1100)],
                                  "TableName string, IDValue bigint, CreateDate date, IDLimit bigint")
    r = R.exhaustion_forecast(stats).first()
    # pairs more than 5 days apart: (100→600, 10 days, 500 ids: 10 more days) and (100→599, 9 days)
    assert r.TableName == "T" and r.FromForecast == d(2024, 1, 19) and r.ToForecast == d(2024, 1, 21)


def test_denormalize_keeps_id_without_unique_key(spark):
    t = {"f": spark.createDataFrame([(1, 10)], "id int, o_id int"),
         "o": spark.createDataFrame([(10, "x")], "o_id2 int, o_note string")}
    fks = [{"child": "f", "child_cols": ["o_id"], "parent": "o", "parent_cols": ["o_id2"], "nullable": False}]
    out = G.denormalize(t, fks, "f", {})
    assert out.columns == ["id", "o_id"]


def test_fingerprint_tells_shifted_and_null_values_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("N", "c")]
    sums = {FP.fingerprint(spark.createDataFrame([r], "x string, y string"), "t").first().hash_sum for r in rows}
    assert len(sums) == len(rows)


def test_runoff_goes_on_to_the_last_candidate(spark):
    from tablewright.plans.ballots import instant_runoff
    ballots = [(i, f"c{i:02d}", 1, 1 + i) for i in range(53)]       # nobody ever has a majority of all votes
    got = instant_runoff(spark.createDataFrame(ballots, "ranking_id int, candidate string, rank int, votes long")).toPandas()
    assert got["round"].max() == 53 and got[got["round"] == 53]["candidate"].tolist() == ["c52"]


def test_callers_follow_a_long_chain_and_exclude_after_the_walk(spark):
    from tablewright.plans.graph import callers
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(15)], "red string, ring string")
    assert callers(edges, "n00").count() == 15
    left = {(r.red, r.ring) for r in callers(edges, "n00", exclude=["n03"]).collect()}
    assert len(left) == 14 and ("n03", "n04") not in left and ("n04", "n05") in left


def test_merge_inserts_whole_rows_and_refuses_repeated_keys(spark):
    from tablewright.operators.dml import merge
    target = spark.createDataFrame([(1, "a", 10)], "k int, v string, w int")
    source = spark.createDataFrame([(1, "b", 11), (2, "c", 12)], "k int, v string, w int")
    new, _ = merge(target, source, ["k"], update_cols=["w"])
    assert sorted(tuple(r) for r in new.collect()) == [(1, "a", 11), (2, "c", 12)]
    twice = source.union(source)
    for refused in (lambda: merge(target, twice, ["k"])[0], lambda: merge(target, twice, ["k"])[1], lambda: M.update_only(target, twice, ["k"], ["w"]),
                    lambda: M.update_from_join(target, twice.withColumnRenamed("w", "x").drop("v"), ["k"], {"w": F.col("x")})):
        with pytest.raises(Exception, match="several rows with one key"):
            refused().collect()
    loose = source.union(spark.createDataFrame([(None, "n", 1), (None, "n", 1)], source.schema))
    new, changes = merge(target, loose, ["k"], delete_unmatched=False)
    assert rows(new, "k", "v", "w") == [(1, "b", 11), (2, "c", 12), (None, "n", 1), (None, "n", 1)]
    assert rows(changes, "action", "ins_k") == [("INSERT", 2), ("INSERT", None), ("INSERT", None), ("UPDATE", 1)]


def test_unique_source_costs_no_exchange_of_its_own(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.range(100).withColumnRenamed("id", "k").withColumn("w", F.lit(1))
        plan = M.update_only(t, t, ["k"], ["w"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_counts_every_type_exactly(spark):
    from tablewright.sources.profile import column_counts, column_profile
    when = dt.datetime(2020, 1, 1, 1, 2, 3, 4)
    data = [(1, 0.0, "a", when, dt.date(2020, 1, 2), b"x", True, [1]), (None, -0.0, "A", when, None, b"y", None, [1]), (1, float("nan"), None, None, None, b"x", False, None)]
    df = spark.createDataFrame(data, "i int, d double, s string, t timestamp, y date, b binary, o boolean, l array<int>")
    got = {r.column_name: (r.null_count, r.distinct_count, r.rows) for r in column_profile(df, with_rows=True).collect()}
    assert got == {"i": (1, 1, 3), "d": (0, 2, 3), "s": (1, 2, 3), "t": (1, 1, 3), "y": (2, 1, 3), "b": (0, 2, 3), "o": (1, 2, 3), "l": (1, 1, 3)}
    text = {r.column_name: (r.min_text, r.max_text, r.min_num) for r in column_profile(df).collect()}
    assert text["t"] == ("2020-01-01 01:02:03.000004",) * 2 + (None,) and text["s"] == ("A", "a", None) and text["y"][0] == "2020-01-02" and text["i"][2] == 1.0
    assert [(r.null_count, r.distinct_count, r.rows) for r in column_profile(df.limit(0), with_rows=True).collect()] == [(0, 0, 0)] * 8
    plan = column_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 2


def test_occurrences_across_line_breaks_and_blank_runs(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "one\ntwo"), (3, "one \t two"), (4, "ONE\r\nTWO")], "id int, text string")
    assert rows(SR.find_occurrences(df, ["id"], "text", "one two"), "id") == [(1,), (2,)]
    assert rows(SR.find_occurrences(df, ["id"], "text", "one two", collapse=True), "id") == [(1,), (2,), (3,), (4,)]


def test_or_join_gives_a_pair_of_two_branches_once(spark):
    from tablewright.operators.joins import or_join
    a = spark.createDataFrame([(1, 1, 5), (2, None, 5), (3, 3, None)], "x int, y int, w int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    out = or_join(a, b, [(a["x"] == b["k"], a["w"] > 0), (a["y"] == b["k"], F.lit(True))])
    assert rows(out, "x", "k") == [(1, 1), (2, 2), (3, 3)]


def test_denormalize_one_parent_in_two_roles(spark):
    t = {"trip": spark.createDataFrame([(1, 7, 8), (2, 8, None)], "trip int, from_id int, to_id int"),
         "town": spark.createDataFrame([(7, "Ulm"), (8, "Bonn")], "town_id int, town string")}
    fks = [{"child": "trip", "child_cols": [c], "parent": "town", "parent_cols": ["town_id"], "nullable": c == "to_id"}
           for c in ("from_id", "to_id")]
    out = G.denormalize(t, fks, "trip", {"town": ["town"]})
    assert out.columns == ["trip", "town", "to_id_town"]
    assert rows(out, *out.columns) == [(1, "Ulm", "Bonn"), (2, "Bonn", None)]


def test_exhaustion_forecast_of_wide_keys(spark):
    limits = {"big": R.KEY_LIMITS["bigint"], "int": R.KEY_LIMITS["int"], "full": 200}
    stats = spark.createDataFrame([(t, k, dt.date(2024, 1, 1 + k // 10), n) for t, n in limits.items() for k in (10, 200)],
                                  "TableName string, IDValue bigint, CreateDate date, IDLimit bigint")
    got = {r["TableName"]: r for r in R.exhaustion_forecast(stats).collect()}
    assert got["full"]["FromDays"] == 0 and got["full"]["ToForecast"] == dt.date(2024, 1, 21)
    assert got["int"]["FromDays"] == int((limits["int"] - 200) / 190 * 19) and got["int"]["FromForecast"] is None
    assert got["big"]["ToDays"] > 10**17 and got["big"]["ToForecast"] is None


def test_column_factors_are_exact_and_count_null_as_a_value(spark):
    df = spark.range(1000).select((F.col("id") % 250).cast("string").alias("a"), F.lit(None).cast("string").alias("b"),
                                  F.when(F.col("id") < 500, F.lit("x")).alias("c"))
    assert S.cardinality_factors(df, ["a", "b", "c"]) == {"a": 4, "b": 1000, "c": 500}
    assert S.cardinality_factors(df.limit(0), ["a"]) == {"a": 0}


# ---------------------------------------------------------------- intermediate tables

def test_scratch_removes_what_is_not_kept(spark, tmp_path):
    from tablewright import session
    root = os.path.join(session.checkpoint_dir(spark).replace("file:", ""), "tables")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with session.scratch(spark) as outer:
        with session.scratch(spark) as keep:
            a = session.cut_lineage(spark.range(10))
            b = keep(a.where("id > 6"))
        assert len(set(os.listdir(root)) - before) == 1 and b.count() == 3
        c = outer(b.where("id > 8"))
    assert c.collect()[0][0] == 9 and len(set(os.listdir(root)) - before) == 1
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        session.cut_lineage(spark.range(3))
        raise ZeroDivisionError
    assert len(set(os.listdir(root)) - before) == 1 and session._scratches() == []


# ---------------------------------------------------------------- schema-free XML

def test_xml_walk_keeps_order_kinds_and_text(spark):
    from tablewright.plans import xmlops as X
    doc = '<a k="1"><b/>x<c>y</c><b z="&lt;"><d/></b>tail</a>'
    df = spark.createDataFrame([(1, doc, "q"), (2, None, "q"), (3, "<a>", "q"), (4, "", "q")], "id int, doc string, node string")
    got = {r.id: r.nodes for r in X.with_nodes(df, "doc", fragments_below="/a").collect()}
    assert [(n.node, n.parent, n.path, n.nth, n.text, n.attributes) for n in got[1]] == [
        (0, -1, "/a", 1, "xtail", {"k": "1"}), (1, 0, "/a/b", 1, "", {}), (2, 0, "/a/c", 1, "y", {}), (3, 0, "/a/b", 2, "", {"z": "<"}), (4, 3, "/a/b/d", 1, "", {})]
    assert [n.xml for n in got[1]] == [None, "<b />", "<c>y</c>", '<b z="&lt;"><d /></b>', None]
    assert got[2] is None and got[3] is None and got[4] is None
    kids = X.children(X.with_nodes(df, "doc"), "/a/*", ["id"])
    assert [(r.id, r.ordinal, r.n.name) for r in kids.orderBy("id", "ordinal").collect()] == [(1, 1, "b"), (1, 2, "c"), (1, 3, "b")]


def test_xml_shred_takes_unknown_locks_and_processes_without_frames(spark):
    from tablewright.plans import xmlops as X
    body = ('<process-list><process id="p1"><executionStack><frame procname="f" line="1"/><frame procname="g"/><frame procname="h" line="3">s</frame></executionStack></process>'
            '<process id="p2"/><process id="p3"><executionStack><frame line="9"/></executionStack><inputbuf>i</inputbuf></process></process-list>'
            '<resource-list><newlock a="1"/><newlock/><pagelock objectname="x" mode="U"/></resource-list>')
    df = spark.createDataFrame([(1, f'<event timestamp="bad"><data><value><deadlock>{body}</deadlock></value></data></event>'), (2, None)], "id int, doc string")
    ev = X.parse_events(df, "doc", "id")
    assert rows(X.shred_frames(ev, "id"), "process_id", "frame", "procname", "line") == [("p1", 1, "f", 1), ("p1", 2, "g", None), ("p1", 3, "h", 3), ("p3", 1, None, 9)]
    assert rows(X.shred_processes(ev, "id"), "process_id", "n_frames", "stack", "inputbuf") == [("p1", 3, "f:1 < g < h:3", None), ("p2", 0, "", None), ("p3", 1, "9", "i")]
    assert rows(X.shred_resources(ev, "id"), "ordinal", "resource_type", "attributes", "mode") == [(1, "newlock", "a=1", None), (2, "newlock", "", None),
                                                                                                 (3, "pagelock", "mode=U;objectname=x", "U")]
    assert X.shred_victims(ev, "id").count() == 0
    assert [(r.id, r.Deadlock_Date, r.Res1_Type, r.Proc2_Line) for r in X.summary(ev, "id").orderBy("id").collect()] == [(1, None, "newlock", None), (2, None, None, None)]


# ---------------------------------------------------------------- containment and wildcard joins

@pytest.mark.parametrize("q", [1, 2, 4])
def test_contains_join_equals_brute_force(spark, q):
    import random
    r = random.Random(q)
    texts = [(i, "".join(r.choice("abA. %_") for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "x\ny😀é" * 3), (62, "")]
    words = [(i, "".join(r.choice("abB. %_") for _ in range(r.randint(0, 6)))) for i in range(60)] + [(60, None), (61, "Y😀"), (62, "\ny"), (63, "zzzz"), (64, "É")]
    t = spark.createDataFrame(texts, "id int, text string")
    w = spark.createDataFrame(words, "wid int, word string")
    got = rows(J.contains_join(t, "id", "text", w, "word", q=q), "id", "wid")
    assert got == sorted((i, j) for i, a in texts for j, b in words if a is not None and b is not None and b.lower() in a.lower())
    assert J.contains_join(t, "id", "text", w.limit(0), "word", q=q).count() == 0 and J.contains_join(t.limit(0), "id", "text", w, "word", q=q).count() == 0


def test_only_grams_of_patterns_leave_the_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "_LETTERS", 100)                # several pieces a batch
    texts = [(i, f"{i:05d} lorem ipsum dolor sit amet " * 3) for i in range(200)] + [(200, ""), (200, "needle")]
    t = spark.createDataFrame(texts, "id int, text string")
    w = spark.createDataFrame([(1, "needle"), (2, "00042 L"), (3, "mm"), (4, "é")], "wid int, word string")
    made, cut = [], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df: made.append(cut(df)) or made[-1])
    grams, seen = J._grams, []
    monkeypatch.setattr(J, "_grams", lambda *args: seen.append(grams(*args)) or seen[-1])
    assert rows(J.contains_join(t, "id", "text", w, "word"), "id", "wid") == [(42, 2), (200, 1)]
    assert seen[1].count() < 0.1 * sum(len(x) for _, x in texts)


def test_contains_and_wildcard_joins_have_no_nested_loop(spark):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()

    t = spark.createDataFrame([(1, "some text")], "id int, text string")
    w = spark.createDataFrame([(1, "text"), (2, "o"), (3, "")], "wid int, word string")
    rules = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("r_a"), F.when(F.col("id") % 3 != 1, F.col("id") % 7).alias("r_b"),
                                        F.col("id").alias("rule"))
    data = spark.range(2000).select((F.col("id") * 50).alias("a"), (F.col("id") % 9).alias("b"))
    matched = J.wildcard_lookup(data, rules, ["a", "b"])
    for p in (plan(J.contains_join(t, "id", "text", w, "word")), plan(matched)):
        assert "NestedLoop" not in p and "Cartesian" not in p
    assert matched.count() == sum((1 if (a % 3 == 2 and a % 7 == b) else 0) + (1 if a % 3 == 1 else 0) for a, b in ((50 * i, i % 9) for i in range(2000))) + sum(
        sum(1 for x in range(0, 100_000, 3) if x % 7 == b) * sum(1 for i in range(2000) if i % 9 == b) for b in range(7))


def test_wildcard_rules_of_every_shape(spark):
    data = [(a, b) for a in ("R", "A", None) for b in ("O", "F", None)]
    rules = [("R", None, 1), (None, "O", 2), ("A", "F", 3), (None, None, 4), ("Z", None, 5), ("R", None, 6)]
    df = spark.createDataFrame(data, "a string, b string")
    got = rows(J.wildcard_lookup(df, spark.createDataFrame(rules, "r_a string, r_b string, rule int"), ["a", "b"]), "a", "b", "rule")
    assert got == sorted((a, b, n) for a, b in data for ra, rb, n in rules if a is not None and b is not None and a == (ra or a) and b == (rb or b))
    assert J.wildcard_lookup(df, spark.createDataFrame([], "r_a string, r_b string, rule int"), ["a", "b"]).count() == 0


def test_queries_are_called_by_their_first_known_name(spark):
    base = dt.datetime(2024, 1, 10, 23)
    texts = {1: "(@a int)select\tx from t where k = 1;", 2: "select x from t where k = 1;", 3: "SELECT StatMan([SC0]) FROM [s].[t] TABLESAMPLE SYSTEM (1) x",
             4: "SELECT statman([SC0]) FROM [s].[u] WITH (READUNCOMMITTED) x", 5: "select nothing known " + "y" * 60, 6: "SELECT StatMan([SC0]) no table"}
    stats = spark.createDataFrame([(k, 1, base, base + dt.timedelta(hours=1), 1, 10.0, v) for k, v in texts.items()],
                                  "query_id int, plan_id int, start_time timestamp, end_time timestamp, count_executions long, max_duration double, query_text string")
    names = spark.createDataFrame([(2, "named"), (9, "other")], "query_id int, name string")
    modules = spark.createDataFrame([("m2", "proc\r\n\tSELECT x from\tt where k = 1;"), ("m1", "a select x from t where k = 1; b"), ("m0", "k = 1;")], "name string, definition string")
    got = R.resource_top(stats, F.lit("2024-01-10 19:00:00").cast("timestamp"), 5, 4, 1, names, modules)
    assert rows(got, "activity") == sorted([("m1",), ("named",), ("UPDATE STATS [s].[t]",), ("UPDATE STATS [s].[u]",), ("select nothing known " + "y" * 29 + " ...",),
                                            ("SELECT StatMan([SC0]) no table ...",)])
    plain = R.resource_top(stats, F.lit("2024-01-10 19:00:00").cast("timestamp"), 5, 4, 1)
    assert ("select x from t where k = 1; ...",) in rows(plain, "activity")


# ---------------------------------------------------------------- lists in chunks, subtotals, former caps

def test_chunked_lists_of_a_hot_group(spark):
    """A group with nearly all rows comes in bounded pieces, whose join is the whole list."""
    from tablewright.operators import aggregates as A
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 3).alias("g"), F.col("id"), F.col("id").cast("string").alias("v"))
    out = A.chunked_list(df, ["g"], [F.col("id").desc()], "v", ",", chunk=100)
    assert out.agg(F.max(F.size(F.split("text", ",")))).first()[0] == 100
    got = {}
    for r in out.orderBy("g", "chunk").collect():
        got.setdefault(r.g, []).append(r.text)
    for g in (None, 0, 1, 2):
        assert ",".join(got[g]) == ",".join(str(i) for i in range(4999, -1, -1) if (None if i % 50 else i % 3) == g)
    whole = [r.text for r in A.chunked_list(df, [], ["id"], "v", ";", chunk=999).orderBy("chunk").collect()]
    assert ";".join(whole) == ";".join(map(str, range(5000))) and len(whole) == 6
    assert A.chunked_list(df.limit(0), ["g"], ["id"], "v", ",").count() == 0


def test_subtotals_come_in_report_order(spark):
    from tablewright.operators import aggregates as A
    df = spark.createDataFrame([("b", 2, 1.0), ("a", 1, 2.0), (None, 3, 4.0), ("b", None, 8.0), ("a", 1, 16.0)], "g string, k int, v double")
    got = A.group_subtotals(df, ["g"], ["k"], "v").orderBy("place").collect()
    assert [(r.place, r.level, r.g, r.k, r.value) for r in got] == [
        (1, "group", None, None, 4.0), (2, "detail", None, 3, 4.0), (3, "group", "a", None, 18.0), (4, "detail", "a", 1, 18.0),
        (5, "group", "b", None, 9.0), (6, "detail", "b", None, 8.0), (7, "detail", "b", 2, 1.0), (8, "total", None, None, 31.0)]


def test_former_caps(spark):
    from tablewright.operators import aggregates as A
    from tablewright.sources.generators import letter_code
    same = "x" * 35
    names = spark.createDataFrame([(same + "a",), (same + "b",), ("x",), ("",)], "name string")
    alias = dict(rows(R.short_alias(names), "name", "alias"))
    assert len(set(alias.values())) == 4 and len({a for n, a in rows(R.short_alias(names, max_pos=30), "name", "alias")}) == 3
    parts = spark.createDataFrame([("t", f"brand{i:02d}") for i in range(30)], "t string, b string")
    assert len(A.two_level_list(parts, ["t"], "b").first()["examples"]) == 30 * 10 + 29 * 2 and len(A.two_level_list(parts, ["t"], "b", cut=50).first()["examples"]) == 50
    codes = spark.range(676).select(letter_code("id").alias("c"))
    assert codes.distinct().count() == 676 and codes.where("c between 'AA' and 'ZZ'").count() == 676
    with pytest.raises(Exception, match="no two-letter code for 676"):
        spark.range(677).select(letter_code("id")).collect()


# ---------------------------------------------------------------- many terms in many sources

def _plain_hits(text, term, whole):
    import re
    text, out = text.replace("\r\n", "  ").replace("\n", " ").replace("\t", " "), []
    for m in re.finditer(re.escape(term.lower()), SR._folded(text)):
        around = [text[m.start() - 1:m.start()], text[m.end():m.end() + 1]] if m.start() else ["", text[m.end():m.end() + 1]]
        if not (whole and any(c and re.match("[_@#$a-z0-9]", c.lower()) for c in around)):
            out.append((m.start() + 1, text[max(0, m.start() - 5):m.end() + 5]))
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_many_terms_in_many_sources(spark, whole):
    import random
    r = random.Random(3)
    made = ["".join(r.choice(["ab", "a", "B", " ", "aba", "\n", "<&>", "é", "İ"]) for _ in range(40)) for _ in range(30)] + ["", None, "aaaa", "ABAB"]
    terms = ["ab", "aba", "aa", "AB", "b a", "é", "<&"]
    frames = {n: (spark.createDataFrame([(i, t) for i, t in enumerate(made[k::2])], f"key{k} int, body string"), F.col(f"key{k}"), "body") for k, n in enumerate("xy")}
    got = sorted((r.source, r.id, r.term, r.Pos, r.Snip) for r in SR.search_sources(frames, terms, whole, 5, 5).collect())
    assert got == sorted((n, str(i), term, pos, snip) for k, n in enumerate("xy") for i, t in enumerate(made[k::2]) if t is not None
                         for term in terms for pos, snip in _plain_hits(t, term, whole))
    import xml.etree.ElementTree as ET
    wide = SR.search_sources(frames, ["<&"], False, 1, 1, xml=(9, 9)).collect()
    assert wide and all("<&" in ET.fromstring(r.xml).text for r in wide)
    plan = SR.search_sources(frames, terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        SR.search_sources(frames, [])


# ---------------------------------------------------------------- keys found in the data, one-pass statistics, ordered fingerprints

def test_smallest_unique_column_sets(spark):
    import random
    from itertools import combinations
    r = random.Random(5)
    for case in range(6):
        data = [(r.randrange(4), r.randrange(4), r.randrange(3), None if case == 1 and i == 3 else r.randrange(30), 1.0) for i in range(12)]
        data = list(dict.fromkeys(data)) if case < 5 else data + data[:1]
        df = spark.createDataFrame(data, "a int, b int, c int, d int, e double")
        want = []
        for k in range(1, 6):
            sets = [s for s in combinations(range(5), k) if len({tuple(x[i] for i in s) for x in data}) == len(data) and all(x[i] is not None for x in data for i in s)]
            if sets:
                want = [tuple("abcde"[i] for i in s) for s in sets]
                break
        assert R.unique_column_sets(df) == want, case
    assert R.unique_column_sets(spark.createDataFrame([], "a int")) == []
    twice = spark.createDataFrame([("1", "23"), ("12", "3"), ("1", "3"), ("12", "23")], "a string, b string")       # equal when joined without lengths
    assert R.unique_column_sets(twice) == [("a", "b")] and R.unique_column_sets(twice, max_columns=1) == []
    sizes = {r.column_name: (r.chars, r.null_cells, r.in_key, r.key_columns) for r in R.table_sizes({"t": twice}).collect()}
    assert sizes == {"a": (6, 0, True, "( 2 columns: a, b )"), "b": (6, 0, True, "( 2 columns: a, b )")}


def test_unique_column_sets_look_at_few_rows_first(spark, monkeypatch):
    """Most sets are refuted by a part of the rows; a repeat that only the last look sees still counts."""
    df = spark.range(4000).select((F.col("id") % 200).alias("a"), (F.col("id") / 200).cast("int").alias("b"), F.lit(0.0).alias("z"),
                                  F.when(F.col("id") == 0, 1).otherwise(F.col("id")).alias("nearly"), F.array(F.col("id") % 2).alias("odd"))
    monkeypatch.setattr(R, "_LOOK", 250)
    looks, look = [], R._look
    monkeypatch.setattr(R, "_look", lambda df, sets, share: looks.append((len(sets), len(sets[0]), share)) or look(df, sets, share))
    assert R.unique_column_sets(df) == [("a", "b"), ("a", "nearly"), ("nearly", "odd")]
    assert looks[:2] == [(6, 5, 16), (1, 5, 1)] and max(n for n, _, share in looks if share == 1) < 10
    assert R.unique_column_sets(df.unionByName(df.limit(1))) == []


def test_all_rows_are_compared_by_packed_hashes(spark, monkeypatch):
    """What agrees by chance in the packed bits is no repeat, a single pair of equal rows is one; as many sets as there are, each is compared."""
    import numpy as np
    for n, bits in [(1, 30), (5, 3), (900, 44), (900, 12), (300, 64)]:
        v = np.sort(np.random.default_rng(n).integers(0, 1 << bits, n, np.uint64, endpoint=False) if bits < 64 else np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        low, data = R._pack(v, bits)
        assert (R._unpack(low, n, data) == v).all()
    monkeypatch.setattr(R, "_SORTED", 512)
    n = F.col("id")
    df = spark.range(4000).select(n.alias("v"), (n % 50).alias("a"), (n / 50).cast("int").alias("b"), (n * 0.5).alias("d"), n.cast("string").alias("s"), F.array(n).alias("l"),
                                  F.when(n == 3999, 1).otherwise(n).alias("pair"), F.when(n == 1, -0.0).otherwise(n * 1.0 - F.when(n == 0, 0).otherwise(1)).alias("zeros"), F.lit("x").alias("same"))
    for most in (1, 64):
        assert [c for c in df.columns if not R._repeats(df, (c,), 4000, most)] == ["v", "d", "s", "l"]
    assert not R._repeats(df, ("a", "b"), 4000) and R._repeats(df, ("a", "same"), 4000) and not R._repeats(df, ("same", "s"), 4000)
    want = R.unique_column_sets(df.drop("v", "d", "s", "l"))
    assert want[0] == ("a", "b") and ("a", "pair") in want
    repeats, asked = R._repeats, []
    monkeypatch.setattr(R, "_LOOK", 100)
    monkeypatch.setattr(R, "_repeats", lambda df, columns, *x: asked.append(columns) or repeats(df, columns, *x))
    assert R.unique_column_sets(df.drop("v", "d", "s", "l")) == want and all(s in asked for s in want)
    asked.clear()
    assert {r.key_columns for r in R.table_sizes({"t": df.drop("v", "d", "s", "l")}).collect()} == {"( 2 columns: a, b )"}
    assert asked[-1] == ("a", "b")                              # the sets behind the key are not compared
    assert R.unique_column_sets(df.unionByName(df.where("v = 7"))) == []


def test_a_compared_row_takes_some_bytes_and_leaves_none(spark, monkeypatch):
    from contextlib import nullcontext
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written(run):
        before = {f.getPath() for f in _listed(files)}
        run()
        return sum(f.length() for f in _listed(files) if f.getPath() not in before)

    df = spark.range(200_000).select(F.col("id").alias("a"), F.lit(1).alias("b"))
    monkeypatch.setattr(R, "_LOOK", 1 << 10)
    assert written(lambda: R._look_at_all(df, [("a", "b")], 200_000)) == 0 and written(lambda: R._look(df, [("a", "b")], 2)) == 0
    monkeypatch.setattr(R, "shuffles_removed", nullcontext)
    assert 0 < written(lambda: R._look_at_all(df, [("a", "b")], 200_000)) < 6 * 200_000


def _listed(files):
    found = files.getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_star_fact_numbers_every_row(spark, tmp_path):
    from datetime import datetime
    from tablewright.queries.products import star_fact
    data = [(k, 1, 2, n, 3.0, 4.0 + k, 0.1, 0.2, "R" if n % 2 else "A", "O", datetime(2020, 1, 1 + n)) for k in (5, 2, 9) for n in (3, 1, 2)] * 2
    spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = star_fact(spark, str(tmp_path)).collect()
    assert sorted((r.L_Fact_ID, r.l_orderkey, r.l_linenumber) for r in got) == [(i + 1, x[0], x[3]) for i, x in enumerate(sorted(data))]


def test_spread_join_deals_a_hot_key_into_parts(spark):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), F.when(F.col("id") > 5, F.col("id")).alias("a"))
    right = spark.range(400).select(F.when(F.col("id") % 4 < 3, F.lit(1)).otherwise(F.when(F.col("id") % 8 == 3, F.lit(2))).cast("long").alias("j"), F.lit("same").alias("b"))
    want = left.join(right, F.col("k") == F.col("j"))
    got = J.spread_join(left, right, "k", "j", pairs=1000)
    assert got.columns == ["k", "a", "j", "b"] and rows(got, *got.columns) == rows(want, *got.columns)
    assert "Broadcast" not in J.spread_join(left, right, "k", "j")._jdf.queryExecution().optimizedPlan().toString()
    largest = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert largest < 0.6 * 100 * 300                       # key 1 alone has 100 * 300 pairs
    assert J.spread_join(left, right.limit(0), "k", "j").count() == 0


def test_xml_documents_are_parsed_some_at_a_time(spark, monkeypatch):
    from tablewright.plans import xmlops as X
    import pyarrow as pa
    seen, parsed = [], X._parsed
    monkeypatch.setattr(X, "_parsed", lambda b, *args: seen.append(b.num_rows) or parsed(b, *args))
    df = spark.createDataFrame([(1, "<a/>")], "id int, x string")
    found = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: found.update(run=run))
    X.with_nodes(df, "x")
    out = list(found["run"]([pa.RecordBatch.from_pydict({"id": pa.array(range(1000), pa.int32()), "x": ["<a><b/></a>"] * 1000})]))
    assert sum(b.num_rows for b in out) == 1000 and all(len(n) == 2 for b in out for n in b.column("nodes").to_pylist())
    assert max(seen) <= X._DOCUMENTS < 1000


def test_stats_come_from_one_scan(spark, tmp_path):
    from tablewright.operators import aggregates as A
    spark.createDataFrame([("x", 1, 5.0), ("y", 2, 7.0), (None, 2, 1.0), ("y", 1, None)], "g string, k int, v double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = A.stats_of(df, {"rows": F.count(F.lit(1)), "sum": F.sum("v")}, {"most": (F.col("k"), F.count(F.lit(1))), "top": (F.col("g"), F.sum("v"))})
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert rows(got, "metric", "item", "value") == [("most", "1", 2.0), ("rows", "", 4.0), ("sum", "", 13.0), ("top", "y", 7.0)]


def test_ordered_fingerprint_is_refused_for_large_tables(spark, monkeypatch):
    df = spark.range(20).withColumn("v", F.lit("x"))
    small = FP.fingerprint(df, "t", ordered=True).first()
    assert small.ordered_md5 == FP.fingerprint(df.orderBy(F.desc("id")), "t", ordered=True).first().ordered_md5
    assert FP.fingerprint(df.limit(0), "t", ordered=True).first().ordered_md5 == hashlib.md5(b"").hexdigest()
    monkeypatch.setattr(FP, "ORDERED_ROWS", 19)
    with pytest.raises(Exception, match="at most 19 rows"):
        FP.fingerprint(df, "t", ordered=True).collect()
    assert FP.expected_rows(spark.createDataFrame([("o'x", 3, "1:2")], "table_name string, row_count long, hash_sum string")).first().line == "('o''x', '1:2', 3),"
