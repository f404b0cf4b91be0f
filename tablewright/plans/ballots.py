"""Ranked ballots (C18) and instant-runoff tallies.

Ballots are condensed first: every voter's ranking becomes one ordered list,
identical lists are counted once, so the runoff loop works on distinct
rankings (bounded by the orderings of the candidates), not on voters.
Each round is one aggregate whose per-candidate result (bounded by the
number of candidates) drives the loop; the condensed table is checkpointed
to the shared folder between rounds.
"""

from __future__ import annotations

from itertools import count

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.aggregates import ordered_list
from tablewright.operators.numbering import number_rows
from tablewright.session import cut_lineage


def _pct(votes: int, total: int) -> float | None:
    """Whole percent, rounded half away from zero (exact decimal arithmetic)."""
    if not total:
        return None
    return float((Decimal(votes) * 100 / Decimal(total)).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def ballot_profiles(votes: DataFrame, voter: str, candidate: str, rank: str) -> DataFrame:
    """(ranking_id, ranking, candidate, rank, votes) — one row per candidate of each distinct ranking.

    ranking_id numbers the distinct rankings by vote count (desc), then text.
    """
    v = votes.select(voter, rank, F.col(candidate).cast("string").alias("_tw_cand"))
    lists = v.groupBy(voter).agg(ordered_list("_tw_cand", [rank], ",").alias("ranking"))
    counted = lists.groupBy("ranking").agg(F.count(F.lit(1)).alias("votes"))
    numbered = number_rows(counted, [F.col("votes").desc(), F.col("ranking")], "ranking_id")
    return numbered.select("ranking_id", "ranking", F.posexplode(F.split("ranking", ",")).alias("pos", "candidate"), "votes") \
        .select("ranking_id", "ranking", "candidate", (F.col("pos") + 1).cast("int").alias("rank"), "votes")


def instant_runoff(profiles: DataFrame) -> DataFrame:
    """Round-by-round first-choice totals until a candidate holds a majority.

    Each round: first-choice totals and percentages; stop when the leader's
    votes × 2 exceed the total; otherwise drop the candidate with the fewest
    first-choice votes (ties: the smallest candidate id) and move the
    remaining candidates of each ranking up.
    Output: round, candidate, votes, pct (rounded to a whole percent).
    """
    spark = profiles.sparkSession
    cur = profiles.select("ranking_id", "candidate", "rank", "votes")
    total = cur.where(F.col("rank") == 1).agg(F.sum("votes")).first()[0] or 0
    rounds = []
    for rnd in count(1):                              # ends: every round drops one candidate
        firsts = (cur.where(F.col("rank") == 1).groupBy("candidate").agg(F.sum("votes").alias("votes"))
                     .collect())                      # one row per remaining candidate
        if not firsts:
            break
        rows = sorted(((r["candidate"], r["votes"]) for r in firsts), key=lambda t: (-t[1], t[0]))
        rounds += [(rnd, c, v, _pct(v, total)) for c, v in rows]
        top_votes = rows[0][1]
        if top_votes * 2 > total or len(rows) == 1:
            break
        bottom = min(rows, key=lambda t: (t[1], t[0]))[0]
        cur = (cur.where(F.col("candidate") != bottom)
                  .withColumn("rank", F.row_number().over(Window.partitionBy("ranking_id").orderBy("rank")).cast("int")))
        cur = cut_lineage(cur)
    return spark.createDataFrame(rounds, "round int, candidate string, votes bigint, pct double")
