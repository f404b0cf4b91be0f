"""Set-based DML as functional rewrites: ``old, changes → new`` (+ change rows).

Plain Parquet tables have no MERGE; each statement becomes joins on the key,
which Spark runs as sort-merge (or, for a small side under the measured
broadcast threshold, broadcast) equi-joins.  The result is a new DataFrame
that the caller writes as the next table version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _and(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def one_row_each(source: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Rows of ``source`` with ``mark`` true; several rows with one key are an error when they are read.

    The count per key is an aggregate on the join's own keys, so the join that follows needs no further exchange.
    Rows with a NULL key are left out: they match nothing.
    """
    rest = [c for c in source.columns if c not in keys]
    one = source.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_tw_n"), F.first(F.struct(F.lit(0).alias("_tw_0"), *rest)).alias("_tw_v"))
    message = F.lit(f"the source has several rows with one key ({', '.join(keys)})")
    return one.select(*keys, *[F.col(f"_tw_v.{c}").alias(c) for c in rest], F.when(F.col("_tw_n") > 1, F.raise_error(message)).otherwise(F.lit(True)).alias(mark))


def merge(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str] | None = None,
          delete_unmatched: bool = True) -> tuple[DataFrame, DataFrame]:
    """M1/M2: MERGE target USING source ON keys.

    matched → update ``update_cols`` from source; not matched by target →
    insert (target-only columns NULL); not matched by source → delete (or
    keep, when ``delete_unmatched`` is false: M7 upsert).  Several source rows
    with one key (NULL keys match nothing) are an error when the result is read.

    Returns ``(new_table, changes)``; ``changes`` has ``action`` (INSERT /
    UPDATE / DELETE) and ``del_<c>`` / ``ins_<c>`` for every target column —
    the OUTPUT $action, deleted.*, inserted.* rows.
    """
    tcols = target.columns
    update_cols = update_cols or [c for c in source.columns if c not in keys]
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in tcols], F.lit(True).alias("_t"))
    named = [F.col(c).alias(f"s_{c}") for c in source.columns]
    s = one_row_each(source, keys, "_s").select(*named, "_s")
    j = t.join(s, _and([F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys]), "full_outer")
    loose = source.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))             # NULL keys: inserts of their own
    j = j.unionByName(loose.select(*named, F.lit(True).alias("_s")), allowMissingColumns=True)
    matched = F.col("_t").isNotNull() & F.col("_s").isNotNull()
    only_src = F.col("_t").isNull()
    only_tgt = F.col("_s").isNull()
    action = (F.when(matched, "UPDATE").when(only_src, "INSERT")
              .otherwise(F.lit("DELETE") if delete_unmatched else F.lit(None)))

    def new_value(c):
        if c in keys:
            return F.coalesce(F.col(f"t_{c}"), F.col(f"s_{c}"))
        if c in update_cols and c in source.columns:
            return F.when(F.col("_s").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}"))
        if c in source.columns:                      # an insert takes every source column
            return F.when(only_src, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}"))
        return F.col(f"t_{c}")

    j = j.withColumn("action", action)
    keep = ~only_tgt if delete_unmatched else F.lit(True)
    new = j.where(keep).select(*[new_value(c).alias(c) for c in tcols])
    changes = j.where(F.col("action").isNotNull()).select(
        "action",
        *[F.when(~only_src, F.col(f"t_{c}")).alias(f"del_{c}") for c in tcols],
        *[F.when(F.col("action") != "DELETE", new_value(c)).alias(f"ins_{c}") for c in tcols])
    return new, changes


def change_feed(changes: DataFrame, kind: str) -> DataFrame:
    """M3: what a trigger sees — ``insert`` (inserted rows only), ``update`` (old ∥ new),
    ``delete`` (deleted rows only) or ``all`` (every change row, both sides)."""
    ins = [c for c in changes.columns if c.startswith("ins_")]
    dele = [c for c in changes.columns if c.startswith("del_")]
    if kind == "insert":
        return changes.where(F.col("action").isin("INSERT", "UPDATE")).select(*ins)
    if kind == "delete":
        return changes.where(F.col("action").isin("DELETE", "UPDATE")).select(*dele)
    if kind == "update":
        return changes.where(F.col("action") == "UPDATE").select(*dele, *ins)
    return changes


def update_only(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """M4: MERGE … WHEN MATCHED THEN UPDATE only — left join, take the source value when matched."""
    s = one_row_each(source.select(*keys, *cols), keys, "_m").select(*keys, *[F.col(c).alias(f"_src_{c}") for c in cols], "_m")
    j = target.join(s, keys, "left")
    out = [F.when(F.col("_m").isNotNull(), F.col(f"_src_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in target.columns]
    return j.select(*out)


def update_from_join(target: DataFrame, source: DataFrame, on: list[str], assignments: dict[str, Column]) -> DataFrame:
    """M5: UPDATE t SET c = expr(s) FROM t JOIN s — expressions may reference source columns.

    ``source`` must be unique on ``on`` (as the dialect requires for a
    deterministic UPDATE … FROM); several rows with one key are an error when
    the result is read.
    """
    s = one_row_each(source, on, "_m")
    j = target.join(s, on, "left")
    out = [F.when(F.col("_m").isNotNull(), assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c)
           for c in target.columns]
    return j.select(*out)


def delete_from_join(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """M6: DELETE t FROM t JOIN s → the rows of t with no partner in s."""
    return target.join(source, on, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """M7: insert missing keys, update present ones; re-running is idempotent."""
    return merge(target, source, keys, delete_unmatched=False)[0]


def three_way_merge(rows: DataFrame, copies: DataFrame, updated: DataFrame, inserted: DataFrame,
                    entries: DataFrame, unique_cols: list[str], value_cols: list[str],
                    version: str = "version_id") -> DataFrame:
    """M8: versioned child rows merged with a user's entries.

    rows     (version_id, unique…, value…)       — the child table
    copies   (original_version_id, new_version_id) — versions copied this time
    updated  (updated_version_id, current_version_id, entity_id)
    inserted (version_id, guid)                  — versions of brand-new entities
    entries  (entity_id, guid, unique…, value…)  — what the user submitted

    (a) copy the child rows of copied versions to their new version id;
    (b) in each updated version delete rows whose unique key is in the current
        version but absent from the user's entries;
    (c) update the remaining rows of updated versions that match the current
        version and an entry: per column ``IIF(u.c = cur.c, ver.c, u.c)`` — a
        column changes only where the user changed it relative to current;
    (d) insert entries missing from both this version and the current version;
    (e) insert entries of new entities under their new version id.
    All steps are equi-joins on (version, unique key).  ``rows`` is read
    several times: pass a table (or materialise a derived input first).
    """
    cols = [version] + unique_cols + value_cols
    base = rows.select(*cols)
    copied = (base.join(copies, base[version] == copies["original_version_id"])
                  .select(F.col("new_version_id").alias(version), *unique_cols, *value_cols))
    r = base.unionByName(copied)

    uv = updated.select("updated_version_id", "current_version_id", "entity_id")
    cur = base.select(F.col(version).alias("_cur_v"), *[F.col(c).alias(f"cur_{c}") for c in unique_cols + value_cols])
    ent = entries.select(F.col("entity_id").alias("_u_entity"), *[F.col(c).alias(f"u_{c}") for c in unique_cols + value_cols])

    # rows of updated versions, with their version's entity and current version
    tv = r.join(uv, r[version] == uv["updated_version_id"], "left")
    # partner in the current version with the same unique key
    tv = tv.join(cur, _and([F.col("current_version_id") == F.col("_cur_v")] +
                           [F.col(c) == F.col(f"cur_{c}") for c in unique_cols]), "left")
    # the user's entry for the same entity and unique key
    ent_k = ent.withColumn("_has_entry", F.lit(True))
    tv = tv.join(ent_k, _and([F.col("entity_id") == F.col("_u_entity")] +
                             [F.col(c) == F.col(f"u_{c}") for c in unique_cols]), "left")
    in_updated = F.col("updated_version_id").isNotNull()
    has_cur = F.col("_cur_v").isNotNull()
    has_entry = F.col("_has_entry").isNotNull()
    kept = tv.where(~(in_updated & has_cur & ~has_entry))
    upd = in_updated & has_cur & has_entry
    new_vals = [F.when(upd, F.when(F.col(f"u_{c}").eqNullSafe(F.col(f"cur_{c}")), F.col(c)).otherwise(F.col(f"u_{c}")))
                .otherwise(F.col(c)).alias(c) for c in value_cols]
    kept = kept.select(version, *unique_cols, *new_vals)

    # (d) entries missing from both this version and the current version
    this_keys = r.select(F.col(version).alias("_v"), *[F.col(c).alias(f"_k_{c}") for c in unique_cols])
    cur_keys = base.select(F.col(version).alias("_cv"), *[F.col(c).alias(f"_ck_{c}") for c in unique_cols])
    cand = ent.join(uv, F.col("_u_entity") == F.col("entity_id"))
    cand = cand.join(this_keys, _and([F.col("updated_version_id") == F.col("_v")] +
                                     [F.col(f"u_{c}") == F.col(f"_k_{c}") for c in unique_cols]), "left_anti")
    cand = cand.join(cur_keys, _and([F.col("current_version_id") == F.col("_cv")] +
                                    [F.col(f"u_{c}") == F.col(f"_ck_{c}") for c in unique_cols]), "left_anti")
    added = cand.select(F.col("updated_version_id").alias(version),
                        *[F.col(f"u_{c}").alias(c) for c in unique_cols + value_cols])

    # (e) new entities
    fresh = (entries.join(inserted, "guid")
                    .select(F.col("version_id").alias(version), *unique_cols, *value_cols))
    return kept.unionByName(added).unionByName(fresh)
