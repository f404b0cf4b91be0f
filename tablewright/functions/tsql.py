"""Column helpers that reproduce the SQL dialect rules the recipes rely on.

All of these build JVM-side Column expressions (no Python UDFs).

Decisions (see SURVEY Q1-Q9):
* ``plus`` propagates NULL like ``a + b`` on strings; ``concat_nn`` treats
  NULL as '' like CONCAT; ``concat_ws`` already skips NULLs.
* integer AVG truncates toward zero; float→int casts truncate (Spark agrees).
* ROUND is half away from zero (``F.round``), CHARINDEX is 1-based with 0
  for "not found" (``F.locate``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plus(*parts) -> Column:
    """String ``+``: any NULL part makes the result NULL."""
    return F.concat(*[col(p) if not isinstance(p, (int, float)) else F.lit(p) for p in parts])


def concat_nn(*parts) -> Column:
    """CONCAT: NULL parts count as ''."""
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def int_avg(c) -> Column:
    """AVG over an integer column returns an integer (truncated toward zero)."""
    return F.avg(col(c)).cast("bigint")


def charindex(sought, text, start=1) -> Column:
    """1-based position of ``sought`` in ``text`` from ``start``; 0 when absent."""
    if isinstance(sought, str):
        return F.locate(sought, col(text), start)
    start = F.lit(start) if isinstance(start, int) else start
    return F.call_function("locate", sought, col(text), start)


def quotename(c, q: str = "[") -> Column:
    """Bracket- or quote-delimit a name, doubling the closing delimiter inside it."""
    close = {"[": "]", "(": ")", "<": ">", "{": "}"}.get(q, q)
    return F.concat(F.lit(q), F.replace(col(c), F.lit(close), F.lit(close * 2)), F.lit(close))


def sql_text_literal(c) -> Column:
    """'text' literal with single quotes doubled; NULL → the word NULL."""
    c = col(c).cast("string")
    return F.coalesce(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def stuff(c, start: int, length: int, insert: str) -> Column:
    """STUFF(s, start, length, insert) = overlay."""
    return F.overlay(col(c), F.lit(insert), F.lit(start), F.lit(length))


def tsql_substring(c, start: Column | int, length: Column | int) -> Column:
    """SUBSTRING where a start below 1 shortens the result (the dialect's rule)."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    real_start = F.greatest(start, F.lit(1))
    real_len = F.greatest(length - (real_start - start), F.lit(0))
    return F.substr(col(c), real_start, real_len)


def blank_len(c) -> Column:
    """LEN: character count ignoring trailing blanks."""
    return F.length(F.rtrim(col(c)))


def whitespace_to_blank(c) -> Column:
    """CR, LF and TAB each become one blank (positions are preserved)."""
    return F.translate(col(c), "\r\n\t", "   ")


def collapse_blanks(c) -> Column:
    """Runs of blanks become one blank."""
    return F.regexp_replace(col(c), " {2,}", " ")


def like_escape(text: str) -> str:
    """Escape LIKE wildcards in user text so it matches literally (backslash escape)."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def seeded_order(seed: int, *keys: str) -> list[Column]:
    """A random order that the seed repeats (in place of ordering by a new id a row): by the hash of seed and keys, then the keys."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *[F.col(k) for k in keys]]


def temporal_as_text(df: DataFrame) -> DataFrame:
    """Render date / timestamp columns as ISO text (for engine-neutral result comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
