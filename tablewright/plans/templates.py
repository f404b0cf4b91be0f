"""Template merge (C7): fill ``[column]`` placeholders from each row, then concatenate.

Placeholders are replaced with the row's values, later columns first,
matching names case-insensitively.  The per-row text is a chain of
``regexp_replace`` Column expressions; the concatenation comes in rows of a
bounded number of texts, so neither a group nor the whole is one string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.aggregates import chunked_list


def _replacement_safe(v: Column) -> Column:
    """Escape ``\\`` and ``$`` so a value is inserted literally by regexp_replace."""
    return F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def fill_template(df: DataFrame, template: str, columns: list[str] | None = None) -> Column:
    """The template with every ``[col]`` replaced by the row's value (NULL → '')."""
    columns = columns or df.columns
    text = F.lit(template)
    for c in reversed(columns):
        pattern = "(?i)\\[" + re.escape(c) + "\\]"
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        text = F.regexp_replace(text, F.lit(pattern), _replacement_safe(value))
    return text


def template_merge(df: DataFrame, template: str, order: list[str], sep: str = "",
                   group: list[str] | None = None, chunk: int = 1000) -> DataFrame:
    """The filled templates concatenated with ``sep`` in ``order`` (a total order), per group or all.

    Columns: ``group``, ``chunk`` (from 1) and ``text``; every ``chunk`` texts are a row.
    """
    filled = df.withColumn("_tw_text", fill_template(df, template))
    return chunked_list(filled, group or [], order, "_tw_text", sep, chunk)
