"""Text occurrence search with snippets and positions.

For every text containing the sought string (case-insensitive):

1. normalise whitespace (CR LF → two blanks, LF → blank, TAB → blank) so
   positions and snippets are stable, optionally collapse blank runs;
2. find every non-overlapping hit left to right, keep those passing the
   whole-word test (the characters just before and after the hit are not
   ``[_@#$a-z0-9]``; text edges count as boundaries) and cut a snippet of
   ``before`` / ``after`` characters around each hit;
3. explode the hits into rows with position, total length and percentage.

Step 2 runs in ``mapInPandas`` over Arrow batches of each partition's texts
(batches are capped by ``spark.sql.execution.arrow.maxBytesPerBatch``) and
yields one row per hit, flushed in bounded chunks.  It is the one place where Python pays off: hit positions,
neighbour characters and snippets are character-indexed, and the JVM's
UTF-8 strings locate a character index by scanning from the start, so
per-hit ``substring`` calls cost O(position) — quadratic in long texts —
while Python strings index in O(1).  Everything else (normalisation, lengths,
percentages, escaping) stays in Spark expressions, and the whole operator is
map-side: no shuffle, no join back to the texts.  There is no filter before the
matcher: a case-blind test in the JVM costs more than the search it would save.

``search_sources`` looks for many terms in many tables at once: the tables are
one tagged union, and an Aho-Corasick automaton over all terms reads each text
once, however many terms there are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.tsql import blank_len, collapse_blanks
from tablewright.sources.tables import tagged_union

# Characters that make a neighbour part of the same word.
WORD_CHARS = "[_@#$a-z0-9]"


def _hit_rows(id_cols: list[str], sought: str, whole_word: bool, before: int, after: int, flush: int = 65536):
    """``mapInPandas`` function: batches of (ids…, Total, text) → one row per kept hit.

    Hits are emitted as rows (not as one array per text) and flushed every
    ``flush`` hits, so a text with millions of hits never becomes one huge
    row and a task's memory stays bounded by the batch it is reading.
    """
    pattern = re.compile(re.escape(sought), re.IGNORECASE)
    word = re.compile(WORD_CHARS)
    n = len(sought)

    def run(batches):
        def empty():
            return {**{c: [] for c in id_cols}, "Total": [], "Pos": [], "Snip": []}

        out = empty()
        for pdf in batches:
            ids = [pdf[c].tolist() for c in id_cols]
            for k, (total, t) in enumerate(zip(pdf["Total"].tolist(), pdf["_tw_text"].tolist())):
                if t is None:
                    continue
                for m in pattern.finditer(t):
                    i, j = m.start(), m.end()
                    if whole_word and ((i > 0 and word.match(t[i - 1].lower()))
                                       or (j < len(t) and word.match(t[j].lower()))):
                        continue
                    for c, col in zip(id_cols, ids):
                        out[c].append(col[k])
                    out["Total"].append(total)
                    out["Pos"].append(i + 1)
                    out["Snip"].append(t[max(0, i - before): i + n + after])
                    if len(out["Pos"]) >= flush:
                        yield pd.DataFrame(out)
                        out = empty()
        if out["Pos"]:
            yield pd.DataFrame(out)

    return run


def normalise(c: Column) -> Column:
    """CR LF → two blanks, remaining LF → one blank, TAB → one blank."""
    return F.translate(F.replace(c, F.lit("\r\n"), F.lit("  ")), "\n\t", "  ")


def find_occurrences(df: DataFrame, id_cols: list[str], text: str, sought: str, whole_word: bool = True,
                     before: int = 100, after: int = 100, collapse: bool = False,
                     name_col: str | None = None, name_like: str | None = None) -> DataFrame:
    """One row per hit: ids, snippet, position, total length, percent through."""
    docs = df
    if name_col and name_like:
        docs = docs.where(F.lower(F.col(name_col)).contains(name_like.lower()))
    norm = normalise(F.col(text))
    if collapse:
        norm = collapse_blanks(norm)
    docs = docs.select(*id_cols, norm.alias("_tw_text")).select(*id_cols, blank_len("_tw_text").alias("Total"), "_tw_text")
    id_fields = [f for f in docs.schema.fields if f.name in id_cols]
    schema = T.StructType(id_fields + [T.StructField("Total", T.IntegerType()), T.StructField("Pos", T.IntegerType()),
                                       T.StructField("Snip", T.StringType())])
    hits = docs.mapInPandas(_hit_rows(id_cols, sought, whole_word, before, after), schema)
    return hits.select(*id_cols, "Snip", "Pos", "Total",
                       F.round(F.col("Pos") * 100.0 / F.col("Total"), 0).cast("int").alias("PCT"))


# ---------------------------------------------------------------- many terms, many sources

def _folded(text: str) -> str:
    """Lower case, letter by letter where a letter's lower case is longer, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _term_hits(terms: list[str], whole_word: bool, before: int, after: int, wide: tuple[int, int] | None, flush: int = 8192):
    """``mapInPandas`` function: batches of (source, id, Total, text) → one row per kept hit of any term."""
    word = re.compile(WORD_CHARS)

    def run(batches):
        import ahocorasick
        automaton = ahocorasick.Automaton()
        by_form: dict[str, list[str]] = {}
        for t in dict.fromkeys(terms):
            by_form.setdefault(_folded(t), []).append(t)
        for form in by_form:
            automaton.add_word(form, form)
        automaton.make_automaton()
        out: list[tuple] = []
        names = ["source", "id", "term", "Total", "Pos", "Snip", *(["_tw_wide"] if wide else [])]
        for x in batches:
            for source, id_, total, text in zip(x["source"], x["id"], x["Total"], x["_tw_text"]):
                if text is None:
                    continue
                end: dict[str, int] = {}
                for last, form in automaton.iter(_folded(text)):
                    i, j = last + 1 - len(form), last + 1
                    if i < end.get(form, 0):               # hits of one term do not overlap
                        continue
                    end[form] = j
                    if whole_word and ((i > 0 and word.match(text[i - 1].lower())) or (j < len(text) and word.match(text[j].lower()))):
                        continue
                    for term in by_form[form]:
                        out.append((source, id_, term, total, i + 1, text[max(0, i - before): j + after],
                                    *([text[max(0, i - wide[0]): j + wide[1]]] if wide else [])))
                    if len(out) >= flush:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def as_xml(text: Column, element: str = "x") -> Column:
    """The text as the content of one XML element."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#x0D;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return F.concat(F.lit(f"<{element}>"), text, F.lit(f"</{element}>"))


def search_sources(sources: dict[str, tuple[DataFrame, Column, str]], terms: list[str], whole_word: bool = True, before: int = 100, after: int = 100,
                   xml: tuple[int, int] | None = None) -> DataFrame:
    """C12 over several sources and terms: source, id, term, Snip, Pos, Total, PCT, one row per hit.

    ``sources``: name → (table, id, text column); ids are shown as text.  Terms
    that differ in case only are found in the same places.  ``xml`` = (before,
    after) adds the wider context as an XML element.  Empty terms are refused.
    """
    if not terms or not all(terms):
        raise ValueError("terms must not be empty")
    tagged = tagged_union({name: df.select(id_.cast("string").alias("id"), normalise(F.col(text)).alias("_tw_text")) for name, (df, id_, text) in sources.items()})
    rows = tagged.select("source", "id", blank_len("_tw_text").alias("Total"), "_tw_text")
    schema = "source string, id string, term string, Total int, Pos int, Snip string" + (", _tw_wide string" if xml else "")
    hits = rows.mapInPandas(_term_hits(terms, whole_word, before, after, xml), schema)
    shown = hits.withColumn("PCT", F.round(F.col("Pos") * 100.0 / F.col("Total"), 0).cast("int"))
    if xml:
        shown = shown.withColumn("xml", as_xml(F.col("_tw_wide")))
    return shown.select("source", "id", "term", "Snip", "Pos", "Total", "PCT", *(["xml"] if xml else []))
