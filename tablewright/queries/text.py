"""Text search, XML / HTML shredding and the scalar function surface (C12, C30-C32, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import dates as D
from tablewright.functions import tsql as Q
from tablewright.operators.aggregates import ordered_list
from tablewright.operators.numbering import number_rows
from tablewright.plans import search as SR
from tablewright.plans import xmlops as X
from tablewright.registry import query
from tablewright.sources.tables import Tables

TS = "%Y-%m-%d %H:%M:%S.%f"


def _find_sql(table: str, id_col: str, sought: str, whole_word: bool) -> str:
    L = len(sought)
    ww = ""
    if whole_word:
        ww = (f"AND (h.pos = 1 OR NOT regexp_matches(lower(substring(d.t, h.pos - 1, 1)), '[_@#$a-z0-9]')) "
              f"AND (h.pos + {L} > length(d.t) OR NOT regexp_matches(lower(substring(d.t, h.pos + {L}, 1)), '[_@#$a-z0-9]'))")
    return f"""
WITH d AS (SELECT {id_col} AS id, translate(replace(text, chr(13) || chr(10), '  '), chr(10) || chr(9), '  ') AS t
           FROM {table}),
p AS (SELECT id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i, len(parts) AS n
      FROM (SELECT id, regexp_split_to_array(t, '(?i){sought}') AS parts FROM d)),
h AS (SELECT id, CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 + (i - 1) * {L} + 1 AS BIGINT) AS pos FROM p WHERE i < n)
SELECT h.id AS {id_col},
       substring(d.t, greatest(h.pos - 100, 1), greatest({L} + 200 - (greatest(h.pos - 100, 1) - (h.pos - 100)), 0)) AS Snip,
       CAST(h.pos AS INTEGER) AS Pos, CAST(length(rtrim(d.t)) AS INTEGER) AS Total,
       CAST(round(h.pos * 100.0 / length(rtrim(d.t)), 0) AS INTEGER) AS PCT
FROM h JOIN d ON h.id = d.id
WHERE true {ww}
"""


def _phrase_sql(sought: str) -> str:
    """Positions by repeated search behind the last hit; only user turns, blank runs collapsed."""
    L = len(sought)
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id || '/' || turn AS conv_turn, role,
         regexp_replace(translate(replace(text, chr(13) || chr(10), '  '), chr(10) || chr(9), '  '), ' {{2,}}', ' ', 'g') AS t
  FROM conversations WHERE contains(lower(role), 'user')),
h AS (
  SELECT conv_turn, t, CAST(instr(lower(t), '{sought}') AS BIGINT) AS pos FROM d
  UNION ALL
  SELECT conv_turn, t, CASE WHEN instr(substring(lower(t), pos + {L}), '{sought}') = 0 THEN 0
                            ELSE pos + {L} - 1 + instr(substring(lower(t), pos + {L}), '{sought}') END
  FROM h WHERE pos > 0)
SELECT conv_turn, substring(t, greatest(pos - 30, 1), {L} + 30 + least(pos - 1, 30)) AS Snip, CAST(pos AS INTEGER) AS Pos,
       CAST(length(rtrim(t)) AS INTEGER) AS Total, CAST(round(pos * 100.0 / length(rtrim(t)), 0) AS INTEGER) AS PCT
FROM h WHERE pos > 0
"""


@query("find_occurrences_phrase", sql=_phrase_sql("e s"))
def find_occurrences_phrase(spark, d):
    c = Tables(spark, d).conversations.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("conv_turn"), "role", "text")
    return SR.find_occurrences(c, ["conv_turn"], "text", "e s", whole_word=False, before=30, after=30, collapse=True,
                               name_col="role", name_like="user")


@query("find_occurrences", sql=_find_sql("documents", "doc_id", "the", True))
def find_occurrences(spark, d):
    return SR.find_occurrences(Tables(spark, d).documents, ["doc_id"], "text", "the", whole_word=True)


@query("find_occurrences_substring", sql=_find_sql("conversations", "conv_id, turn", "tion", False).replace(
    "SELECT conv_id, turn AS id", "SELECT conv_id || '/' || turn AS id").replace(
    "SELECT h.id AS conv_id, turn,", "SELECT h.id AS conv_turn,"))
def find_occurrences_substring(spark, d):
    c = Tables(spark, d).conversations.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("conv_turn"), "text")
    return SR.find_occurrences(c, ["conv_turn"], "text", "tion", whole_word=False)


#: Sources of the search over several tables: SQL of the id, and the text column.
SOURCES = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "conversations": ("conv_id || '/' || turn", "text")}


def _source_tables(spark, d):
    t = Tables(spark, d)
    ids = {"documents": F.col("doc_id"), "pages": F.col("page_id"), "conversations": F.concat_ws("/", "conv_id", "turn")}
    return {name: (t.read(name), ids[name], text) for name, (_, text) in SOURCES.items()}


def _sources_sql(terms: list[str], names: list[str], whole_word: bool, before: int, after: int, xml: tuple[int, int] | None = None) -> str:
    """Every text split at every term; a piece's end is where a hit begins."""
    tables = " UNION ALL ".join(f"SELECT '{n}' AS source, CAST({SOURCES[n][0]} AS VARCHAR) AS id, {SOURCES[n][1]} AS text FROM {n}" for n in names)
    word = """AND (pos = 1 OR NOT regexp_matches(lower(substring(t, pos - 1, 1)), '[_@#$a-z0-9]'))
              AND (pos + length(term) > length(t) OR NOT regexp_matches(lower(substring(t, pos + length(term), 1)), '[_@#$a-z0-9]'))""" if whole_word else ""

    def cut(b: int, a: int) -> str:
        return f"substring(t, greatest(pos - {b}, 1), length(term) + {a} + least(pos - 1, {b}))"

    wide = f""", '<x>' || replace(replace(replace(replace({cut(*xml)}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#x0D;') || '</x>' AS xml""" if xml else ""
    return f"""
WITH d AS (SELECT source, id, translate(replace(text, chr(13) || chr(10), '  '), chr(10) || chr(9), '  ') AS t FROM ({tables})),
s AS (SELECT *, regexp_split_to_array(t, '(?i)' || term) AS parts FROM d, (SELECT unnest({terms}) AS term)),
p AS (SELECT source, id, term, t, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM s WHERE len(parts) > 1),
h AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY source, id, term ORDER BY i) + (i - 1) * length(term) + 1 AS BIGINT) AS pos FROM p)
SELECT source, id, term, {cut(before, after)} AS Snip, CAST(pos AS INTEGER) AS Pos, CAST(length(rtrim(t)) AS INTEGER) AS Total,
       CAST(round(pos * 100.0 / length(rtrim(t)), 0) AS INTEGER) AS PCT{wide}
FROM h WHERE i < n {word}
"""


TERMS = ["the", "en la", "tion", "href"]


@query("find_in_sources", sql=_sources_sql(TERMS, list(SOURCES), True, 100, 100))
def find_in_sources(spark, d):
    """Four terms in three tables, each text read once."""
    return SR.search_sources(_source_tables(spark, d), TERMS, whole_word=True)


@query("find_in_sources_xml", sql=_sources_sql(["span", "title"], ["pages", "conversations"], False, 30, 30, (300, 700)))
def find_in_sources_xml(spark, d):
    """Hits with a short snippet and a wide context as XML."""
    t = _source_tables(spark, d)
    return SR.search_sources({n: t[n] for n in ("pages", "conversations")}, ["span", "title"], False, 30, 30, xml=(300, 700))


# ---------------------------------------------------------------- XML events derived from the error events


def deadlock_documents(events):
    """One deadlock event document per error event (errors are what the documents are about), built from the event's fields:
    a process with three frames and one with a single frame, and locks of three kinds, the last of a kind no schema names."""
    e = events.where(F.col("event_type") == "error").select(
        "event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    fs = F.format_string

    def process(suffix, name, mode, shift, frames, buffer):
        attributes = fs(f'<process id="process%d{suffix}" transactionname="{name}" lockMode="{mode}" clientapp="app%d" hostname="host%d" loginname="user%d">',
                        "event_id", (F.col("k") + shift) % 7, (F.col("user_id") + shift) % 10, F.col("user_id") + shift)
        stack = F.concat(*[fs(f'<frame procname="db.dbo.proc_%d" line="%d">{verb} t%d</frame>', F.col("user_id") + up, F.col("k") + up, "k") for verb, up in frames])
        return F.concat(attributes, F.lit("<executionStack>"), stack, fs(f"</executionStack><inputbuf>{buffer} %d</inputbuf></process>", "event_id"))

    xml = F.concat(
        fs('<event name="xml_deadlock_report" timestamp="%s">', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        fs('<data name="database_name"><value>db%d</value></data>', F.col("user_id") % 3),
        F.lit('<data name="xml_report"><value><deadlock>'),
        fs('<victim-list><victimProcess id="process%d"/></victim-list>', "event_id"),
        F.lit("<process-list>"),
        process("", "error", "X", 0, [("update", 0), ("exec &lt;a&gt;", 1), ("call", 2)], "event"),
        process("b", "peer", "S", 1, [("select", 1)], "peer of"),
        F.lit("</process-list><resource-list>"),
        fs('<keylock objectname="db.dbo.index_%d" mode="S"/>', "user_id"),
        fs('<exchangeEvent id="port%d" WaitType="e_waitPipe"><owner id="process%d"/></exchangeEvent>', "k", "event_id"),
        fs('<pagelock objectname="db.dbo.table_%d" mode="X" dbid="%d"/>', "k", F.col("user_id") % 3),
        F.lit("</resource-list></deadlock></value></data></event>"))
    return e.select("event_id", xml.alias("event_xml"))


def _parsed(spark, d):
    return X.parse_events(deadlock_documents(Tables(spark, d).events), "event_xml", "event_id")


#: The error events with their text pieces, for the oracles.
_ERRORS = """WITH e AS (SELECT event_id, ts, user_id AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'),
p AS (SELECT *, '' AS s, 0 AS up, 'error' AS name, 'X' AS mode, 'event ' AS buf FROM e UNION ALL SELECT *, 'b', 1, 'peer', 'S', 'peer of ' FROM e),
f AS (SELECT p.*, n.frame, n.verb, n.more FROM p JOIN (VALUES ('', 1, 'update', 0), ('', 2, 'exec <a>', 1), ('', 3, 'call', 2), ('b', 1, 'select', 1)) n(s2, frame, verb, more)
      ON p.s = n.s2)"""


@query("xml_shred", sql=f"""{_ERRORS}
SELECT event_id, strftime(any_value(ts), '{TS}') AS event_time, CAST(any_value(up) + 1 AS INTEGER) AS ordinal, 'process' || event_id || s AS process_id,
       any_value(name) AS transactionname, any_value(mode) AS lockMode, 'app' || any_value((k + up) % 7) AS clientapp,
       'host' || any_value((u + up) % 10) AS hostname, 'user' || any_value(u + up) AS loginname, CAST(count(*) AS INTEGER) AS n_frames,
       string_agg('db.dbo.proc_' || (u + more) || ':' || (k + more), ' < ' ORDER BY frame) AS stack, any_value(buf) || event_id AS inputbuf
FROM f GROUP BY event_id, s
""")
def xml_shred(spark, d):
    return Q.temporal_as_text(X.shred_processes(_parsed(spark, d), "event_id"))


@query("xml_shred_frames", sql=f"""{_ERRORS}
SELECT event_id, 'process' || event_id || s AS process_id, CAST(frame AS INTEGER) AS frame, 'db.dbo.proc_' || (u + more) AS procname,
       CAST(k + more AS INTEGER) AS line, verb || ' t' || k AS statement
FROM f
""")
def xml_shred_frames(spark, d):
    return X.shred_frames(_parsed(spark, d), "event_id")


@query("xml_shred_victims", sql="""
SELECT event_id, 'process' || CAST(event_id AS VARCHAR) AS victim_process_id FROM events WHERE event_type = 'error'
""")
def xml_shred_victims(spark, d):
    return X.shred_victims(_parsed(spark, d), "event_id")


@query("xml_shred_resources", sql=f"""{_ERRORS}
SELECT event_id, CAST(r.ordinal AS INTEGER) AS ordinal, r.kind AS resource_type, r.objectname, r.mode, r.attributes, r.xml
FROM (SELECT event_id, unnest([
    {{'ordinal': 1, 'kind': 'keylock', 'objectname': 'db.dbo.index_' || u, 'mode': 'S', 'attributes': 'mode=S;objectname=db.dbo.index_' || u,
      'xml': '<keylock objectname="db.dbo.index_' || u || '" mode="S" />'}},
    {{'ordinal': 2, 'kind': 'exchangeEvent', 'objectname': NULL, 'mode': NULL, 'attributes': 'WaitType=e_waitPipe;id=port' || k,
      'xml': '<exchangeEvent id="port' || k || '" WaitType="e_waitPipe"><owner id="process' || event_id || '" /></exchangeEvent>'}},
    {{'ordinal': 3, 'kind': 'pagelock', 'objectname': 'db.dbo.table_' || k, 'mode': 'X', 'attributes': 'dbid=' || u % 3 || ';mode=X;objectname=db.dbo.table_' || k,
      'xml': '<pagelock objectname="db.dbo.table_' || k || '" mode="X" dbid="' || u % 3 || '" />'}}]) AS r FROM e)
""")
def xml_shred_resources(spark, d):
    return X.shred_resources(_parsed(spark, d), "event_id")


@query("xml_summary", sql=f"""{_ERRORS}
SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS Deadlock_Date, 'db' || u % 3 AS DB,
       'keylock' AS Res1_Type, 'index_' || u AS Res1_Name, 'exchangeEvent' AS Res2_Type, CAST(NULL AS VARCHAR) AS Res2_Name,
       'proc_' || u AS Proc1_Name, k AS Proc1_Line, 'update t' || k AS Proc1_SQL,
       'proc_' || (u + 1) AS Proc2_Name, k + 1 AS Proc2_Line, 'exec <a> t' || k AS Proc2_SQL
FROM e
""")
def xml_summary(spark, d):
    return Q.temporal_as_text(X.summary(_parsed(spark, d), "event_id", cut=7))


@query("html_fields", sql="""
SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1) AS lang,
       CAST(len(regexp_extract_all(html, '<a\\s')) AS INTEGER) AS n_links
FROM pages
""")
def html_fields(spark, d):
    p = Tables(spark, d).pages
    return p.select("page_id", *X.html_fields(p, "html"))


@query("xml_functions", sql="""
SELECT n_regionkey AS region, count(*) AS n_lands, CAST(sum(n_nationkey) AS BIGINT) AS sum_codes,
       arg_min(n_name, n_nationkey) AS first_name, 'name' AS first_tag, arg_max(n_name, n_nationkey) AS last_name,
       string_agg('L' || n_nationkey, ' ' ORDER BY n_nationkey) AS ids
FROM nation GROUP BY n_regionkey
""")
def xml_functions(spark, d):
    """One document per region with its nations: element counts, text, attributes, positions, element names."""
    n = Tables(spark, d).nation
    n = n.withColumn("land", F.format_string('<land id="L%d"><name>%s</name><code>%d</code></land>', "n_nationkey", "n_name", "n_nationkey"))
    docs = n.groupBy(F.col("n_regionkey").alias("region")).agg(
        F.concat(F.lit("<area>"), ordered_list("land", ["n_nationkey"], ""), F.lit("</area>")).alias("doc"))
    x = F.col("doc")
    codes = F.xpath(x, F.lit("//code/text()"))
    return docs.select(
        "region", F.xpath_long(x, F.lit("count(/area/land)")).alias("n_lands"),
        F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, v: acc + v.cast("bigint")).alias("sum_codes"),
        X.nth(x, "/area/land/name", 1).alias("first_name"),
        F.xpath_string(x, F.lit("local-name(/area/land[1]/*[1])")).alias("first_tag"),
        F.xpath_string(x, F.lit("/area/land[last()]/name")).alias("last_name"),
        F.array_join(F.xpath(x, F.lit("/area/land/@id")), " ").alias("ids"))


# ---------------------------------------------------------------- §2.9 scalar surface


@query("csv_explode", sql="""
SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS pos, n_name AS item
FROM nation
""")
def csv_explode(spark, d):
    n = Tables(spark, d).nation
    lists = n.groupBy(F.col("n_regionkey").alias("region")).agg(ordered_list("n_name", ["n_nationkey"], ", ").alias("csv"))
    parts = lists.select("region", F.posexplode(F.split("csv", ",")).alias("i", "raw"))
    return parts.select("region", (F.col("i") + 1).cast("int").alias("pos"), F.trim("raw").alias("item"))


@query("char_explode", sql="""
WITH c AS (SELECT n_nationkey AS y, unnest(string_split(n_name, '')) AS ch, generate_subscripts(string_split(n_name, ''), 1) AS x
           FROM nation)
SELECT CAST(x AS INTEGER) AS x, CAST(sum(instr('AEIOU', ch) * CAST(power(3, y) AS BIGINT)) AS BIGINT) AS code
FROM c WHERE ch <> ' ' GROUP BY x
""")
def char_explode(spark, d):
    n = Tables(spark, d).nation
    chars = n.select(F.col("n_nationkey").alias("y"), F.posexplode(F.split("n_name", "")).alias("i", "ch"))
    return (chars.where(F.col("ch") != " ")
            .groupBy((F.col("i") + 1).cast("int").alias("x"))
            .agg(F.sum(F.instr(F.lit("AEIOU"), F.col("ch")) * F.pow(F.lit(3), F.col("y")).cast("bigint")).cast("bigint").alias("code")))


@query("string_functions", sql="""
SELECT p_partkey,
  CAST(instr(p_name, ' ') AS INTEGER) AS first_blank,
  CAST(CASE WHEN regexp_matches(p_name, '[0-9]') THEN length(regexp_extract(p_name, '^[^0-9]*')) + 1 ELSE 0 END AS INTEGER) AS first_digit,
  substring(p_name, 1, 3) AS sub3, left(p_name, 4) AS left4, right(p_name, 4) AS right4,
  CAST(length(rtrim(p_name || '  ')) AS INTEGER) AS len,
  left(p_brand, 1) || 'X' || substring(p_brand, 3) AS stuffed,
  replace(p_type, 'A', 'a') AS replaced, translate(p_brand, '#', '-') AS translated,
  regexp_replace(p_name || '   tail', ' +', ' ', 'g') AS collapsed, reverse(p_brand) AS reversed,
  repeat('*', p_size % 5) AS stars, '[' || replace(p_brand, ']', ']]') || ']' AS quoted,
  string_split(p_type || '.' || p_brand || '.' || CAST(p_size AS VARCHAR), '.')[-3] AS parsename3,
  chr(65 + p_size % 26) AS letter, ascii(p_brand) AS code,
  ['small', 'medium', 'large'][1 + p_size % 3] AS chosen, upper(p_type) AS up, lower(p_type) AS low,
  ltrim('  ' || p_type) AS ltrimmed
FROM part
""")
def string_functions(spark, d):
    p = Tables(spark, d).part
    dotted = F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string"))
    return p.select(
        "p_partkey",
        Q.charindex(" ", "p_name").alias("first_blank"),
        F.regexp_instr("p_name", F.lit("[0-9]")).cast("int").alias("first_digit"),
        Q.tsql_substring("p_name", 1, 3).alias("sub3"), F.left("p_name", F.lit(4)).alias("left4"),
        F.right("p_name", F.lit(4)).alias("right4"), Q.blank_len(F.concat("p_name", F.lit("  "))).alias("len"),
        Q.stuff("p_brand", 2, 1, "X").alias("stuffed"),
        F.replace("p_type", F.lit("A"), F.lit("a")).alias("replaced"), F.translate("p_brand", "#", "-").alias("translated"),
        Q.collapse_blanks(F.concat("p_name", F.lit("   tail"))).alias("collapsed"), F.reverse("p_brand").alias("reversed"),
        F.repeat(F.lit("*"), F.col("p_size") % 5).alias("stars"), Q.quotename("p_brand").alias("quoted"),
        F.split_part(dotted, F.lit("."), F.lit(-3)).alias("parsename3"),
        F.char(F.lit(65) + F.col("p_size") % 26).alias("letter"), F.ascii("p_brand").alias("code"),
        F.elt(F.lit(1) + F.col("p_size") % 3, F.lit("small"), F.lit("medium"), F.lit("large")).alias("chosen"),
        F.upper("p_type").alias("up"), F.lower("p_type").alias("low"),
        F.ltrim(F.concat(F.lit("  "), "p_type")).alias("ltrimmed"))


@query("date_functions", sql="""
SELECT o_orderkey,
  strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS plus30,
  strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS plus_month,
  date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS days_to_2002,
  date_diff('month', o_orderdate, TIMESTAMP '2002-01-01') AS months_to_2002,
  date_diff('year', o_orderdate, TIMESTAMP '2002-01-01') AS years_to_2002,
  dayname(o_orderdate) AS weekday, monthname(o_orderdate) AS month_name,
  strftime(o_orderdate - INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time
FROM orders
""")
def date_functions(spark, d):
    o = Tables(spark, d).orders
    end = F.lit("2002-01-01").cast("timestamp_ntz")
    return o.select(
        "o_orderkey",
        F.date_format(D.dateadd("day", 30, "o_orderdate"), "yyyy-MM-dd").alias("plus30"),
        F.date_format(F.add_months(F.to_date("o_orderdate"), 1), "yyyy-MM-dd").alias("plus_month"),
        D.datediff("day", "o_orderdate", end).alias("days_to_2002"),
        D.datediff("month", "o_orderdate", end).alias("months_to_2002"),
        D.datediff("year", "o_orderdate", end).alias("years_to_2002"),
        D.datename("weekday", "o_orderdate").alias("weekday"), D.datename("month", "o_orderdate").alias("month_name"),
        F.date_format(D.dateadd("hour", -4, "o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("math_functions", sql="""
SELECT l_orderkey, l_linenumber,
  CAST(round(l_extendedprice / 7, 2) AS DOUBLE) AS rounded, abs(l_quantity - 25) AS distance,
  CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS ceil_k, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS floor_k,
  round(log10(l_extendedprice), 6) AS log_price, power(2, l_linenumber) AS pow2,
  l_orderkey % 7 AS mod7, l_orderkey // 7 AS div7, CAST(trunc(l_quantity / 3) AS INTEGER) AS int_third
FROM lineitem
""")
def math_functions(spark, d):
    li = Tables(spark, d).lineitem
    return li.select(
        "l_orderkey", "l_linenumber",
        F.round(F.col("l_extendedprice") / 7, 2).alias("rounded"), F.abs(F.col("l_quantity") - 25).alias("distance"),
        F.ceil(F.col("l_extendedprice") / 1000).cast("bigint").alias("ceil_k"),
        F.floor(F.col("l_extendedprice") / 1000).cast("bigint").alias("floor_k"),
        F.round(F.log10("l_extendedprice"), 6).alias("log_price"), F.pow(F.lit(2), "l_linenumber").alias("pow2"),
        (F.col("l_orderkey") % 7).alias("mod7"), F.expr("l_orderkey div 7").alias("div7"),
        (F.col("l_quantity") / 3).cast("int").alias("int_third"))


@query("format_functions", sql="""
SELECT o_orderkey,
  format('{:,.1f}', o_totalprice) AS amount, printf('%07d', o_orderkey) AS padded,
  strftime(o_orderdate, '%Y-%b-%-d %-I:%M%p') AS shown, printf('( %d of %s )', o_orderkey % 10, o_orderpriority) AS message
FROM orders
""")
def format_functions(spark, d):
    o = Tables(spark, d).orders
    return o.select(
        "o_orderkey",
        F.format_number("o_totalprice", 1).alias("amount"), F.format_string("%07d", "o_orderkey").alias("padded"),
        F.date_format("o_orderdate", "yyyy-MMM-d h:mma").alias("shown"),
        F.format_string("( %d of %s )", F.col("o_orderkey") % 10, "o_orderpriority").alias("message"))


@query("null_functions", sql="""
WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_name FROM customer)
SELECT c_custkey,
  CASE WHEN seg IS NULL THEN 'none' ELSE seg END AS iif_seg, coalesce(seg, 'none') AS isnull_seg,
  c_name || ' (' || seg || ')' AS plus_concat, concat(c_name, ' (' || seg || ')') AS hidden_paren,
  concat_ws(', ', c_name, seg) AS ws_concat, nullif(seg, 'MACHINERY') AS nullif_seg
FROM c
""")
def null_functions(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_name")
    return c.select(
        "c_custkey",
        F.when(F.col("seg").isNull(), "none").otherwise(F.col("seg")).alias("iif_seg"),
        F.coalesce("seg", F.lit("none")).alias("isnull_seg"),
        Q.plus("c_name", F.lit(" ("), "seg", F.lit(")")).alias("plus_concat"),
        Q.concat_nn("c_name", Q.plus(F.lit(" ("), "seg", F.lit(")"))).alias("hidden_paren"),
        F.concat_ws(", ", "c_name", "seg").alias("ws_concat"),
        F.nullif("seg", F.lit("MACHINERY")).alias("nullif_seg"))


@query("digit_reversal", sql="""
SELECT l_orderkey, l_linenumber,
  CAST(reverse(lpad(CAST(l_orderkey AS VARCHAR), 9, '0')) AS BIGINT) AS reversed_digits,
  CAST(CAST('0x0' || reverse(right(lpad(hex(l_orderkey % 65536), 4, '0'), 3)) AS INTEGER) AS INTEGER) AS reversed_hex
FROM lineitem
""")
def digit_reversal(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.reverse(F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).cast("bigint").alias("reversed_digits"),
        F.conv(F.reverse(F.right(F.lpad(F.hex(F.col("l_orderkey") % 65536), 4, "0"), F.lit(3))), 16, 10)
        .cast("int").alias("reversed_hex"))


@query("hash_functions", sql="""
SELECT s_suppkey, md5(concat_ws('|', CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR))) AS row_md5,
       upper(hex(s_name)) AS name_hex, row_number() OVER (ORDER BY md5('7:' || s_suppkey), s_suppkey) AS shuffled_place
FROM supplier
""")
def hash_functions(spark, d):
    """Hashes of rows, and a random order that a seed repeats."""
    s = Tables(spark, d).supplier
    rows = s.select("s_suppkey", F.md5(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))).alias("row_md5"),
                    F.hex("s_name").alias("name_hex"))
    return number_rows(rows, Q.seeded_order(7, "s_suppkey"), "shuffled_place")


@query("json_props", sql="""
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k,
       max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k
FROM events GROUP BY event_type
""")
def json_props(spark, d):
    e = Tables(spark, d).events.select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").cast("bigint").alias("sum_k"), F.max("k").alias("max_k"))


@query("json_schema_round_trip", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate,
       '$.o_orderkey bigint, $.o_custkey bigint, $.o_orderstatus string, $.o_totalprice double, $.o_orderdate timestamp_ntz, $.o_orderpriority string' AS paths
FROM orders
""")
def json_schema_round_trip(spark, d):
    """Rows as JSON text, read back by the schema that their table's columns give; the paths of that schema as text."""
    o = Tables(spark, d).orders
    text = o.select(F.to_json(F.struct("*")).alias("j"))
    back = text.select(F.from_json("j", o.schema).alias("r")).select("r.*")
    paths = ", ".join(f"$.{f.name} {f.dataType.simpleString()}" for f in o.schema.fields)
    return Q.temporal_as_text(back.drop("o_orderpriority").withColumn("paths", F.lit(paths)))


@query("text_position_functions", sql="""
SELECT p_partkey, CASE WHEN instr(substring(p_name, 4), 'e') = 0 THEN 0 ELSE instr(substring(p_name, 4), 'e') + 3 END AS e_from_4,
       substring(p_name, 1, 2) AS from_minus_1_for_4, substring(p_name, 1, 2) AS from_0_for_3
FROM part
""")
def text_position_functions(spark, d):
    """CHARINDEX with a start, and SUBSTRING from before the text, which comes out shorter."""
    p = Tables(spark, d).part
    return p.select("p_partkey", Q.charindex("e", "p_name", 4).cast("bigint").alias("e_from_4"),
                    Q.tsql_substring("p_name", -1, 4).alias("from_minus_1_for_4"), Q.tsql_substring("p_name", 0, 3).alias("from_0_for_3"))
