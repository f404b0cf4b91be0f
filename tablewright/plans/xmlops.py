"""XML event shredding and HTML field extraction.

``with_nodes`` parses each document once, without a schema, into an array of
its elements in document order: place, parent, path, name, all attributes, own
text.  Everything else is relational on that array: ``children`` explodes the
elements below a path, whatever their names, and positional questions
(``(...)[n]``) read the filtered array.  It is per-row work on the executors, no
shuffle; a document is one row, so its size bounds the work of a task.

A null, empty or malformed document has a null array, so it gives no rows below
any path and a summary of NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: One element; ``nth`` counts siblings of the same name, ``xml`` is the element's own text form where it was asked for.
NODE = ("struct<node:int,parent:int,path:string,name:string,nth:int,attributes:map<string,string>,text:string,xml:string>")
_DEADLOCK = "/event/data/value/deadlock"


def _walk(document: str | None, fragments_below: str | None) -> list[dict] | None:
    """Elements of a document in document order; text is an element's own, without that of its children."""
    import xml.etree.ElementTree as ET
    try:
        root = ET.fromstring(document or "")
    except ET.ParseError:
        return None
    out, todo = [], [(root, -1, "", 1)]
    while todo:
        e, parent, above, nth_ = todo.pop()
        own = "".join([e.text or "", *(c.tail or "" for c in e)])
        fragment = None
        if above and above == fragments_below:
            tail, e.tail = e.tail, None
            fragment, e.tail = ET.tostring(e, encoding="unicode"), tail
        out.append({"node": len(out), "parent": parent, "path": f"{above}/{e.tag}", "name": e.tag, "nth": nth_,
                    "attributes": list(e.attrib.items()), "text": own, "xml": fragment})
        seen, below = {}, []
        for c in e:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            below.append((c, out[-1]["node"], out[-1]["path"], seen[c.tag]))
        todo += reversed(below)
    return out


def with_nodes(df: DataFrame, xml_col: str, name: str = "nodes", fragments_below: str | None = None) -> DataFrame:
    """``df`` with the array of the elements of ``xml_col``; elements right below ``fragments_below`` carry their XML."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{name} array<{NODE}>").fields])
    typed = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _DOCUMENTS):
                yield _parsed(b.slice(at, _DOCUMENTS), xml_col, fragments_below, typed)

    return df.mapInArrow(run, schema)


#: Documents whose elements are Python objects at a time.
_DOCUMENTS = 128


def _parsed(batch, xml_col: str, fragments_below: str | None, typed):
    """The batch with the elements of its documents as last column."""
    import pyarrow as pa
    nodes = pa.array([_walk(x, fragments_below) for x in batch.column(xml_col).to_pylist()], typed.field(len(typed) - 1).type)
    return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, typed)), nodes], schema=typed)


def at_path(nodes: Column, path: str) -> Column:
    """Elements of a path, in document order; a last step ``*`` takes every name."""
    if path.endswith("/*"):
        return F.filter(nodes, lambda n: n["path"] == F.concat(F.lit(path[:-1]), n["name"]))
    return F.filter(nodes, lambda n: n["path"] == path)


def children(df: DataFrame, path: str, keep: list[str], nodes: str = "nodes", name: str = "n") -> DataFrame:
    """``keep`` and a row (``ordinal``, ``name``) for each element of ``path``, numbered per document from 1 in document order."""
    return df.select(*keep, F.posexplode(at_path(F.col(nodes), path)).alias("_tw_at", name)).select(
        *[c for c in keep if c != nodes], *([nodes] if nodes in keep else []), (F.col("_tw_at") + 1).alias("ordinal"), name)


def attribute(n: Column, key: str) -> Column:
    return F.try_element_at(n["attributes"], F.lit(key))


def attributes_text(n: Column) -> Column:
    """All attributes as ``key=value`` text, ordered by key."""
    pairs = F.array_sort(F.map_entries(n["attributes"]))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def parse_events(df: DataFrame, xml_col: str, id_col: str) -> DataFrame:
    """Parse each event document once; keep id, event time, database name and the elements."""
    parsed = with_nodes(df.select(id_col, xml_col), xml_col, fragments_below=f"{_DEADLOCK}/resource-list")
    data = at_path(F.col("nodes"), "/event/data")
    named = F.filter(data, lambda d: attribute(d, "name") == "database_name")
    values = F.filter(at_path(F.col("nodes"), "/event/data/value"), lambda v: v["parent"] == F.try_element_at(named, F.lit(1))["node"])
    return parsed.select(id_col, F.try_to_timestamp(attribute(F.try_element_at(F.col("nodes"), F.lit(1)), "timestamp")).alias("event_time"),
                         F.try_element_at(values, F.lit(1))["text"].alias("database_name"), "nodes")


def _first(nodes: Column, path: str, n: int) -> Column:
    return F.try_element_at(at_path(nodes, path), F.lit(n))


def summary(events: DataFrame, id_col: str, cut: int = 37) -> DataFrame:
    """Flat summary of each parsed event: date, database, the first two locked objects of
    any kind and the first two frames (name, line, statement) in document order, names cut by
    the fixed prefix length ``cut`` (NULL when absent)."""
    frame, lock = f"{_DEADLOCK}/process-list/process/executionStack/frame", f"{_DEADLOCK}/resource-list/*"
    n = F.col("nodes")
    columns = [F.to_date("event_time").alias("Deadlock_Date"), F.col("database_name").alias("DB")]
    for k in (1, 2):
        columns += [_first(n, lock, k)["name"].alias(f"Res{k}_Type"), cut_prefix(attribute(_first(n, lock, k), "objectname"), cut).alias(f"Res{k}_Name")]
    for k in (1, 2):
        columns += [cut_prefix(attribute(_first(n, frame, k), "procname"), cut).alias(f"Proc{k}_Name"),
                    attribute(_first(n, frame, k), "line").cast("int").alias(f"Proc{k}_Line"), _first(n, frame, k)["text"].alias(f"Proc{k}_SQL")]
    return events.select(id_col, *columns)


def shred_victims(events: DataFrame, id_col: str) -> DataFrame:
    """One row per victim process."""
    return children(events, f"{_DEADLOCK}/victim-list/victimProcess", [id_col]).select(id_col, attribute(F.col("n"), "id").alias("victim_process_id"))


#: Attributes of a process that get columns of their own.
PROCESS_ATTRIBUTES = ("transactionname", "lockMode", "clientapp", "hostname", "loginname")


def shred_processes(events: DataFrame, id_col: str) -> DataFrame:
    """One row per process: its attributes, its frames in order as ``name:line`` text, and its input buffer."""
    p = children(events, f"{_DEADLOCK}/process-list/process", [id_col, "event_time", "nodes"], name="p")
    frames = _below_process(F.col("nodes"), F.col("p"), "executionStack/frame")
    stack = F.transform(frames, lambda f: F.concat_ws(":", attribute(f, "procname"), attribute(f, "line")))
    return p.select(id_col, "event_time", "ordinal", attribute(F.col("p"), "id").alias("process_id"),
                    *[attribute(F.col("p"), a).alias(a) for a in PROCESS_ATTRIBUTES],
                    F.size(frames).alias("n_frames"), F.array_join(stack, " < ").alias("stack"),
                    F.try_element_at(_below_process(F.col("nodes"), F.col("p"), "inputbuf"), F.lit(1))["text"].alias("inputbuf"))


def _below_process(nodes: Column, process: Column, path: str) -> Column:
    """Elements of a path below one process: between it and the next element that is not deeper."""
    after = F.filter(at_path(nodes, f"{_DEADLOCK}/process-list/process"), lambda x: x["node"] > process["node"])
    end = F.coalesce(F.try_element_at(after, F.lit(1))["node"], F.lit((1 << 31) - 1))
    return F.filter(at_path(nodes, f"{_DEADLOCK}/process-list/process/{path}"), lambda x: (x["node"] > process["node"]) & (x["node"] < end))


def shred_frames(events: DataFrame, id_col: str) -> DataFrame:
    """One row per stack frame of every process, all of them, in order."""
    p = children(events, f"{_DEADLOCK}/process-list/process", [id_col, "nodes"], name="p")
    f = p.select(id_col, attribute(F.col("p"), "id").alias("process_id"), F.posexplode(_below_process(F.col("nodes"), F.col("p"), "executionStack/frame")).alias("at", "f"))
    return f.select(id_col, "process_id", (F.col("at") + 1).alias("frame"), attribute(F.col("f"), "procname").alias("procname"),
                    attribute(F.col("f"), "line").cast("int").alias("line"), F.col("f.text").alias("statement"))


def shred_resources(events: DataFrame, id_col: str) -> DataFrame:
    """One row per resource of any kind (``resource-list/*``), in document order: element name, all attributes, its XML."""
    r = children(events, f"{_DEADLOCK}/resource-list/*", [id_col])
    n = F.col("n")
    return r.select(id_col, "ordinal", F.col("n.name").alias("resource_type"), attribute(n, "objectname").alias("objectname"),
                    attribute(n, "mode").alias("mode"), attributes_text(n).alias("attributes"), F.col("n.xml").alias("xml"))


def nth(xml: Column, path: str, n: int) -> Column:
    """Value of the n-th node of ``path`` (XPath ``(path)[n]``), '' when absent."""
    return F.xpath_string(xml, F.lit(f"({path})[{n}]"))


def cut_prefix(c: Column, n: int) -> Column:
    """STUFF(s, 1, n, '') — drop the first n characters (NULL stays NULL)."""
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(F.substring(c, n + 1, 1 << 30))


def html_fields(df: DataFrame, html_col: str) -> list[Column]:
    """Title and language of an HTML page."""
    h = F.col(html_col)
    return [F.regexp_extract(h, r"<title>(.*?)</title>", 1).alias("title"),
            F.regexp_extract(h, r'<html[^>]*\blang="([^"]*)"', 1).alias("lang"),
            F.size(F.regexp_extract_all(h, F.lit(r"<a\s"), 0)).alias("n_links")]
