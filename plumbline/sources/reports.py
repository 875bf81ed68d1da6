"""Tree reports: XML documents to node rows, and node rows to XML or JSON."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.naming import base_of, canonize_name, depth_of, parent_of
from plumbline.schema import COUNTERS, METRICS, NODE_TYPES, NODES

STATISTICS = ("mean", "median", "deviation")


def _entries(root: ElementTree.Element) -> Iterator[tuple]:
    """(component names, node type, counters as text) of every entry, parents
    first. Raises ValueError on a malformed report."""
    tops = root.findall("entry")
    if len(tops) != 1:
        raise ValueError(f"expected one root entry, found {len(tops)}")
    stack = [((), tops[0])]
    while stack:
        above, entry = stack.pop()
        node_type = next((t for t in NODE_TYPES if entry.get(t) is not None), None)
        if node_type is None:
            raise ValueError(f"entry without a type below {'/'.join(above)!r}")
        names = (*above, entry.get(node_type))
        if node_type == "item":
            texts = {child.tag: (child.text or "").strip() for child in entry}
            counters = [texts.get(m) for m in METRICS] + [None] * 8
        else:
            blocks = entry.findall("statistic")
            if len(blocks) != 1:
                raise ValueError(f"{'/'.join(names)!r} has {len(blocks)} statistic blocks")
            lists = {e.tag: (e.text or "").strip()[1:-1].split(",") for e in blocks[0]}
            counters = [v.strip() for s in STATISTICS for v in lists.get(s, [])]
            if len(counters) != len(COUNTERS):
                raise ValueError(f"{'/'.join(names)!r} has {len(counters)} statistics")
        yield names, node_type, counters
        stack.extend((names, child) for child in reversed(entry.findall("entry")))


def flatten_report(reports: DataFrame, doc_id: str = "doc_id", xml: str = "xml") -> DataFrame:
    """One row per tree node of each report document.

    A malformed document yields a single row with ``error`` set and no node, so
    it neither stops the others nor leaves half of its nodes behind. Only the
    recursive walk runs in Python; names and numbers are converted by Spark.
    """
    id_type = reports.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("names", T.ArrayType(T.StringType())),
            T.StructField("node_type", T.StringType()),
            T.StructField("counters", T.ArrayType(T.StringType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in batch.itertuples(index=False):
                try:
                    found = [(key, *e, None) for e in _entries(ElementTree.fromstring(text))]
                except (ElementTree.ParseError, ValueError) as problem:
                    found = [(key, None, None, None, str(problem))]
                rows.extend(found)
            yield pd.DataFrame(rows, columns=schema.names)

    return shaped_nodes(reports.select(doc_id, xml).where(F.col(xml).isNotNull()).mapInPandas(walk, schema))


def shaped_nodes(nodes: DataFrame) -> DataFrame:
    """Node rows of ``doc_id, names, node_type, counters`` (texts) and ``error``."""
    node_path = F.array_join(F.transform("names", canonize_name), "/")
    path = F.when(F.col("names").isNotNull(), node_path)

    def number(i: int) -> Column:
        value = F.get(F.col("counters"), F.lit(i)).try_cast("double")
        return F.when(~F.isnan(value), value)

    flat = nodes.select("doc_id", path.alias("node_path"), "node_type", "counters", "error")
    return flat.select(
        "doc_id",
        "node_path",
        parent_of("node_path").alias("parent_path"),
        F.when(F.col("node_path").isNotNull(), depth_of("node_path")).alias("depth"),
        "node_type",
        *[number(i).alias(c) for i, c in enumerate(COUNTERS)],
        "error",
    ).select("doc_id", *NODES.names, "error")


def _number(name: str) -> Column:
    """A counter as the report has it: unknown is ``nan``."""
    return F.coalesce(F.col(name).cast("string"), F.lit("nan"))


def _attribute(text: Column) -> Column:
    for sign, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(safe))
    return text


def _opened(nodes: DataFrame) -> Column:
    """The start of the element of an inner node, with its statistic block."""
    name = _attribute(base_of("node_path"))
    groups = zip(STATISTICS, (COUNTERS[0:4], COUNTERS[4:8], COUNTERS[8:12]))
    lists = [
        F.concat(F.lit(f"<{s}>["), F.array_join(F.array(*[_number(c) for c in columns]), ", "), F.lit(f"]</{s}>"))
        for s, columns in groups
    ]
    return F.concat(
        F.lit("<entry "), "node_type", F.lit('="'), name, F.lit('"><statistic>'), *lists, F.lit("</statistic>")
    )


def report_documents(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``node_path, xml``: one tree report for each file, inside its packages.

    A project is as many documents as it has files, so none grows with it; each
    is a whole report that ``flatten_report`` reads, and packages recur in the
    documents of their files. ``keys`` (a snapshot, say) keep trees apart.
    """
    keys = list(keys)
    leaves = nodes.where("node_type = 'item'")
    values = [F.concat(F.lit(f"<{m}>"), _number(m), F.lit(f"</{m}>")) for m in METRICS]
    item = F.concat(F.lit('<entry item="'), _attribute(base_of("node_path")), F.lit('">'), *values, F.lit("</entry>"))
    items = leaves.select(*keys, F.col("parent_path").alias("node_path"), F.struct("node_path", item.alias("xml")).alias("i"))
    items = items.groupBy(*keys, "node_path").agg(F.array_sort(F.collect_list("i")).alias("items"))
    inner = nodes.where("node_type <> 'item'").select(*keys, F.col("node_path").alias("__above"), _opened(nodes).alias("__open"))
    files = nodes.where("node_type = 'file'").select(*keys, "node_path")
    parts = F.split("node_path", "/")
    levels = F.sequence(F.lit(1), F.size(parts))
    placed = files.withColumn("__level", F.explode(levels))
    placed = placed.withColumn("__above", F.array_join(F.slice(parts, F.lit(1), F.col("__level")), "/"))
    chains = placed.join(inner, [*keys, "__above"]).groupBy(*keys, "node_path")
    chains = chains.agg(F.array_sort(F.collect_list(F.struct("__level", "__open"))).alias("chain"))
    joined = chains.join(items, [*keys, "node_path"], "left")
    xml = F.concat(
        F.lit("<root>"),
        F.array_join(F.transform("chain", lambda c: c["__open"]), ""),
        F.coalesce(F.array_join(F.transform("items", lambda i: i["xml"]), ""), F.lit("")),
        F.repeat(F.lit("</entry>"), F.size("chain")),
        F.lit("</root>"),
    )
    return joined.select(*keys, "node_path", xml.alias("xml"))


def report_entries(nodes: DataFrame, params: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Node rows shaped as flat ``entry`` elements: type attribute, statistic block
    or leaf metrics, and the chunks of ``leaf_params`` as nested ``params``. A node
    of several chunks has its statistics in the first only. For documents that are
    trees, take ``report_documents``."""
    keys = list(keys)
    name = base_of("node_path")
    kinds = [F.when(F.col("node_type") == t, name).alias(f"_{t}") for t in NODE_TYPES]

    def bracketed(columns: list[str]) -> Column:
        return F.concat(F.lit("["), F.array_join(F.array(*[_number(c) for c in columns]), ", "), F.lit("]"))

    groups = zip(STATISTICS, (COUNTERS[0:4], COUNTERS[4:8], COUNTERS[8:12]))
    block = F.struct(*[bracketed(columns).alias(s) for s, columns in groups])
    is_leaf = F.col("node_type") == "item"
    shaped = nodes.select(
        *keys,
        F.col("node_path").alias("_path"),
        *kinds,
        F.when(~is_leaf, block).alias("statistic"),
        *[F.when(is_leaf, F.col(m)).alias(m) for m in METRICS],
    )
    if params is None:
        return shaped
    lists = params.select(*keys, F.col("node_path").alias("_path"), F.col("chunk").alias("_chunk"), "params")
    joined = shaped.join(lists, [*keys, "_path"], "left")
    first = F.coalesce("_chunk", F.lit(0)) == 0
    return joined.withColumns({c: F.when(first, F.col(c)) for c in ("statistic", *METRICS)})


def write_report(entries: DataFrame, path: str, fmt: str = "xml") -> None:
    """Writes entry rows as XML (``<entry>`` elements) or JSON lines."""
    if fmt == "xml":
        entries.write.format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)
    elif fmt == "json":
        entries.write.json(path)
    else:
        raise ValueError("fmt must be 'xml' or 'json'")
