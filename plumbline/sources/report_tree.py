"""One tree report of a whole project, written and read in parts.

Writing sorts the opening and closing tags of all nodes over range partitions; the
part files, in the order of their names, are one document.

Reading needs no part to be whole. The text is cut into chunks behind tags; a chunk
tells which elements it closes that began before it and which it leaves open. These
two lists of neighbouring chunks combine into those of both, so a scan over the
chunks, in two levels, yields the elements that are open where each chunk begins, and
then every chunk is walked by itself. What several chunks tell of one node is put
together by the node's place in the document.

A ``>`` inside an attribute must be written ``&gt;``, as this writer does; comments and
CDATA are not read. Anything else that is no tree report gives one error row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.naming import base_of
from plumbline.plans.session import materialize
from plumbline.schema import COUNTERS, METRICS, NODE_TYPES
from plumbline.sources.reports import STATISTICS, _attribute, _number, _opened, shaped_nodes

#: Characters of a chunk, about.
CHUNK = 1 << 20

TAG = re.compile(r"""<(/?)([A-Za-z_][\w:.-]*)((?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*(/?)>""")
ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
PROLOG = re.compile(r"\A\s*<\?xml[^>]*\?>")

_ELEMENT = "array<struct<tag: string, kind: string, name: string, node: string>>"
CHUNKS = f"file string, block long, chunk int, text string, closes array<string>, opens {_ELEMENT}, error string"
FOUND = (
    "node string, names array<string>, node_type string, "
    + ", ".join(f"{n} string" for n in (*METRICS, *STATISTICS))
    + ", blocks int, error string"
)
PLACE = ("file", "block", "chunk")


# Writing


def report_tags(nodes: DataFrame) -> DataFrame:
    """``place, line``: the tags of all nodes, in document order by ``place``.

    A node's opening tag sorts before everything below it and its closing tag behind;
    the tags of the document enclose all. Names must not hold control characters.
    """
    below = F.replace("node_path", F.lit("/"), F.lit("\x01")).cast("binary")
    values = [F.concat(F.lit(f"<{m}>"), _number(m), F.lit(f"</{m}>")) for m in METRICS]
    item = F.concat(F.lit('<entry item="'), _attribute(base_of("node_path")), F.lit('">'), *values, F.lit("</entry>"))
    is_item = F.col("node_type") == "item"
    both = F.array(
        F.struct(below.alias("place"), F.when(is_item, item).otherwise(_opened(nodes)).alias("line")),
        F.struct(F.concat(below, F.lit(b"\x01\xff")).alias("place"), F.when(~is_item, F.lit("</entry>")).alias("line")),
    )
    tags = nodes.select(F.inline(both)).where("line IS NOT NULL")
    ends = [(bytearray(b""), "<root>"), (bytearray(b"\xff"), "</root>")]
    return tags.unionByName(nodes.sparkSession.createDataFrame(ends, "place binary, line string"))


def write_report_tree(nodes: DataFrame, path: str) -> None:
    """Writes all nodes as one nested document; its parts follow by file name."""
    tags = report_tags(nodes)
    tags.repartitionByRange("place").sortWithinPartitions("place").select("line").write.text(path)


# Reading


def _attributes(text: str) -> tuple[str, str]:
    """Node type and name of an entry; empty if it has none."""
    given = {m[1]: unescape(m[2] if m[2] is not None else m[3]) for m in ATTRIBUTE.finditer(text)}
    return next(((t, given[t]) for t in NODE_TYPES if t in given), ("", ""))


class Malformed(ValueError):
    pass


def _tags(text: str) -> Iterator[tuple[re.Match, str]]:
    """Every tag with the text before it."""
    end = 0
    prolog = PROLOG.match(text)
    if prolog:
        end = prolog.end()
    for match in TAG.finditer(text, end):
        before = text[end : match.start()]
        if "<" in before:
            raise Malformed(f"not a tag: {before[before.index('<'):][:60]!r}")
        yield match, before
        end = match.end()
    if "<" in text[end:]:
        raise Malformed(f"not a tag: {text[text.index('<', end):][:60]!r}")


def summary(text: str, place: str) -> tuple[list[str], list[tuple]]:
    """Tags that a chunk closes without opening them, and elements that it leaves open."""
    closes: list[str] = []
    opens: list[tuple] = []
    for number, (match, _) in enumerate(_tags(text)):
        closing, tag, attributes, empty = match.groups()
        if closing:
            if not opens:
                closes.append(tag)
            elif opens.pop()[0] != tag:
                raise Malformed(f"</{tag}> closes another element")
        elif not empty:
            kind, name = _attributes(attributes) if tag == "entry" else ("", "")
            opens.append((tag, kind, name, f"{place}:{number}"))
    return closes, opens


def combined(stack: list[tuple], closes: list[str], opens: list[tuple]) -> list[tuple]:
    """The open elements behind a chunk, by those before it."""
    if len(closes) > len(stack):
        raise Malformed(f"</{closes[len(stack)]}> closes nothing")
    for tag, element in zip(closes, reversed(stack)):
        if element[0] != tag:
            raise Malformed(f"</{tag}> closes another element")
    return stack[: len(stack) - len(closes)] + opens


def both(first: tuple[list, list], second: tuple[list, list]) -> tuple[list, list]:
    """The summary of two neighbouring chunks; associative."""
    (closes, opens), (more, rest) = first, second
    if len(more) <= len(opens):
        return closes, combined(opens, more, rest)
    combined(opens, more[: len(opens)], [])
    return closes + more[len(opens) :], rest


def _names(stack: list[tuple]) -> list[str] | None:
    """Names of the entries of a stack if all but the root are entries."""
    if any(e[0] != "entry" for e in stack[1:]) or not stack:
        return None
    return [e[2] for e in stack[1:]]


def walk(text: str, stack: list[tuple], place: str, first: bool) -> list[dict]:
    """What a chunk tells of nodes: one row for each node it opens or adds to. Only
    the ``first`` chunk may open the root element."""
    found: dict[str, dict] = {}

    def of(node: str) -> dict:
        return found.setdefault(node, {"node": node, "blocks": 0})

    stack = list(stack)
    for number, (match, before) in enumerate(_tags(text)):
        closing, tag, attributes, empty = match.groups()
        if not closing:
            if not stack and (number or not first):
                raise Malformed("more than one root element")
            kind, name = _attributes(attributes) if tag == "entry" else ("", "")
            element = (tag, kind, name, f"{place}:{number}")
            above = _names(stack)
            if tag == "entry" and above is not None:
                if not kind:
                    raise Malformed(f"entry without a type below {'/'.join(above)!r}")
                of(element[3]).update(names=[*above, name], node_type=kind)
            stack.append(element)
        if closing or empty:
            if not stack or stack[-1][0] != tag:
                raise Malformed(f"</{tag}> closes another element")
            stack.pop()
            if _names(stack) and tag != "entry":
                if tag == "statistic":
                    of(stack[-1][3])["blocks"] += 1
                elif tag in METRICS:
                    of(stack[-1][3])[tag] = unescape(before).strip() if closing else ""
            elif tag in STATISTICS and len(stack) > 2 and stack[-1][0] == "statistic" and _names(stack[:-1]):
                of(stack[-2][3])[tag] = unescape(before).strip() if closing else ""
    return list(found.values())


def _chunked(limit: int):
    """Pieces of text that end in ``>``, put together to chunks of neighbours."""
    schema = _arrow(CHUNKS)

    def chunk(at: tuple[str, int], number: int, text: str) -> pa.RecordBatch:
        row = {"file": at[0], "block": at[1], "chunk": number, "text": text}
        try:
            closes, opens = summary(text, f"{at[0]}:{at[1]}:{number}")
            row |= {"closes": closes, "opens": _told(opens)}
        except Malformed as problem:
            row["error"] = str(problem)
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple, int] = {}
        pieces: list[str] = []
        size, at = 0, None
        for batch in batches:
            for text, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if pieces and ((file, block) != at or size >= limit):
                    yield chunk(at, numbers.get(at, 0), "".join(pieces))
                    numbers[at] = numbers.get(at, 0) + 1
                    pieces, size = [], 0
                at = (file, block)
                pieces.append(text + ">" if "<" in text else text)
                size += len(text) + 1
        if pieces:
            yield chunk(at, numbers.get(at, 0), "".join(pieces))

    return run


def _told(elements: list[tuple]) -> list[dict]:
    return [dict(zip(("tag", "kind", "name", "node"), e)) for e in elements]


def _arrow(spelled: str) -> pa.Schema:
    element = pa.list_(pa.struct([(n, pa.string()) for n in ("tag", "kind", "name", "node")]))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    fields = spelled.replace(_ELEMENT, "element").split(", ")
    return pa.schema([(n, kinds.get(k, element)) for n, k in (f.split() for f in fields)])


def _elements(value: list[dict] | None) -> list[tuple]:
    return [(e["tag"], e["kind"], e["name"], e["node"]) for e in value or []]


def _rows(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["position"], *(r[p] for p in PLACE)))


_SCAN = f"segment int, position long, file string, block long, chunk int, closes array<string>, opens {_ELEMENT}, error string"


def _segment(table: pa.Table) -> pa.Table:
    """One summary for all chunks of a segment."""
    rows = _rows(table)
    whole: tuple[list, list] = ([], [])
    error = next((r["error"] for r in rows if r["error"]), None)
    try:
        for r in rows:
            whole = both(whole, (r["closes"] or [], _elements(r["opens"])))
    except Malformed as problem:
        error = error or str(problem)
    row = dict(rows[0], closes=whole[0], opens=_told(whole[1]), error=error)
    return pa.Table.from_pylist([{n: row[n] for n in _arrow(_SCAN).names}], _arrow(_SCAN))


def _starts(table: pa.Table, seeds: pa.Table | None = None) -> pa.Table:
    """What is open before each row, going on from the seed of the segment."""
    rows, schema = _rows(table), _arrow(_SCAN)
    stack = _elements(seeds.to_pylist()[0]["opens"]) if seeds is not None and seeds.num_rows else []
    out, error = [], None
    for r in rows:
        out.append({n: r[n] for n in schema.names} | {"closes": [], "opens": _told(stack), "error": error})
        try:
            error = r["error"] or error
            stack = combined(stack, r["closes"] or [], _elements(r["opens"])) if not error else stack
        except Malformed as problem:
            error = str(problem)
    if seeds is None:
        # Behind the last row nothing may be open.
        last = {"segment": -1, "position": -1, "file": "", "block": 0, "chunk": 0, "closes": [], "opens": []}
        out.append(last | {"error": error or (f"<{stack[-1][0]}> is not closed" if stack else None)})
    return pa.Table.from_pylist(out, schema)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(FOUND)
    for batch in batches:
        for row in batch.to_pylist():
            place = f"{row['file']}:{row['block']}:{row['chunk']}"
            try:
                found = walk(row["text"], _elements(row["opens"]), place, row["first"])
            except Malformed as problem:
                found = [{"error": str(problem)}]
            yield pa.RecordBatch.from_pylist(found, schema)


def read_report_tree(spark: SparkSession, path: str, doc_id: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """The nodes of one nested document that lies in the files of ``path``, in the order
    of their names; rows as ``flatten_report`` gives them. A document that is no tree
    report gives a single row with ``error`` set."""
    raw = spark.read.option("lineSep", ">").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    chunks = materialize(raw.mapInArrow(_chunked(chunk), CHUNKS), "report-chunks")
    # Part files are numbered; names of other files sort as they are.
    number = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    position = F.coalesce(number, F.lit(-1).cast("long"))
    told = chunks.select("closes", "opens", "error", *PLACE, position.alias("position"))
    # Neighbouring chunks are a segment; sampled bounds change, so it is stored.
    order = ["position", *PLACE]
    placed = materialize(told.repartitionByRange(*order).withColumn("segment", F.spark_partition_id()), "report-scan")
    whole = placed.groupBy("segment").applyInArrow(_segment, _SCAN)
    # One row a segment, of as many as there are partitions.
    seeds = materialize(whole.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(lambda t: _starts(t), _SCAN), "report-seeds")
    starts = placed.groupBy("segment").cogroup(seeds.where("segment >= 0").groupBy("segment")).applyInArrow(
        lambda t, s: _starts(t, s), _SCAN
    )
    starts = materialize(starts.select(*order, "opens", "error"), "report-starts")
    first = starts.select(F.min(F.struct(*order)).alias("f")).select("f.*").withColumn("first", F.lit(True))
    begun = starts.join(first, order, "left").select(*PLACE, "opens", F.coalesce("first", F.lit(False)).alias("first"))
    found = chunks.select(*PLACE, "text").join(begun, [*PLACE]).mapInArrow(_walked, FOUND)
    parts = materialize(found, "report-nodes")
    texts = [*METRICS, *STATISTICS]
    nodes = parts.where("node IS NOT NULL").groupBy("node").agg(
        F.max("names").alias("names"), F.max("node_type").alias("node_type"),
        *[F.max(n).alias(n) for n in texts], F.sum("blocks").alias("blocks"),
    )
    listed = F.flatten(F.array(*[F.split(F.substr(s, F.lit(2), F.length(s) - 2), ",") for s in STATISTICS]))
    is_item = F.col("node_type") == "item"
    counters = F.when(is_item, F.array(*[F.col(m) for m in METRICS])).otherwise(F.transform(listed, lambda v: F.trim(v)))
    shaped = nodes.select(
        "names", "node_type", counters.alias("counters"),
        F.when(~is_item & (F.col("blocks") != 1), F.concat(F.array_join("names", "/"), F.lit(" has "), "blocks", F.lit(" statistic blocks")))
        .when(~is_item & ~F.coalesce(F.size("counters") == len(COUNTERS), F.lit(False)), F.concat(F.array_join("names", "/"), F.lit(" lacks statistics")))
        .alias("error"),
    )
    shaped = materialize(shaped, "report-shaped")
    tops = shaped.agg(F.count_if(F.size("names") == 1).alias("n")).select(
        F.when(F.col("n") != 1, F.concat(F.lit("expected one root entry, found "), F.col("n"))).alias("error")
    )
    errors = (
        shaped.select("error").unionByName(parts.select("error")).unionByName(seeds.select("error"))
        .unionByName(starts.select("error")).unionByName(chunks.select("error")).unionByName(tops)
    )
    failed = materialize(errors.agg(F.min("error").alias("error")), "report-error")
    name = F.lit(path) if doc_id is None else doc_id
    sound = shaped.where(failed.select(F.col("error").isNull()).scalar()).select("names", "node_type", "counters", F.lit(None).cast("string").alias("error"))
    broken = failed.where("error IS NOT NULL").select(
        F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("string").alias("node_type"),
        F.lit(None).cast("array<string>").alias("counters"), "error",
    )
    return shaped_nodes(sound.unionByName(broken).withColumn("doc_id", name))
