"""Queries over sources, metrics, the tree and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.naming import canonize_name, decanonize_name
from plumbline.operators import metrics, sketches, tree, view
from plumbline.plans import chains
from plumbline.plans.session import materialize, new_folder
from plumbline.schema import COUNTERS, METRICS
from plumbline.sources import report_tree, reports, sinks
from plumbline.sources.files import read_sources, select_sources
from plumbline.workload.inputs import (
    LEAVES_SQL,
    PARTS_SQL,
    customer_leaves,
    part_path,
    part_sources,
    plain,
    stats_sql,
    table,
)

M = ", ".join(METRICS)


def _leaves(spark, d) -> DataFrame:
    return tree.with_leaf_path(customer_leaves(spark, d))


def q_select_sources(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return select_sources(urls, r"https?://.*\.example\.(com|org)/.*", ["*spam-farm*", "*/e?/*"])


def q_watch_list(spark, d):
    return chains.watch_list(table(spark, d, "part").select(part_path().alias("path")))


def q_code_metrics(spark, d):
    return plain(metrics.code_metrics(part_sources(spark, d)))


def q_filter_metric_ranges(spark, d):
    kept = metrics.filter_metric_ranges(customer_leaves(spark, d), mmcc="5,12", tmcc="3,*", sif=",90", lif="100,400")
    return plain(kept.select("path", "item", *METRICS))


def _names(spark, d) -> DataFrame:
    symbol = F.element_at(F.array(*[F.lit(s) for s in "?<>/\\|*a"]), (F.col("p_partkey") % 8 + 1).cast("int"))
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(":"), F.col("p_size").cast("string"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("::"), "p_name", symbol, line).alias("name"))


def q_canonize_name(spark, d):
    return _names(spark, d).select("p_partkey", canonize_name("name").alias("safe"))


def q_decanonize_name(spark, d):
    return _names(spark, d).select("p_partkey", decanonize_name(canonize_name("name")).alias("shown"))


TOKENS = [
    "%question%", "%left-angle-bracket%", "%right-angle-bracket%", "%slash%",
    "%backslash%", "%pipe%", "%asterisk%", "a",
]


def q_explode_ancestors(spark, d):
    rows = tree.explode_ancestors(_leaves(spark, d))
    return plain(rows.select("leaf_path", "node_path", "depth", "node_type"))


def q_rollup_stats(spark, d):
    return plain(tree.rollup_stats(_leaves(spark, d)))


def q_rollup_balances(spark, d):
    leaves = _leaves(spark, d)
    return plain(tree.rollup_stats(leaves, metrics=["c_acctbal"], exact_integers=False))


def q_rollup_lineitems(spark, d):
    """Every line item as a leaf of its ship year, month and day."""
    item = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    leaves = table(spark, d, "lineitem").select(
        F.concat_ws("/", F.date_format("l_shipdate", "yyyy/MM/dd"), item).alias("leaf_path"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_linenumber").cast("long").alias("lines"),
    )
    return plain(tree.rollup_stats(leaves, metrics=["quantity", "lines"]))


def q_leaf_params(spark, d):
    chunks = tree.leaf_params(_leaves(spark, d), chunk_size=200)
    return plain(chunks.select("node_path", F.inline("params")))


def _nodes(spark, d) -> DataFrame:
    leaves = _leaves(spark, d)
    return tree.to_counter_row(leaves, tree.rollup_stats(leaves))


def q_component_counts(spark, d):
    leaves = _leaves(spark, d).select("leaf_path")
    inner = tree.explode_ancestors(leaves).select("node_path", "node_type").distinct()
    items = leaves.select(F.col("leaf_path").alias("node_path"), F.lit("item").alias("node_type"))
    return plain(tree.component_counts(inner.unionByName(items)))


def q_to_counter_row(spark, d):
    return plain(_nodes(spark, d))


def q_project_attrs(spark, d):
    return plain(view.project_attrs(customer_leaves(spark, d).select("path", "item", *METRICS), "mmcc,lif"))


def q_fold_stacks(spark, d):
    return plain(view.fold_stacks(customer_leaves(spark, d), "mmcc,tmcc,sif,lif"))


def q_flame_frames(spark, d):
    folded = view.fold_stacks(customer_leaves(spark, d), "mmcc")
    return plain(view.flame_frames(folded, 1200.0, 16.0, 0.05))


def q_statistic(spark, d):
    leaves, stats, _ = chains.statistic(part_sources(spark, d), chains.Ranges(mmcc="2,", lif="*,14"))
    return plain(stats)


def q_view(spark, d):
    return plain(chains.view(part_sources(spark, d), attrs="mmcc,lif"))


def q_flamegraph(spark, d):
    return plain(chains.flamegraph(part_sources(spark, d), attrs="tmcc"))


def q_flatten_report(spark, d):
    """One report per nation and block of 100 customers: region > nation > customers."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = F.concat(
        F.lit('<entry item="ns::'), "c_name", F.lit(":"), F.col("c_custkey").cast("string"), F.lit('"><mmcc>'),
        (F.col("c_custkey") % 13).cast("string"), F.lit("</mmcc><tmcc>nan</tmcc><sif>1</sif><lif> 2 </lif></entry>"),
    )
    block_no = F.floor(F.col("c_custkey") / 100)
    doc_id = (block_no * 100 + F.col("n_nationkey")).cast("long")
    nested = c.groupBy("r_name", "n_name", doc_id.alias("doc_id")).agg(
        F.array_join(F.collect_list(item), "").alias("items"), F.count(F.lit(1)).cast("string").alias("n")
    )
    block = F.concat(
        F.lit("<statistic><mean>["), "n", F.lit(", 2, 3, nan]</mean><median>[5, 6, 7, 8]</median>"),
        F.lit("<deviation>[0, 0.5, 1, 1.5]</deviation></statistic>"),
    )
    xml = F.concat(
        F.lit('<root><entry package="'), "r_name", F.lit('">'), block, F.lit('<entry file="'), "n_name",
        F.lit('">'), block, "items", F.lit("</entry></entry></root>"),
    )
    flat = reports.flatten_report(nested.select("doc_id", xml.alias("xml")))
    return plain(flat)


def q_write_report(spark, d):
    """Node rows through the XML sink and back."""
    folder = new_folder(spark, "report")
    reports.write_report(reports.report_entries(_nodes(spark, d)), folder)
    schema = (
        "_path string, _package string, _file string, _item string, mmcc double, lif double, "
        "statistic struct<mean string, median string, deviation string>"
    )
    back = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(folder)
    mean = F.split(F.regexp_extract("statistic.mean", r"^\[(.*)\]$", 1), ", ")
    return plain(
        back.select(
            F.col("_path").alias("node_path"),
            F.coalesce("_package", "_file", "_item").alias("name"),
            F.coalesce(F.col("mmcc"), F.get(mean, F.lit(0)).try_cast("double")).alias("mmcc"),
            F.coalesce(F.col("lif"), F.get(mean, F.lit(3)).try_cast("double")).alias("lif"),
        )
    )


def q_write_folded(spark, d):
    """Folded stacks through the text sink and back."""
    folder = new_folder(spark, "folded")
    sinks.write_folded(view.fold_stacks(customer_leaves(spark, d), "mmcc,lif"), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def q_read_sources(spark, d):
    """The sources as files, one folder per type, read whole and measured."""
    folder = new_folder(spark, "sources")
    texts = part_sources(spark, d).withColumn("dir", F.substring_index("path", "/", 1))
    texts.select("dir", "content").write.partitionBy("dir").text(folder)
    leaves = metrics.code_metrics(read_sources(spark, folder, package=""))
    kind = F.regexp_extract("path", "^dir=([^/]*)/", 1)
    name = F.substring_index("item", ":", 1)
    return plain(leaves.select(kind.alias("kind"), name.alias("name"), *METRICS))


def q_report_roundtrip(spark, d):
    """All nodes through tree documents and back; every seventh leaf has unknown
    counters."""
    nodes = _with_unknown(q_to_counter_row(spark, d))
    documents = reports.report_documents(nodes).withColumnRenamed("node_path", "doc_id")
    back = reports.flatten_report(documents)
    return plain(back.select(*nodes.columns).distinct())


def q_rollup_sketches(spark, d):
    """Approximate medians by sketches of files merged up the tree, held against the
    ranks that they have among all leaves of their node."""
    leaves = _leaves(spark, d)
    files = materialize(sketches.file_sketches(leaves), "sketches")
    stats = sketches.sketch_stats(sketches.rollup_sketches(files))
    told = stats.select(
        "node_path", "n_leaves", *[F.struct(*[F.col(f"{m}_{s}").alias(s) for s in ("mean", "median")]).alias(m) for m in METRICS]
    )
    told = told.unpivot(["node_path", "n_leaves"], METRICS, "metric", "v").select("node_path", "n_leaves", "metric", "v.*")
    counts = tree.explode_ancestors(leaves).unpivot(["node_path"], METRICS, "metric", "value").groupBy("node_path", "metric", "value").count()
    ranks = counts.join(told, ["node_path", "metric"]).groupBy("node_path", "metric", "n_leaves", "mean").agg(
        F.sum(F.when(F.col("value") < F.col("median"), F.col("count")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("median"), F.col("count")).otherwise(0)).alias("upto"),
    )
    allowed = sketches.RANK_ERROR * F.col("n_leaves") + 1
    half = F.col("n_leaves") / 2
    near = (F.col("below") <= half + allowed) & (F.col("upto") >= half - allowed)
    return plain(ranks.select("node_path", "metric", "n_leaves", "mean", near.alias("within")))


def q_report_tree(spark, d):
    """All nodes as one nested document, written in parts and read in chunks."""
    folder = new_folder(spark, "report")
    nodes = _with_unknown(q_to_counter_row(spark, d))
    report_tree.write_report_tree(nodes, folder)
    return plain(report_tree.read_report_tree(spark, folder, chunk=1 << 14).select(*nodes.columns))


def _with_unknown(nodes: DataFrame) -> DataFrame:
    odd = (F.col("node_type") == "item") & (F.length("node_path") % 7 == 0)
    return nodes.withColumns({c: F.when(~odd, F.col(c)) for c in ("tmcc", "lif")})


QUERIES = {
    "report_roundtrip": q_report_roundtrip,
    "report_tree": q_report_tree,
    "rollup_sketches": q_rollup_sketches,
    "read_sources": q_read_sources,
    "select_sources": q_select_sources,
    "watch_list": q_watch_list,
    "code_metrics": q_code_metrics,
    "filter_metric_ranges": q_filter_metric_ranges,
    "canonize_name": q_canonize_name,
    "decanonize_name": q_decanonize_name,
    "explode_ancestors": q_explode_ancestors,
    "rollup_stats": q_rollup_stats,
    "rollup_balances": q_rollup_balances,
    "rollup_lineitems": q_rollup_lineitems,
    "leaf_params": q_leaf_params,
    "component_counts": q_component_counts,
    "to_counter_row": q_to_counter_row,
    "project_attrs": q_project_attrs,
    "fold_stacks": q_fold_stacks,
    "flame_frames": q_flame_frames,
    "statistic": q_statistic,
    "view": q_view,
    "flamegraph": q_flamegraph,
    "flatten_report": q_flatten_report,
    "write_report": q_write_report,
    "write_folded": q_write_folded,
}


def _frames_sql(ctes: str, folded: str, min_width: float) -> str:
    return f"""
WITH {ctes}, folded AS ({folded}),
pre AS (SELECT parts[1:i] AS frame, CASE WHEN i = len(parts) THEN value ELSE 0 END AS own, value
        FROM folded, unnest(range(1, len(parts) + 1)) AS u(i)),
agg AS (SELECT frame, CAST(sum(value) AS BIGINT) AS total, CAST(sum(own) AS BIGINT) AS self FROM pre GROUP BY frame),
placed AS (SELECT *, coalesce(sum(self) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS start, 1200.0::DOUBLE / (SELECT sum(value) FROM folded) AS scale FROM agg)
SELECT array_to_string(frame, ';') AS frame, frame[-1] AS name, CAST(len(frame) AS BIGINT) AS depth, total, self,
       round(start * scale, 6) AS x, round(total * scale, 6) AS width, (len(frame) - 1) * 16.0::DOUBLE AS y
FROM placed WHERE total * scale >= {min_width}
"""


def _fold_sql(source: str, attrs: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT replace(path, '/', ';') || ';' || item || ';{a}' AS stack, '{a}' AS attr, "
        f"CAST(sum({a}) AS BIGINT) AS value FROM {source} GROUP BY ALL"
        for a in attrs
    )


def _parts_sql(source: str, attr: str) -> str:
    return (
        f"SELECT list_concat(string_split(path, '/'), [item, '{attr}']) AS parts, sum({attr}) AS value "
        f"FROM {source} GROUP BY ALL"
    )


COUNTER_SQL = f"""
WITH {LEAVES_SQL}, s AS ({stats_sql('up', 'node_path, depth, node_type', METRICS)})
SELECT node_path, CASE depth WHEN 1 THEN '' ELSE regexp_replace(node_path, '/[^/]*$', '') END AS parent_path,
       CAST(depth AS BIGINT) AS depth, node_type,
       {', '.join(f'{m}_mean AS {m}' for m in METRICS)}, {', '.join(COUNTERS[4:])} FROM s
UNION ALL SELECT path || '/' || item, path, 4, 'item',
       {', '.join(f'CAST({m} AS DOUBLE)' for m in METRICS)}, {', '.join(['NULL'] * 8)} FROM leaves
"""

WATCHED_UP = """
watched_up AS (
  SELECT split_part(path, '/', 1) AS node_path, 1 AS depth, 'package' AS node_type, * FROM kept
  UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2, 'package', * FROM kept
  UNION ALL SELECT path, 3, 'file', * FROM kept)
"""

REPORT_SQL = """
WITH c AS (SELECT *, CAST(c_custkey // 100 * 100 + n_nationkey AS BIGINT) AS doc FROM customer
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT r_name, n_name, doc, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY ALL),
inner_nodes AS (
  SELECT doc AS doc_id, r_name AS node_path, '' AS parent_path, 1 AS depth, 'package' AS node_type, n FROM g
  UNION ALL SELECT doc, r_name || '/' || n_name, r_name, 2, 'file', n FROM g)
SELECT doc_id, node_path, parent_path, CAST(depth AS BIGINT) AS depth, node_type, n AS mmcc, 2.0::DOUBLE AS tmcc,
       3.0::DOUBLE AS sif, NULL::DOUBLE AS lif, 5.0::DOUBLE AS mmcc_median, 6.0::DOUBLE AS tmcc_median,
       7.0::DOUBLE AS sif_median, 8.0::DOUBLE AS lif_median, 0.0::DOUBLE AS mmcc_deviation,
       0.5::DOUBLE AS tmcc_deviation, 1.0::DOUBLE AS sif_deviation, 1.5::DOUBLE AS lif_deviation,
       NULL::VARCHAR AS error FROM inner_nodes
UNION ALL
SELECT doc, r_name || '/' || n_name || '/ns%colon%%colon%' || c_name || '+' || c_custkey,
       r_name || '/' || n_name, 3, 'item', CAST(c_custkey % 13 AS DOUBLE), NULL, 1, 2,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c
"""

SQL = {
    "read_sources": f"""
WITH {PARTS_SQL} SELECT split_part(path, '/', 1) AS kind, split_part(item, ':', 1) AS name, {M} FROM measured
""",
    "select_sources": """
SELECT page_id, url AS path FROM pages
WHERE regexp_full_match(url, 'https?://.*[.]example[.](com|org)/.*')
  AND url NOT LIKE '%spam-farm%' AND url NOT LIKE '%/e_/%'
""",
    "watch_list": f"WITH {PARTS_SQL} SELECT path FROM parts WHERE p_size % 11 <> 0 AND p_size % 5 <> 4",
    "code_metrics": f"WITH {PARTS_SQL} SELECT path, item, 3::BIGINT AS line, {M} FROM measured",
    "filter_metric_ranges": f"""
WITH {LEAVES_SQL} SELECT path, item, {M} FROM leaves
WHERE mmcc BETWEEN 5 AND 12 AND tmcc >= 3 AND sif <= 90 AND lif BETWEEN 100 AND 400
""",
    "canonize_name": f"""
SELECT p_partkey, p_brand || '%colon%%colon%' || p_name || list_extract({TOKENS!r}, p_partkey % 8 + 1)
       || CASE WHEN p_size % 2 = 0 THEN '+' || p_size ELSE '' END AS safe FROM part
""",
    "decanonize_name": r"""
SELECT p_partkey, p_brand || '::' || p_name || list_extract(['?', '<', '>', '/', '\', '|', '*', 'a'], p_partkey % 8 + 1)
       || CASE WHEN p_size % 2 = 0 THEN '+' || p_size ELSE '' END AS shown FROM part
""",
    "explode_ancestors": f"""
WITH {LEAVES_SQL} SELECT path || '/' || item AS leaf_path, node_path, CAST(depth AS BIGINT) AS depth, node_type FROM up
""",
    "rollup_stats": f"WITH {LEAVES_SQL} {stats_sql('up', 'node_path, CAST(depth AS BIGINT) AS depth, node_type', METRICS)}",
    "rollup_balances": f"""
WITH {LEAVES_SQL} {stats_sql('up', 'node_path, CAST(depth AS BIGINT) AS depth, node_type', ['c_acctbal'])}
""",
    "rollup_lineitems": f"""
WITH l AS (SELECT strftime(l_shipdate, '%Y') AS y, strftime(l_shipdate, '%m') AS mo, strftime(l_shipdate, '%d') AS dd,
                  CAST(l_quantity AS BIGINT) AS quantity, CAST(l_linenumber AS BIGINT) AS lines FROM lineitem),
u AS (SELECT y AS node_path, 1 AS depth, 'package' AS node_type, * FROM l
      UNION ALL SELECT y || '/' || mo, 2, 'package', * FROM l
      UNION ALL SELECT y || '/' || mo || '/' || dd, 3, 'file', * FROM l)
{stats_sql('u', 'node_path, CAST(depth AS BIGINT) AS depth, node_type', ['quantity', 'lines'])}
""",
    "leaf_params": f"WITH {LEAVES_SQL} SELECT node_path, path || '/' || item AS item, {M} FROM up",
    "component_counts": f"""
WITH {LEAVES_SQL}, n AS (
  SELECT node_path, node_type FROM up GROUP BY ALL
  UNION ALL SELECT path || '/' || item, 'item' FROM leaves),
c AS (SELECT count(*) FILTER (WHERE node_type = 'package') AS package, count(*) FILTER (WHERE node_type = 'file') AS file,
             count(*) FILTER (WHERE node_type = 'item') AS item FROM n)
SELECT *, '{{"error":0,"statistic":{{"package":' || package || ',"file":' || file || ',"item":' || item || '}}}}'
       AS status FROM c
""",
    "to_counter_row": COUNTER_SQL,
    "project_attrs": f"""
WITH {LEAVES_SQL} SELECT path, item, 'mmcc' AS attr, mmcc AS value FROM leaves
UNION ALL SELECT path, item, 'lif', lif FROM leaves
""",
    "fold_stacks": f"WITH {LEAVES_SQL} {_fold_sql('leaves', METRICS)}",
    "flame_frames": _frames_sql(LEAVES_SQL, _parts_sql("leaves", "mmcc"), 0.05),
    "statistic": f"""
WITH {PARTS_SQL}, kept AS (SELECT * FROM watched WHERE mmcc >= 2 AND lif <= 14), {WATCHED_UP}
{stats_sql('watched_up', 'node_path, CAST(depth AS BIGINT) AS depth, node_type', METRICS)}
""",
    "view": f"WITH {PARTS_SQL} {_fold_sql('watched', ['mmcc', 'lif'])}",
    "flamegraph": _frames_sql(PARTS_SQL, _parts_sql("watched", "tmcc"), 0.0),
    "flatten_report": REPORT_SQL,
    "write_report": f"""
SELECT node_path, regexp_extract(node_path, '([^/]*)$', 1) AS name, mmcc, lif FROM ({COUNTER_SQL})
""",
    "report_roundtrip": f"""
SELECT * REPLACE (CASE WHEN node_type = 'item' AND length(node_path) % 7 = 0 THEN NULL ELSE tmcc END AS tmcc,
                  CASE WHEN node_type = 'item' AND length(node_path) % 7 = 0 THEN NULL ELSE lif END AS lif)
FROM ({COUNTER_SQL})
""",
    "write_folded": f"""
WITH {LEAVES_SQL} SELECT stack || ' ' || value AS line FROM ({_fold_sql('leaves', ['mmcc', 'lif'])})
""",
}
SQL["report_tree"] = SQL["report_roundtrip"]
SQL["rollup_sketches"] = f"""
WITH {LEAVES_SQL}, long AS (
  SELECT node_path, unnest({METRICS}) AS metric, unnest([{', '.join(METRICS)}]) AS value FROM up)
SELECT node_path, metric, count(*) AS n_leaves, round(avg(value), 6) AS mean, true AS within FROM long GROUP BY ALL
"""
