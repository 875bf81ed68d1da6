"""Request lines, service catalogs and keep-alive probes as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.patterns import prefix_match
from plumbline.functions.requests import attr_value, effective_args, pair_args, resolve_query


def extract_attr(
    df: DataFrame, attr: str, default: str | None = "", delim: str = "=", line: str = "line", name: str = "attr"
) -> DataFrame:
    """Adds the value of one attribute of the request line."""
    return df.withColumn(name, attr_value(line, attr, default, delim))


def pair_lines(df: DataFrame, line: str = "line", name: str = "paired") -> DataFrame:
    """Adds the ``k v k v`` line as ``k=v k=v``."""
    return df.withColumn(name, pair_args(line))


def resolve_queries(df: DataFrame, query: str = "query", service: str = "service") -> DataFrame:
    """Relative ``+/`` queries made absolute."""
    return df.withColumn(query, resolve_query(query, service))


def effective_params(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``params``: the declared parameters of the request's query, with the
    overrides of its line, and ``reason``: a request whose query is not declared
    stays, with NULL ``params`` and ``undeclared``.

    ``documents`` is the catalog, one row per ``query`` with its declared
    ``params`` map. The join is left to the optimizer: it broadcasts the catalog
    only below its size threshold, and else splits hot queries at run time.
    """
    declared = documents.select("query", F.col("params").alias("__declared"))
    declared = declared.withColumn("__known", F.lit(True))
    joined = requests.join(declared, "query", "left")
    known = F.col("__known").isNotNull()
    params = F.when(known, effective_args("line", F.col("__declared")))
    reason = F.when(~known, "undeclared")
    return joined.withColumn("params", params).withColumn("reason", reason).drop("__declared", "__known")


def latest_request(
    requests: DataFrame, keys: Sequence[str] = ("query", "session"), order: Sequence[str] = ("ts",)
) -> DataFrame:
    """The last request per query and session; earlier results are replaced."""
    keys = list(keys)
    rest = [c for c in requests.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return requests.groupBy(*keys).agg(last.alias("__last")).select(
        *keys, *[F.col("__last")[c].alias(c) for c in rest]
    )


def dependencies(required: DataFrame, service_regex: str = ".*") -> DataFrame:
    """Requirements of the services that match the regex (from the start of the
    name) or equal it, one row per service and requirement."""
    service = F.col("service")
    return required.where(prefix_match(service, service_regex) | (service == service_regex))


def unmet_dependencies(required: DataFrame, available: DataFrame) -> DataFrame:
    """Requirements whose query no available service offers."""
    missing = required.join(available.select("query").distinct(), "query", "left_anti")
    return missing.select(*required.columns, F.lit("query is not available").alias("reason"))


def probe_timeouts(
    probes: DataFrame, responses: DataFrame, timeout_ms: int = 5000, tag: str = "tag", ts: str = "ts"
) -> DataFrame:
    """Probes that got no response with their tag within the timeout.

    Time is cut into slots one timeout wide. A probe is answered if its own slot
    holds a response at or after it, or the next slot one before its deadline;
    so the latest and the earliest response per (tag, slot) decide, and no
    probe is ever paired with more than two summary rows.
    """
    return unanswered_probes(probes, response_slots(responses, timeout_ms, tag, ts), timeout_ms, tag, ts)


def response_slots(responses: DataFrame, timeout_ms: int = 5000, tag: str = "tag", ts: str = "ts") -> DataFrame:
    """Earliest and latest response per tag and slot; batches may be put together
    in any order."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(at / F.lit(timeout_ms * 1000)).cast("long")
    return responses.groupBy(F.col(tag).alias("tag"), slot.alias("slot")).agg(
        F.min(at).alias("first"), F.max(at).alias("last")
    )


def unanswered_probes(
    probes: DataFrame, slots: DataFrame, timeout_ms: int = 5000, tag: str = "tag", ts: str = "ts"
) -> DataFrame:
    """The probes that ``response_slots`` leave without a response in time."""
    width = timeout_ms * 1000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(at / F.lit(width)).cast("long")
    answered = slots.groupBy(F.col("tag").alias("__tag"), F.col("slot").alias("__slot")).agg(
        F.min("first").alias("__first"), F.max("last").alias("__last")
    )
    own = answered.select("__tag", "__slot", "__last")
    following = answered.select("__tag", (F.col("__slot") - 1).alias("__slot"), "__first")
    sent = probes.withColumn("__tag", F.col(tag)).withColumn("__slot", slot).withColumn("__at", at)
    joined = sent.join(own, ["__tag", "__slot"], "left").join(following, ["__tag", "__slot"], "left")
    in_own = F.coalesce(F.col("__last") >= F.col("__at"), F.lit(False))
    in_next = F.coalesce(F.col("__first") <= F.col("__at") + width, F.lit(False))
    return joined.where(~in_own & ~in_next).select(*probes.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """``added``, ``removed`` and ``same`` entries between two catalogs."""
    keys = list(keys or old.columns)
    both = old.select(*keys, F.lit(True).alias("__old"), F.lit(False).alias("__new")).unionByName(
        new.select(*keys, F.lit(False).alias("__old"), F.lit(True).alias("__new"))
    )
    seen = both.groupBy(*keys).agg(F.bool_or("__old").alias("__old"), F.bool_or("__new").alias("__new"))
    status = F.when(~F.col("__old"), "added").when(~F.col("__new"), "removed").otherwise("same")
    return seen.select(*keys, status.alias("status"))


def same_set(diff: DataFrame) -> DataFrame:
    """One row: whether a ``snapshot_diff`` found no change."""
    return diff.agg((F.count_if(F.col("status") != "same") == 0).alias("same_set"))
