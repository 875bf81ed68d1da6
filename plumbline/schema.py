"""Column names and explicit schemas shared by all operators."""

from pyspark.sql import types as T

METRICS = ["mmcc", "tmcc", "sif", "lif"]

# The twelve counters of one series, in storage order: the means are kept
# under the bare metric name.
COUNTERS = METRICS + [f"{m}_median" for m in METRICS] + [f"{m}_deviation" for m in METRICS]

STAT_COLUMNS = [f"{m}_{s}" for s in ("mean", "median", "deviation") for m in METRICS]

NODE_TYPES = ["package", "file", "item"]

# Snapshot counter of a store that holds nothing yet, and the start
# of a store.
EMPTY_STORE_TS = 1701154261
STORE_START_TS = 1701154260

SOURCES = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("content", T.StringType())]
)

LEAVES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("line", T.LongType()),
    ]
    + [T.StructField(m, T.LongType()) for m in METRICS]
)

NODES = T.StructType(
    [
        T.StructField("node_path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("node_type", T.StringType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in COUNTERS]
)

SERIES = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("ts", T.LongType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in COUNTERS]
)

API_DOCUMENT = T.StructType(
    [
        T.StructField("Method", T.StringType()),
        T.StructField("Query", T.StringType()),
        T.StructField("Params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("Content-Type", T.StringType()),
        T.StructField("Description", T.StringType()),
    ]
)
