"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import io
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator assumes.

    Partition counts, memory and the checkpoint folder are left to the cluster;
    AQE coalesces small shuffles and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Do not record a Python call site for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session.

    Needed where executors have not got it installed, and where the driver does
    not run in the repository's folder.
    """
    package = Path(__file__).resolve().parent.parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            # One fixed time, so that equal packages are equal files.
            entry = zipfile.ZipInfo(str(path.relative_to(package.parent)))
            archive.writestr(entry, path.read_bytes())
    name = f"{package.name}-{uuid.uuid5(uuid.NAMESPACE_OID, content.getvalue().hex()).hex}.zip"
    target = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / name
    target.write_bytes(content.getvalue())
    spark.sparkContext.addPyFile(str(target))
    return spark


def by_value(*modules: str) -> None:
    """Have the classes of these modules sent as they are, for processes of the driver
    that get no packages (streaming sources and stateful processors)."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; a cluster needs storage
    that outlives any executor, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage at a point where a recomputation would be wrong (sampled
    range bounds) or expensive (the metric pass over a corpus), and gives the
    optimizer true sizes. Survives the loss of executors.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
