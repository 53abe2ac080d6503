"""Sessions, and the folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(cpus: int | str = "*", **settings: str) -> SparkSession:
    """A session for one machine, with the settings that the engine is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is named, a folder of this machine if it is the whole cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for what a query writes besides its result; it is deleted when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the checkpoint folder: safe when executors are lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def local_table(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """Rows of the driver as a part of the plan: reading them takes no job."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    described = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(described)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=described), fields)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` held by the driver and marked for broadcast if it has at most so many rows, else as it is."""
    found = df.limit(rows + 1).collect()
    return F.broadcast(local_table(df.sparkSession, found, df.schema)) if len(found) <= rows else df


def hot_parts(spark: SparkSession) -> int:
    """A key with more than one part in so many of all rows would fill a quarter of a usual task by itself."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
