"""Session settings and the shared folder for tables written between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", app: str = "testfloor") -> SparkSession:
    """A local session with the settings the library is tested with."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def short_methods(spark: SparkSession) -> None:
    """Keep generated code below the size of method that the JVM compiles.

    Rows of dozens of columns make methods of more than 8,000 bytes, which the JVM only interprets; with this setting Spark
    runs the operators of such a stage one by one, in methods that are compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="testfloor-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def location(uri: str):
    """The file system of a path, as tasks open it, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):  # with one slash or three
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_bytes(uri: str, content: bytes) -> None:
    """Write one file below a folder of the session; also called inside tasks."""
    from pyarrow import fs

    known = "://" in uri or uri.startswith("file:")
    target, path = fs.FileSystem.from_uri(uri if known else f"file://{uri}")
    target.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with target.open_output_stream(path, compression=None) as out:
        out.write(content)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins of tables that grow with the input: they shuffle and merge both sides.

    Spark takes a stored table for as large as its compressed files; columns such as the source of a record take next to
    nothing there, and millions of rows would pass through the driver as a broadcast.
    """
    return df.hint("merge")


# Rows that a task sorts, about.
TASK_ROWS = 1 << 20


def sorting_tasks(rows: int, spark: SparkSession) -> int:
    """As many tasks as keep each at TASK_ROWS of ``rows``, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def materialize(df: DataFrame, label: str = "stage", rows_per_file: int = 0, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with data that survives the loss of executors, so that two
    consumers see the same rows even where the plan above is not repeatable.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
