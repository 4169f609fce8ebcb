"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "visiontables", **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. A temporary
    folder is used only in local mode, where driver and executors are one
    process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="visiontables-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than its own running tasks,
    and several readers share one computation, each reading only its columns.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again.

    The driver's heap is collected too: only then does Spark delete the shuffle
    files of the plans that made them.
    """
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._step)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if steps:
        steps[0].sparkSession._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys`` over the session's full number of shuffle tasks.

    For steps that cost far more time than their rows have bytes: left to
    itself, adaptive execution would merge them into few tasks by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
