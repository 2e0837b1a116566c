"""Session construction and the one place where intermediate tables are put."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "spanveil", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under; ``conf`` overrides (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("SPANVEIL_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark alone opens the path, so any Hadoop store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan of fewer parts than there are cores, dealt to all of them; others as they are. For operators that cost far
    more than an exchange of the rows; tables of a cluster's size have parts enough and aren't exchanged."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is set, a local session (tests) gets a temporary one; a cluster
    doesn't, as its machines don't share such a folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spanveil-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; the shared folder is scratch space
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now rather than when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` once as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors.

    The folder goes when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote, once the jobs that read them are done; what is derived from them can't be read any more."""
    for t in tables:
        _remove(t.sparkSession, t.written_to)
