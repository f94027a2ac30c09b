"""Session helpers shared by all operators: shared folder, lineage cuts, partition counts."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    Read from ``spark.checkpoint.dir``. Only where that is unset and the
    session runs in one JVM (tests) a temporary folder is made; on a cluster
    without the setting this raises instead of writing to one machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or getattr(sc, "_spindrel_dir", None)
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spindrel-")
        sc._spindrel_dir = path
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by now
        pass


def cut(df: DataFrame, name: str = "t", after: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the written table, so a lost executor costs a re-read
    and not a recomputation. The table is removed when the process ends, or
    once a table written with it as ``after`` takes its place.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrel-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    atexit.register(_remove, spark, path)
    if after is not None and getattr(after, "_spindrel_path", None):
        _remove(spark, after._spindrel_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindrel_path = path
    return out


def partitions(spark: SparkSession, rows: int = 0, per_task: int = 200_000) -> int:
    """Number of shuffle partitions: the session's, or more where ``rows`` asks for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
