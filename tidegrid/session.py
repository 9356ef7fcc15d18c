"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Left to the cluster: executor counts and memory. Set here: what the operators rely on.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, app: str = "tidegrid", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in {**CONF, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="tidegrid-")
        root = _local_dirs[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage, keeps column pruning.

    The copy outlives a lost executor. Where an operator is done with it, :func:`release` deletes it; a copy
    that a returned frame reads stays until the shared folder is emptied between jobs. The shuffle files of the
    write go with it: nothing reads them again, and they would lie on the executors' disks until the driver
    happens to collect its garbage.
    """
    conf, path = df.sparkSession.conf, work_dir(df.sparkSession, name)
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(staged: DataFrame) -> None:
    """Delete the copy behind a staged frame that nothing reads any more."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame reliably, so that lost executors do not replay its lineage."""
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)
