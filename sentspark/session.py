"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "sentspark", cpus: int | str = "*", **conf) -> SparkSession:
    """Local session for tests and the benchmark. On a cluster, bring your own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def even_out(scan: DataFrame) -> DataFrame:
    """A plain file scan, repartitioned only if it has fewer partitions than there
    are cores, as with one small file. Large inputs are left as they are. Meant for
    scans that feed work heavy on CPU, such as splitting text."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local-mode session may fall back to a temporary folder: there the
    driver and all tasks share one disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="sentspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_cleaned: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's own part of the shared folder, which is
    removed when the application ends. Loops and operators remove what nobody reads any
    more themselves (``sentspark.scratch``)."""
    own = f"{shared_dir(spark)}/sentspark/{spark.sparkContext.applicationId}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_leave_nothing, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_there(spark: SparkSession, folder: str) -> bool:
    files, path = _file_system(spark, folder)
    return files.exists(path)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether ``folder`` has the marker of a finished write."""
    return is_there(spark, f"{folder.rstrip('/')}/_SUCCESS")


def list_folders(spark: SparkSession, folder: str) -> list[str]:
    """The folders in ``folder``, in order of their names; none if it isn't there."""
    files, path = _file_system(spark, folder)
    if not files.exists(path):
        return []
    return sorted(status.getPath().toString() for status in files.listStatus(path) if status.isDirectory())


def remove_path(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def _leave_nothing(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:      # a stopped session can't reach its files
        remove_path(spark, folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives executor loss, and keeps column pruning for the
    passes that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small per-iteration state."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
