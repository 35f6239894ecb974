"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "meterlark", master: str | None = None, shuffle_partitions: int | None = None, rocksdb: bool = False) -> SparkSession:
    """A session in UTC with adaptive execution; RocksDB keeps large streaming state off the heap."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if rocksdb:
        settings["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set if driver and executors are one machine;
    on a cluster that is an error, as files written there would be missing elsewhere.
    """
    for read in (spark.conf.get, spark.sparkContext.getConf().get):
        found = read("spark.checkpoint.dir", None)
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='meterlark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the file system removes it when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/meterlark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    system.deleteOnExit(target)
    return path
