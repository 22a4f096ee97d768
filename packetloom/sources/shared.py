"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HELD: dict[str, str] = {}


def _remove(spark: SparkSession, base: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone; its folder is the cluster's to clear
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without that setting has a folder of its own. All paths of a session go with the driver."""
    app = spark.sparkContext.applicationId
    if app not in _HELD:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='packetloom-')}"
        _HELD[app] = f"{base}/packetloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _HELD[app])
    return f"{_HELD[app]}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again: what follows doesn't repeat its work, and lost executors don't either."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gone(df: DataFrame) -> None:
    """Deletes the folder of a table that `kept` gave and nothing reads again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if any(path.startswith(f"{base}/") or path.startswith(f"{base.replace('file://', 'file:')}/") for base in _HELD.values()):
            _remove(df.sparkSession, path)
