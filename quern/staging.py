"""Tables written to shared storage in the middle of a job.

``stage`` cuts the lineage of a result that several later steps read, or whose
recomputation after a lost executor would be dear. It writes Parquet into the folder
that the cluster names in ``spark.checkpoint.dir``, or that was given to the context; only
where there is none and Spark runs in this process, as in tests, a folder of this machine is
used. The files of a session are deleted when the driver's process ends, or by ``cleanup``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def local_folder() -> str:
    """A new folder on the driver's machine, for what Spark then sends to the executors itself."""
    return tempfile.mkdtemp(prefix="quern-")


def _base(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    given = context._jsc.sc().getCheckpointDir()
    if base or given.isDefined():
        return base or given.get()
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + local_folder()


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder under ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = (spark, f"{_base(spark).rstrip('/')}/quern-{app}-{uuid.uuid4().hex[:8]}")
        atexit.register(cleanup, app)
    return _FOLDERS[app][1]


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is no such path; any other failure to read it is raised."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(app: str | None = None) -> None:
    """Delete the staged tables of one application, or of all of this process."""
    for key in [app] if app else list(_FOLDERS):
        spark, folder = _FOLDERS.pop(key, (None, None))
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may have ended before this process
            pass
