"""A local session with the settings that the library expects of a cluster."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import SparkSession

from quern.staging import local_folder

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A session on this machine; on a cluster use the cluster's own and ``SETTINGS``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | settings
    return builder.config(map=conf).getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, however the session was started.

    Workers on this machine, and those that see the same path, are pointed to it. On other
    clusters the package is sent once per application, unless PYTHONPATH already has it.
    """
    root, context = str(Path(__file__).resolve().parent.parent), spark.sparkContext
    known = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in known:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    if not context.master.startswith("local") and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        context.addPyFile(shutil.make_archive(f"{local_folder()}/quern", "zip", root, "quern"))
