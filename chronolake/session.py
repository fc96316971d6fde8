"""Session defaults for local work; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all machines share. Where it names none, a
    local session uses a folder of this machine; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="chronolake-")
    return found.rstrip("/")


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session with adaptive execution, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronolake")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
