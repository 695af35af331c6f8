"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(app_name: str) -> SparkSession:
    """Return the running session, or start one.

    Sizing (memory, cores, shuffle partitions) belongs to spark-submit or
    spark-defaults, so nothing is hard-coded here.
    """
    return SparkSession.builder.appName(app_name).getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table that every executor can reach.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local master, where driver and executors share one machine, may fall back to
    a temporary folder; a cluster without the setting is refused, because a path
    on one machine would lose the table together with that machine.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a folder shared by all executors"
            )
        base = tempfile.mkdtemp(prefix="lagline-")
    return f"{base.rstrip('/')}/lagline/{name}-{uuid.uuid4().hex}"


def partition_hint(spark: SparkSession) -> int:
    """How many ranges to cut an ordered computation into.

    Follows the shuffle width; results do not depend on the number.
    """
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
