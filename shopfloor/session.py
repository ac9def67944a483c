"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package relies on. Time zone: order dates and
# event times are compared as UTC. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Bucketed tables here hold one sorted file per bucket, so a bucketed scan
    # may report its sort order and a sort-merge join on the bucket key needs
    # neither an exchange nor a sort. (Spark reports it only for one file per
    # bucket, so the setting cannot claim an order that does not exist.)
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # A build is a chain of writes, each of which starts from files: shuffle files of one that is done
    # would stay on the executors' disks until the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(master: str = "local[8]", app_name: str = "shopfloor",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the SQL settings above on a session built elsewhere (e.g. by the driver)."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings that hold inside the block."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; it is read from the
    session. Only when nothing is set and the master is local (tests) a fresh
    temporary folder is made and registered as the checkpoint dir.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="shopfloor-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")
