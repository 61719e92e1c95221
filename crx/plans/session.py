"""Session construction and cluster-safe lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; applied only where the session lacks them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "crx") -> SparkSession:
    """Local session for tests and the bench; the UI stays off."""
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """Whether the executors are threads of the driver, which share its disk."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: `spark.checkpoint.dir` of the session.
    Only a local master may do without; it gets a scratch folder. On a cluster a
    missing setting is an error, since executors would write to their own disks."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() or None
    if not current:
        if not _is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="crx-ckpt-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python
    workers can import it wherever the job was started; on a cluster also fill in
    the settings the session leaves unset."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    if not _is_local(spark):
        apply_cluster_settings(spark)
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="crx-package-")) / "crx.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "crx").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write an intermediate table. The shuffle files made for it go as soon as it stands:
    otherwise they stay until the driver happens to collect its garbage, and those of
    all steps of a job lie on disk at once."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before) if before is not None else conf.unset(SHUFFLE_CLEANUP)


PART_ROWS = 250_000


def parts_for(rows: DataFrame, part_rows: int = PART_ROWS) -> int | None:
    """How many parts hold the rows with `part_rows` each, so that a task's share does not
    grow with the input; None if the session deals over as many by itself."""
    parts = -(-rows.count() // part_rows)
    return parts if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Settings for a large cluster (hundreds of executors, tens of TB). Applied by
# `apply_cluster_settings` only where the session has no value of its own.
CLUSTER_SETTINGS = {
    # AQE picks the reducer count from runtime sizes; start high, coalesce down. Sizes are
    # of compressed rows: a part of 8 MB takes some 350 MB once diffs or texts in it are
    # taken apart and sorted, whatever the size of the input
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.shuffle.partitions": "4000",
    # split skewed join partitions (a key holding a large share of rows)
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # scan splits sized for executor memory
    "spark.sql.files.maxPartitionBytes": "32m",
    # broadcast only what Spark measured to be small: compressed too, and the driver holds
    # the rows of all broadcasts of a plan
    "spark.sql.autoBroadcastJoinThreshold": "2m",
    # Arrow batches for the node scan and the scorer (rows per batch)
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_settings(spark: SparkSession) -> None:
    """Fill the cluster defaults above where the session leaves them unset."""
    for k, v in CLUSTER_SETTINGS.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
