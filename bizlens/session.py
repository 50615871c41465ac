"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every bizlens session wants. On a cluster these come from the job
# configuration; ``get_session`` applies them only when building a new session.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files of intermediates once they are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for ~100 TB inputs on a large cluster. Shuffle partitions are set
# high and AQE coalesces them down to the advisory size at runtime, so small
# intermediate results do not end up as thousands of tiny tasks; scan splits
# of 256 MB keep the task count of a 100 TB scan near 400k; skewed shuffle
# partitions (5x the median and over 512 MB) are split by AQE.
SCALE_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def apply_scale_conf(spark: SparkSession) -> None:
    """Apply ``SCALE_CONF`` to a running session (runtime SQL settings only)."""
    for key, value in SCALE_CONF.items():
        spark.conf.set(key, value)


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "bizlens") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("BIZLENS_DRIVER_MEMORY", "16g"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``bizlens`` importable in the Python workers (pandas UDFs reference
    its functions): zip the package once per application and ``addPyFile`` it,
    Spark's standard way of distributing Python code to executors."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if "bizlens" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(app)  # already distributed with the job (--py-files)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="bizlens-pkg-")
    archive = os.path.join(out_dir, "bizlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def prepare_session(spark: SparkSession) -> None:
    """Everything a session needs before bizlens queries run on it."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, registering it with the context.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value is
    always used. Only a local-mode session without the setting (tests, the
    bench) gets a fresh private folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="bizlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
