"""SparkSession helpers: scale-oriented defaults and the shared scratch location."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

# Settings that matter at cluster scale. They are applied only where the
# session leaves them unset, so a cluster's own configuration always wins.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def _default_driver_memory() -> str:
    """About 60% of physical memory, at most 8 GB (local mode runs everything
    in the driver JVM)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    mb = max(1024, min(8192, int(total * 0.6 / 2**20)))
    return f"{mb}m"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "fieldreports") -> SparkSession:
    """Session for tests and the bench (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FIELDREPORTS_DRIVER_MEMORY") or _default_driver_memory())
    )
    for k, v in SCALE_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    It is read from the session.  Where it is unset, ``fallback`` is set; a
    session that runs in one process (``local``) gets a fresh temporary folder,
    and any other one is refused, as its executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if fallback is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        import tempfile

        fallback = tempfile.mkdtemp(prefix="fieldreports-ckpt-")
    try:  # a core config may be read-only at runtime; the context setting suffices
        spark.conf.set("spark.checkpoint.dir", fallback)
    except Exception:  # noqa: BLE001
        pass
    sc.setCheckpointDir(fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fieldreports/{name}-{uuid.uuid4().hex[:12]}"
