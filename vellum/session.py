"""Session construction and the shared scratch location.

Everything that must survive an executor loss (snapshots, materialised encoder output,
lineage cuts) is written below the folder named by ``spark.checkpoint.dir``. On a cluster
that folder is a shared file system; it is only set here when the session has none (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package relies on. Shuffle partition counts are left to the
# caller / AQE; AQE coalesces small shuffles and splits skewed ones at run time.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Large rows (whole documents, 768-d vectors): keep Arrow batches moderate.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_session(master: str | None = None, app: str = "vellum", **conf: str) -> SparkSession:
    """Build (or fetch) a session with the package defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Only reached in tests / ad-hoc local sessions: nothing was configured.
        configured = tempfile.mkdtemp(prefix="vellum-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path below the shared checkpoint folder (``unique`` appends a fresh suffix)."""
    base = ensure_checkpoint_dir(spark)
    name = "/".join(p.strip("/") for p in parts if p)
    if unique:
        name = f"{name}-{uuid.uuid4().hex[:12]}" if name else uuid.uuid4().hex[:12]
    if base.startswith("file:"):
        base = base[len("file:") :]
    return os.path.join(base, "vellum", name)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vellum`` importable in the Python workers (UDFs and Arrow kernels refer to its
    modules): zip the package once per application and ``addPyFile`` it, which distributes it to
    every executor through Spark itself."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import vellum

    pkg_dir = os.path.dirname(os.path.abspath(vellum.__file__))
    base = shared_path(spark, "pyfiles", unique=True)
    if "://" in base and not base.startswith("file:"):
        base = tempfile.mkdtemp(prefix="vellum-pyfiles-")  # driver-side copy, served by Spark
    os.makedirs(base, exist_ok=True)
    path = os.path.join(base, "vellum.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
