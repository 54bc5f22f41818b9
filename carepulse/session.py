"""Session helpers: a local session for tests and benches, and the shared folder.

Library code never creates its own session; it takes the caller's. Intermediate
tables go under the cluster's shared ``spark.checkpoint.dir``. Only when that is
unset (tests, a laptop) do we set one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "carepulse") -> SparkSession:
    """A local session configured like the tests expect (UI off, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CAREPULSE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; set a private one only if none is configured."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    root = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
        if not master.startswith("local"):
            # A driver-local folder is not visible to executors and is lost with the
            # driver; on a cluster the shared folder must come from the configuration.
            raise RuntimeError(
                "spark.checkpoint.dir is not set; set it to a folder shared by the cluster "
                "(for example on the distributed file system) before running carepulse jobs"
            )
        root = tempfile.mkdtemp(prefix="carepulse-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(root)
            root = sc.getCheckpointDir() or root
        else:
            spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def app_key(spark: SparkSession) -> str:
    """An id of the running application (for caching per application)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's intermediate tables, under the shared root."""
    return f"{checkpoint_root(spark)}/carepulse/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``run_dir`` that nothing reads any more."""
    root = f"{checkpoint_root(spark)}/carepulse/"
    if not path.startswith(root) or ".." in path:
        raise ValueError(f"not a folder of a run: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
