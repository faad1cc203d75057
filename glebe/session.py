"""Session helpers: the shared work folder and a local session for tests and benchmarks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def local_session(app: str = "glebe", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session it gives you."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, reachable by every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may go without: it gets
    a fresh temporary folder, since its executors share the machine.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="glebe-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the work folder; never shared between two runs."""
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path of the work folder that nobody reads any more; a missing one is fine."""
    if not path.startswith(work_dir(spark) + "/"):
        raise ValueError(f"{path} is not below the work folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
