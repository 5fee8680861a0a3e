"""Session defaults for tests, the bench and notebooks. On a cluster the submitted session is used as is."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pagemill", **extra) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that every executor can reach.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without that setting
    falls back to ``/tmp``; elsewhere a missing setting is an error, since a machine-local
    folder would be invisible to the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = "/tmp/pagemill"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which may start where it isn't installed. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_has_pagemill", False):
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp()) / "pagemill.zip"  # read by the driver only, which serves it to executors
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(packed))
    sc._has_pagemill = True
