"""Session helpers: where shared files go, and the settings jobs expect."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_roots: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A local session for tests, benchmarks and notebooks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("paramloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Executors on other machines must see the files written there, so a
    machine-local folder is only used for a local master, where the setting may
    be missing; it is removed when the program ends.
    """
    context = spark.sparkContext
    root = (spark.conf.get("spark.checkpoint.dir", None)
            or context.getConf().get("spark.checkpoint.dir", None))
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_roots.get(context.applicationId)
        if root is None:
            root = _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="paramloom-")
            atexit.register(shutil.rmtree, root, True)  # the folder made here, and only that
    return f"{root.rstrip('/')}/paramloom/{name}-{uuid.uuid4().hex}"
