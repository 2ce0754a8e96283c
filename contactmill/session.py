"""Session settings shared by tests, bench and the driver entry point."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; `conf` overrides any setting (dots as double underscores)."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return workers_can_import(SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate())


def workers_can_import(spark: SparkSession) -> SparkSession:
    """Put this package on the Python path of workers that are started from now on."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])
    return spark


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path that no other run uses, in the folder that driver and executors share: `spark.checkpoint.dir`, or, where all
    is one process, one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="contactmill-")
    return f"{shared.rstrip('/')}/{kind}-{uuid4().hex}"
