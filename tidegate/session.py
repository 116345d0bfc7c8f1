"""Lets Python workers import this package when the driver found it on its own path only."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the workers' path. On a cluster whose machines don't have that
    folder, submit the package with --py-files; the extra entry then does no harm."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def workspace(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir or, in local mode
    without one, a temporary folder, which goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return f"{found.rstrip('/')}/tidegate-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tidegate-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made
