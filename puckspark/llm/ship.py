"""Makes this package importable on executors when it is not installed there."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def with_code(spark: SparkSession) -> SparkSession:
    """Sends the package as a zip file, once per application, unless PYTHONPATH or the working folder already has it."""
    app = spark.sparkContext.applicationId
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app not in _sent and not any(p and os.path.realpath(p) == str(ROOT) for p in places):
        made = tempfile.mkdtemp(prefix="puckspark-code-")  # on the driver, which serves it while the application runs
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        shutil.copytree(ROOT / "puckspark", f"{made}/code/puckspark", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{made}/puckspark_code", "zip", f"{made}/code"))
    _sent.add(app)
    return spark
