"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows one window task may hold before a group is split.
DEFAULT_GROUP_ROWS = 1_000_000
# Rows a lookup side may hold before it is joined by shuffle instead of broadcast.
DEFAULT_BROADCAST_ROWS = 100_000
# Rows of a wide table that a task should sort at a time.
DEFAULT_TASK_ROWS = 250_000
# Of tables with a row per game or shot that are stored whole: smaller than the default's files, at no more time.
TIGHT = "zstd"

_local_dirs: dict[str, str] = {}
_open_pins: list["Pins"] = []


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "puckspark") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("puckspark.maxGroupRows", str(DEFAULT_GROUP_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("puckspark.maxBroadcastRows", str(DEFAULT_BROADCAST_ROWS)))


def task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("puckspark.maxTaskRows", str(DEFAULT_TASK_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="puckspark-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def pin(df: DataFrame, owned: bool = True, codec: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back, so that a lost executor
    neither recomputes the frame nor sees different contents. With ``owned`` off no
    open scope deletes it; ``codec`` is that of the files (default: the session's)."""
    return pin_counted(df, owned, codec)[0]


class Pins:
    """Owns what ``pin`` writes while it is the innermost open scope, and deletes it when told: after ``with``, or by ``delete``.

    Close it once the results that were made from those tables are written themselves; frames that still read them end with it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Pins":
        _open_pins.append(self)
        return self

    def __exit__(self, *_) -> None:
        self.close()
        self.delete()

    def close(self) -> None:
        """Later tables belong to the scope around this one."""
        if self in _open_pins:
            _open_pins.remove(self)

    def delete(self) -> None:
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            place = paths(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


# Spark then deletes the shuffle files of a query when it ends; otherwise only once the driver happens to collect garbage.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Frames made and run inside leave no shuffle files behind; run again, such a frame would have to repeat its stages."""
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)


def pin_counted(df: DataFrame, owned: bool = True, codec: str | None = None) -> tuple[DataFrame, int]:
    """``pin`` with the number of rows, counted while writing. What it shuffled is deleted once it is written."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/puckspark/{uuid.uuid4().hex}"
    if _open_pins and owned:
        _open_pins[-1].paths.append(path)
    with shuffles_end(spark):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]
