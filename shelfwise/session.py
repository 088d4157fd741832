"""Session settings and the place where lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def build_session(app: str = "shelfwise", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on.

    Only ``master`` and resource sizes differ between a laptop and a cluster;
    pass them (and anything else) as keyword settings with ``__`` for dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` where it is set.

    A local master without the setting gets a temporary folder. On a cluster a
    folder of one machine would be lost with it, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="run-")


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Actions on frames made inside remove their shuffle files when they end.

    Spark keeps them until the driver collects garbage, which may be never. For
    results that are stored, so nobody reads the shuffle again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def noting() -> Iterator[list[str]]:
    """The paths of what this thread cuts or writes aside inside."""
    outer = _scratch.set([])
    try:
        yield _scratch.get()
    finally:
        _scratch.reset(outer)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete what ``noting`` told of; what was made of it must be stored by then."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def set_aside(path: str) -> str:
    """``path``, told to the ``noting`` around it, if any."""
    made = _scratch.get()
    if made is not None:
        made.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor, fixes row placement. Its shuffle files go at once."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with releasing(spark):
        cut = df.select("*").checkpoint(eager=True)
    if _scratch.get() is not None:
        stored = cut._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if stored.isDefined():
            set_aside(stored.get())
    return cut


def tune(spark: SparkSession) -> None:
    """Run-time settings for skewed keys, for sessions built elsewhere."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a hot join key even where the aggregate above then needs a shuffle of its own
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
