"""Session settings, table loading and the shared work folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that results rely on (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallygrove")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = "file://" + tempfile.mkdtemp(prefix="tallygrove-")
    return _OWN_DIR["dir"]


#: Folders that temporary() named and nothing deleted yet; what is left of them goes when the process ends.
_LEFT: dict[str, None] = {}


def temporary(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the shared folder; the folder is deleted at the end of the process if not before."""
    if not _LEFT:
        atexit.register(_clear, spark._jvm, spark._jsc.hadoopConfiguration())
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _LEFT[path] = None
    return path


def _clear(jvm, settings) -> None:
    atexit.unregister(_clear)
    # The JVM may be gone by now, and with it its access to the folder.
    with suppress(Exception):
        for name in list(_LEFT):
            where = jvm.org.apache.hadoop.fs.Path(name)
            where.getFileSystem(settings).delete(where, True)
    _LEFT.clear()


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = temporary(spark, tag)
    with _shuffles_end(spark):
        df.write.parquet(path, compression=compression)
    for held in _SCOPES.get():
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Of this thread only, so that jobs side by side don't note each other's tables.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(held: list[str]):
    """Note in ``held`` the folders that materialize() writes meanwhile."""
    before = _SCOPES.set((*_SCOPES.get(), held))
    try:
        yield held
    finally:
        _SCOPES.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _LEFT.pop(path, None)


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_work_path", None)
    if path:
        delete(df.sparkSession, path)


#: Rows of an Arrow batch where rows are whole texts; the default is five times as many.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in smaller batches: several copies of one are in memory at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished phases; Spark keeps them until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a few columns that a task groups at most.
TASK_ROWS = 250_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions to deal rows out to, so that a task's share doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


#: Characters of text whose words a task counts or joins at once, about two million of them.
TASK_CHARS = 12_000_000
#: What else bounds a task's share where Spark decides: of a shuffle, of a key with many rows, of what is read.
_SHARES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


@contextmanager
def text_shares(spark: SparkSession, chars: int):
    """What is planned meanwhile deals words of ``chars`` characters out so that a task's share doesn't grow with the table."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    wanted = {"spark.sql.shuffle.partitions": str(parts), **_SHARES}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def measured_joins(spark: SparkSession):
    """What is written meanwhile broadcasts a side of a join by a hint or by its measured size only, never by an estimate: after an explode that is many times too low."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (planned, measured)}
    spark.conf.set(measured, before[measured] or spark.conf.get(planned))
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Rows of a few numbers up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """df, written once and marked for broadcast if it was counted to have at most BROADCAST_ROWS rows."""
    held = materialize(df, "side")
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
