"""Session helpers: a local session for tests and the shared output folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "trailscope") -> SparkSession:
    """A ``local[N]`` session for tests and the bench (no UI, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The cluster-shared folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (session conf, else the context's
    checkpoint dir). Only when neither is set, a folder under the SQL warehouse
    (shared storage on a cluster) is used and registered as checkpoint dir.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    context = _context(spark)
    if not root and context is not None:
        root = context.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if context is not None and not context.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder: the warehouse {warehouse} may be local to one machine")
        root = f"{warehouse.rstrip('/')}/_trailscope_shared"
        if context is not None:
            context.setCheckpointDir(root)
    return root.rstrip("/")


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect, which has none."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect raises instead of returning a context
        return None


def application_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or spark.conf.get("spark.app.name", "trailscope")


_scratch: list[tuple[SparkSession, str, tuple[str, ...]]] = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written folder. Under Spark Connect, which has no file access, it stays."""
    context = _context(spark)
    if context is not None:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def replace_path(spark: SparkSession, fresh: str, target: str) -> None:
    """Move a written folder into the place of ``target``. Needs a classic session: Spark Connect has no file access."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    new, place, old = path(fresh), path(target), path(f"{fresh}.replaced")
    files = new.getFileSystem(context._jsc.hadoopConfiguration())
    if files.exists(place) and not files.rename(place, old):
        raise OSError(f"cannot move {target}")
    if not files.rename(new, place):
        raise OSError(f"cannot move {fresh} to {target}; the old data are in {fresh}.replaced")
    files.delete(old, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` (Spark Connect: none)."""
    context = _context(spark)
    if context is None:
        return []
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(root)
    return [f.getPath().getName() for f in listed if f.isDirectory()]


def remove_at_exit(spark: SparkSession, path: str, tables: tuple[str, ...] = ()) -> str:
    """Drop ``tables`` and delete ``path`` when the interpreter ends; returns the path."""
    _scratch.append((spark, path, tables))
    return path


@atexit.register
def _remove_scratch() -> None:
    for spark, path, tables in _scratch:
        try:
            for table in tables:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove_path(spark, path)
        except Exception:  # the session has ended before the interpreter: nothing left to ask
            return


def file_version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and modification times of the files at ``path``, in any file system Spark reads (Spark Connect: the path only)."""
    context = _context(spark)
    if context is None:
        return (path,)
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(root)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in listed)


def shared_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path under :func:`shared_root`; ``unique`` appends a fresh suffix."""
    suffix = f"-{uuid.uuid4().hex[:12]}" if unique else ""
    return f"{shared_root(spark)}/{name}{suffix}"
