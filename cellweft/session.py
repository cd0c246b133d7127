"""Session factory and the two ways the engine shortens lineage.

Iterative operators write their state to the folder every executor shares (``spark.checkpoint.dir``); a lost executor then
costs a re-read, never a recomputation of earlier rounds, and nothing depends on blocks held by one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session of our own; a session that exists already is left as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "cellweft", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset (single-machine sessions)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and the new plan has exact size statistics.

    The frame carries ``cut_path`` so that :func:`release` can remove a superseded round; the rest goes at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellweft/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path  # type: ignore[attr-defined]
    return back


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cellweft-code-")) / "cellweft.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, removed at exit."""
    path = f"{shared_dir(spark)}/cellweft/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    _remove(spark, path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark can reach; none if it does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`cut` that no later plan reads."""
    for df in frames:
        path = getattr(df, "cut_path", None)
        if path:
            _remove(df.sparkSession, path)
            _written[:] = [(s, p) for s, p in _written if p != path]


@atexit.register
def _at_exit() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the gateway may be gone already
            return


def fits_broadcast(df: DataFrame, limit_bytes: int = 32 << 20) -> bool:
    """Whether the optimizer's size estimate of ``df`` is under ``limit_bytes``; written tables have exact estimates."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes
