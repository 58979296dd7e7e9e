"""Tables between the steps of a chain, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that is unset, a temporary folder is made, if all tasks run in this
    process and so on this machine; on a cluster that would lose files.
    """
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="kindred-"))
    return f"{root.rstrip('/')}/kindred-{app}"


def own_folder(spark: SparkSession, label: str) -> str:
    """A new path there, deleted when the process ends or by `forget`."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table: computed once, with no plan behind it, and safe from the loss of executors."""
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing will read again."""
    for df in tables:
        _delete(df._scratch)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Collect what finished steps have left in the driver's heap, which gives memory back to the system; their shuffle files go too."""
    spark.sparkContext._jvm.System.gc()


def since(marks: frozenset[str] | None = None) -> frozenset[str]:
    """The paths in use now; given an earlier answer, those made after it are deleted."""
    if marks is not None:
        for path in [p for p in _WRITTEN if p not in marks]:
            _delete(path)
    return frozenset(_WRITTEN)


@atexit.register
def drop_written() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone already
            _WRITTEN.pop(path, None)
