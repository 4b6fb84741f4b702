"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Folders written inside each open ``scratch`` of this thread or task, innermost last.
_OPEN: ContextVar[tuple[dict[str, bool], ...]] = ContextVar("asterism_scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its
    own; a cluster without it is an error, as its executors share no disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A folder for one more table, deleted with the ``scratch`` that is open in this thread."""
    path = f"{shared_dir(spark)}/asterism-{uuid.uuid4().hex}"
    if scopes := _OPEN.get():
        scopes[-1][path] = False
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: cuts the lineage.

    The files outlive executors, so a lost one costs no recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    """The folders of ``new_path`` that ``df`` reads, at any depth."""
    found = set()
    for f in df.inputFiles():
        parts = f.split("/")
        at = next((i for i, p in enumerate(parts) if p.startswith("asterism-")), None)
        if at is not None:
            found.add("/".join(parts[: at + 1]))
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for name in _folders(df):
        if f"{root.split(':', 1)[-1].lstrip('/')}/asterism-" in name.split(":", 1)[-1]:
            _delete(spark, name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving all tables that this thread has written inside, but those that went through ``kept``.

    The scopes belong to the thread or asynchronous task that opens them, so
    jobs side by side in one driver don't see each other's tables. What an inner
    scope keeps belongs to the one around it then.
    """
    around, own = _OPEN.get(), {}
    mark = _OPEN.set((*around, own))
    try:
        yield
    finally:
        _OPEN.reset(mark)
        for path, stays in own.items():
            if not stays:
                _delete(spark, path)
            elif around:
                around[-1].setdefault(path, False)


def kept(df: DataFrame) -> DataFrame:
    """``df``, whose tables outlive the ``scratch`` around."""
    if scopes := _OPEN.get():
        names = {f.rpartition("/")[2] for f in _folders(df)}
        for path in scopes[-1]:
            if path.rpartition("/")[2] in names:
                scopes[-1][path] = True
    return df


def tidy(make: Callable) -> Callable:
    """A function of tables that leaves those alone that its result, a DataFrame or a tuple with some, still reads."""

    @wraps(make)
    def run(*args, **options):
        spark = next(a if isinstance(a, SparkSession) else a.sparkSession for a in (*args, *options.values()) if isinstance(a, (SparkSession, DataFrame)))
        with scratch(spark):
            found = make(*args, **options)
            for part in found if isinstance(found, tuple) else (found,):
                if isinstance(part, DataFrame):
                    kept(part)
            return found

    return run
