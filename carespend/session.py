"""Session settings and the shared folder used to cut lineage or stage files."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "carespend", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC times."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_staged").rstrip("/")


#: What each application has put into the shared folder.
_staged: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; frames that read it cannot be used any more."""
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the shared folder if the cluster has not done so."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


#: The longest method, in bytes, that the JVM compiles.
JIT_LIMIT = 8000
_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_lock = threading.Lock()
_inside: dict[str, list] = {}


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs that begin inside make no methods that the JVM would interpret for their length.

    Plans of very many expressions become one method of generated code; beyond this limit Spark
    evaluates them in smaller ones instead. The setting is put back when the last of several threads leaves.
    """
    key = spark.sparkContext.applicationId
    with _lock:
        if key not in _inside:
            old = spark.conf.get(_LIMIT)
            _inside[key] = [0, old]
            if int(old) > JIT_LIMIT:
                spark.conf.set(_LIMIT, JIT_LIMIT)
        _inside[key][0] += 1
    try:
        yield
    finally:
        with _lock:
            _inside[key][0] -= 1
            if not _inside[key][0]:
                spark.conf.set(_LIMIT, _inside.pop(key)[1])
