"""A shared place for tables that queries derive, removed when the application ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_made: dict[tuple, str] = {}
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's in spark.checkpoint.dir, or in one of the warehouse where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
            spark.conf.set("spark.checkpoint.dir", named)
        path = f"{named.rstrip('/')}/{app}-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)  # only what exists can be marked
        fs.deleteOnExit(at)
        _folders[app] = path
    return _folders[app]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[str], None]) -> str:
    """The path that make() has filled, made at the first call of the application."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _made:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        make(path)
        _made[key] = path
    return _made[key]
