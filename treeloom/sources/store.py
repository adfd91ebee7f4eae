"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, what: str = "rows") -> str:
    """A new path below the session's ``spark.checkpoint.dir``; below a local one, removed at exit, only where that is unset and all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="treeloom-rows-")
            atexit.register(shutil.rmtree, _own[app], True)
        named = _own[app]
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written once as Parquet, and what reads it back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
