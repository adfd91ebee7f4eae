"""What the operators of this package share: reading tables, writing intermediate tables, words, hashes.

``settle`` cuts lineage by writing a Parquet table below the folder named in ``spark.checkpoint.dir``,
which all executors share, so a lost executor costs a read and not a recomputation. The shuffle files of that write go
when it ends: else they stay until the driver happens to collect its garbage, which a large heap puts off to the end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A query's shuffle files are removed from all executors when it ends; the files of tables are not.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_written: list[tuple[str, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; columns that it has besides are never read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="treeloom-")
            atexit.register(shutil.rmtree, _own[app], True)
        named = _own[app]
    return f"{named.rstrip('/')}/treeloom-{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and return what reads it back."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete the tables that ``settle`` wrote for this session; frames that read them end."""
    app = spark.sparkContext.applicationId
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for own, path in [x for x in _written if x[0] == app]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _written.remove((own, path))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def row_mark(df: DataFrame, seed: str = "") -> Column:
    """128 bits that stand for a row's content, nulls and null ids included; maps don't count.

    Decisions about rows are carried by this and not by an id, which may be missing or shared by several rows.
    """
    columns = [F.lit(seed), *(F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType))]
    nulls = F.concat(F.lit("|"), *(F.when(c.isNull(), F.lit("n")).otherwise(F.lit("v")) for c in columns))
    return F.struct(F.xxhash64(nulls, *columns).alias("a"), F.xxhash64(*columns, nulls, F.lit(7)).alias("b"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
