"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of a word boundary: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that `written` has left in the shared folder.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor loses none of it."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path, for `dropped` when nothing reads it any more.

    The write's shuffle files go as soon as it ends: else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _PATHS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        if path in _PATHS:
            _PATHS.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has written and not dropped; to be called when no result that reads them is needed."""
    dropped(spark, *list(_PATHS))


#: Parts that the rows of one key are dealt over.
SALTS = 256


def with_group(df: DataFrame, key: str, by: str, name: str, value: Column, merge: Callable[[str], Column]) -> DataFrame:
    """df with `name`: value over the parts of each key, and merge over those. Rows whose key is null are left out.

    A key's rows are dealt over SALTS parts by their column `by`, and only the parts' values meet by key, so that the
    rows of a hot key lie in no single task.
    """
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(key, "__salt").agg(value.alias("__part"))
    whole = parts.withColumn(name, merge("__part").over(Window.partitionBy(key))).drop("__part")
    return dealt.join(whole, [key, "__salt"]).drop("__salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The maximal runs of characters outside SPACE, as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x09-\x0D\x20]+"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what a Python worker holds of its input at once: texts may be long, so a batch ends at its bytes too.

    Where the session or its context sets a bound of its own, that stays.
    """
    given = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if key not in given:
            spark.conf.set(key, value)
