"""Tables on disk: knowledge bases, models, symbols and results, read, appended and resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dump(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def open_or_create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one where there is none yet."""
    return load(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def missing(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys are not done: what a resumed run still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def memoized(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s table, made once and read from path ever after. The path should name the parameters."""
    if not exists(spark, path):
        dump(make(), path)
    return load(spark, path)


def resumed(spark: SparkSession, path: str, todo: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """All results of work over todo, of which only what path lacks is done now."""
    rest = missing(todo, open_or_create(spark, path, schema), keys)
    work(rest).write.mode("append").parquet(path)
    return load(spark, path)


def dump_report(df: DataFrame, path: str, line: str, *order) -> None:
    """A text report: a line (SQL expression) for each row, in order."""
    df.orderBy(*order).selectExpr(f"{line} AS value").write.mode("overwrite").text(path)
