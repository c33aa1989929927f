"""Text logs of per-thread events as typed DataFrames, and back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARK = r'^(\d+)\s+([\d.]+)\s+write\(\d+</dev/null>, "([SE]) ([^"]*)"'
_STRACE = r"^(\d+)\s+([\d.]+)\s+(.*)$"
_CALL = r"^([\d.]+)\s(?:ANDROID|JAVA)\s(\d+)\s([SE])\s(.*)$"
_EVENT = r"^([\d.]+)\sSYSCALL\s(\d+)\s(.*)$"
_THREAD_LINE = r"^[\d.]+\s[A-Z]+\s\d{1,6}\s.*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value, file) of text files."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A list of names, a trimmed line each; empty lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def _group(value: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(value, pattern, i)


def parse_strace(value: Column) -> Column:
    """Struct (ts, kind, tid, state, payload) of a raw line: a write of a mark to /dev/null is a call's start or end; null if it is neither that nor an event."""
    mark = F.struct(_group(value, _MARK, 2).try_cast("double").alias("ts"), F.lit("JAVA").alias("kind"), _group(value, _MARK, 1).try_cast("int").alias("tid"), _group(value, _MARK, 3).alias("state"), _group(value, _MARK, 4).alias("payload"))
    event = F.struct(_group(value, _STRACE, 2).try_cast("double").alias("ts"), F.lit("SYSCALL").alias("kind"), _group(value, _STRACE, 1).try_cast("int").alias("tid"), F.lit(None).cast("string").alias("state"), _group(value, _STRACE, 3).alias("payload"))
    return F.when(F.regexp_like(value, F.lit(_MARK)), mark).when(F.regexp_like(value, F.lit(_STRACE)), event)


def parse_log(value: Column, events_first: bool = False) -> Column:
    """Struct (ts, kind, tid, state, name) of a typed line; null for a malformed one. events_first tries that form first."""
    call = F.struct(_group(value, _CALL, 1).try_cast("double").alias("ts"), F.lit("API").alias("kind"), _group(value, _CALL, 2).try_cast("int").alias("tid"), _group(value, _CALL, 3).alias("state"), _group(value, _CALL, 4).alias("name"))
    event = F.struct(_group(value, _EVENT, 1).try_cast("double").alias("ts"), F.lit("SYS").alias("kind"), _group(value, _EVENT, 2).try_cast("int").alias("tid"), F.lit(None).cast("string").alias("state"), _group(value, _EVENT, 3).alias("name"))
    is_call, is_event = F.regexp_like(value, F.lit(_CALL)), F.regexp_like(value, F.lit(_EVENT))
    return F.when(is_event, event).when(is_call, call) if events_first else F.when(is_call, call).when(is_event, event)


def split_bad(lines: DataFrame, events_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed events, malformed lines): nothing is lost silently."""
    parsed = lines.withColumn("e", parse_log(F.col("value"), events_first))
    return parsed.where("e IS NOT NULL").select("e.*"), parsed.where("e IS NULL").drop("e")


def thread_lines(lines: DataFrame) -> DataFrame:
    """Lines that name a thread."""
    return lines.where(F.regexp_like("value", F.lit(_THREAD_LINE)))


def format_event(ts: Column, kind: Column, tid: Column, state: Column, payload: Column) -> Column:
    """The typed line of an event. Events print their payload."""
    return F.when(kind.isin("JAVA", "API"), F.format_string("%.6f JAVA %d %s %s", ts, tid, state, payload)).otherwise(F.format_string("%.6f SYSCALL %d %s", ts, tid, payload))


def in_time_order(events: DataFrame) -> DataFrame:
    """Events by time; ties by kind, thread, state and payload."""
    return events.orderBy("ts", "kind", "tid", F.col("state").asc_nulls_first(), "payload")


def as_trace(events: DataFrame, trace_id: str = "t") -> DataFrame:
    """Parsed events as a trace (trace_id, tid, pos, kind, state, name, raw, ts), positions from 0 in each thread."""
    order = Window.partitionBy("tid").orderBy("ts", "kind", F.col("state").asc_nulls_first(), "name")
    pos = (F.row_number().over(order) - 1).cast("long")
    short = F.when(F.col("kind") == "SYS", F.substring_index("name", "(", 1)).otherwise(F.col("name"))
    return events.select(F.lit(trace_id).alias("trace_id"), "tid", pos.alias("pos"), "kind", "state", short.alias("name"), F.col("name").alias("raw"), "ts")


_UNFINISHED = re.compile(r"(.*) [<]?unfinished \.\.\.>.*$")
_RESUMED = re.compile(r"^.*<\.\.\. (\S+) resumed>(.*)$")


def mend(lines: list[str]) -> list[str]:
    """Whole lines of one process, whose sorted lines these are: an interrupted line and its resumption become one.

    A resumption without a pending line is dropped, and so are both where names differ. While a line is pending, others
    are dropped, but one that says "killed" is kept with the pending one, which stays pending.
    """
    out: list[str] = []
    pending: re.Match[str] | None = None
    for line in lines:
        cut, resumed = _UNFINISHED.match(line), _RESUMED.match(line)
        if pending is None:
            if cut:
                pending = cut
            elif not resumed:
                out.append(line)
        elif resumed and not cut:
            if resumed[1] in pending[1]:
                out.append(pending[1] + resumed[2])
            pending = None
        elif not resumed and not cut and "killed" in line:
            out += [pending.string, line]
    return out


def straighten(lines: DataFrame) -> DataFrame:
    """Lines (value) with interrupted ones mended, each process by itself, as (ts, value)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"value": pd.Series(mend(sorted(group["value"])), dtype=object)})

    pid = F.substring_index("value", " ", 1)
    whole = lines.select(pid.alias("pid"), "value").groupBy("pid").applyInPandas(run, "value string")
    return whole.select(F.regexp_extract("value", r"^\S+\s+(\S+)", 1).try_cast("double").alias("ts"), "value")


def straighten_pairs(lines: DataFrame) -> DataFrame:
    """straighten() for logs where every interrupted line is resumed next in its process: windows only."""
    order = Window.partitionBy("pid").orderBy("value")
    marked = lines.select(F.substring_index("value", " ", 1).alias("pid"), "value").withColumn("after", F.lead("value").over(order))
    head = F.regexp_extract("value", r"(.*) [<]?unfinished \.\.\.>.*$", 1)
    tail = F.regexp_extract("after", r"^.*<\.\.\. (\S+) resumed>(.*)$", 2)
    name = F.regexp_extract("after", r"^.*<\.\.\. (\S+) resumed>(.*)$", 1)
    cut, resumed = F.col("value").rlike(r" [<]?unfinished \.\.\.>"), F.col("value").rlike(r"<\.\.\. \S+ resumed>")
    fixed = F.when(cut & F.col("after").rlike(r"<\.\.\. \S+ resumed>") & F.contains(head, name), F.concat(head, tail)).when(~cut, F.col("value"))
    return marked.where(~resumed | cut).select(fixed.alias("value")).where("value IS NOT NULL").select(F.regexp_extract("value", r"^\S+\s+(\S+)", 1).try_cast("double").alias("ts"), "value")
