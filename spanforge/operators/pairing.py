"""Spans of calls from their starts and ends. Positions of spans count events only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _all() -> WindowSpec:
    return Window.partitionBy("tid").orderBy("pos")


def event_index(trace: DataFrame) -> DataFrame:
    """trace with idx, the number of events before a row of its thread."""
    before = F.coalesce(F.sum(F.when(F.col("kind") == "SYS", 1).otherwise(0)).over(_all().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return trace.withColumn("idx", before.cast("long"))


def _calls(trace: DataFrame) -> DataFrame:
    return event_index(trace).where("kind = 'API'")


def lifo_spans(trace: DataFrame) -> DataFrame:
    """(tid, s, e, api, e_pos): an end closes the latest open start of its name; empty spans, and what stays open, are left out.

    Depth within a name is a running sum, clamped where ends outnumber starts; a start and the next end of its level pair up.
    """
    by_name = Window.partitionBy("tid", "name").orderBy("pos")
    run = _calls(trace).withColumn("c", F.sum(F.when(F.col("state") == "S", 1).otherwise(-1)).over(by_name))
    run = run.withColumn("m", F.least(F.lit(0), F.min("c").over(by_name)))
    run = run.withColumn("m0", F.coalesce(F.lag("m").over(by_name), F.lit(0)))
    run = run.where("state = 'S' OR m = m0").withColumn("level", F.when(F.col("state") == "S", F.col("c") - F.col("m")).otherwise(F.col("c") - F.col("m") + 1))
    pair = Window.partitionBy("tid", "name", "level").orderBy("pos")
    paired = run.withColumn("e", F.lead("idx").over(pair)).withColumn("e_state", F.lead("state").over(pair)).withColumn("e_pos", F.lead("pos").over(pair))
    return paired.where("state = 'S' AND e_state = 'E' AND idx <> e").select("tid", F.col("idx").alias("s"), "e", F.col("name").alias("api"), "e_pos")


def first_end_spans(trace: DataFrame) -> DataFrame:
    """(tid, s, e, api, s_pos): a start pairs with the first later end of its name; empty spans stay."""
    ahead = Window.partitionBy("tid", "name").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("state") == "E", F.col("idx")), ignorenulls=True).over(ahead)
    return _calls(trace).withColumn("e", end).where("state = 'S' AND e IS NOT NULL").select("tid", F.col("idx").alias("s"), "e", F.col("name").alias("api"), F.col("pos").alias("s_pos"))


def outermost_spans(trace: DataFrame) -> DataFrame:
    """(tid, s, e) of outermost calls in well-nested threads; empty spans are left out."""
    run = _calls(trace).withColumn("depth", F.sum(F.when(F.col("state") == "S", 1).otherwise(-1)).over(_all()))
    top = run.where("(state = 'S' AND depth = 1) OR (state = 'E' AND depth = 0)")
    return top.withColumn("e", F.lead("idx").over(_all())).where("state = 'S' AND e IS NOT NULL AND e > idx").select("tid", F.col("idx").alias("s"), "e")


def outermost_of(rows: list[tuple[str, str | None, str]]) -> list[tuple[int, int]]:
    """Spans during which any call is open, from one thread's (kind, state, name).

    An end pops down to its name; one that is not open empties the stack. Empty spans are left out, an open one ends
    with the last event.
    """
    stack: list[str] = []
    spans: list[tuple[int, int]] = []
    at = start = 0
    for kind, state, name in rows:
        if kind == "SYS":
            at += 1
        elif state == "S":
            if not stack:
                start = at
            stack.append(name)
        elif stack:
            while stack and stack.pop() != name:
                pass
            if not stack and at > start:
                spans.append((start, at))
    if stack and at > start:
        spans.append((start, at))
    return spans


def outermost_spans_exact(trace: DataFrame) -> DataFrame:
    """outermost_spans() for threads that are not well nested, a thread at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        spans = outermost_of(list(zip(group["kind"], group["state"], group["name"], strict=True)))
        return pd.DataFrame([(group["tid"].iloc[0], s, e) for s, e in spans], columns=["tid", "s", "e"])

    return trace.select("tid", "pos", "kind", "state", "name").groupBy("tid").applyInPandas(run, f"tid {dict(trace.dtypes)['tid']}, s long, e long")


def leaf_spans(trace: DataFrame) -> DataFrame:
    """(tid, s, e, api): starts followed by one event or more, and by no other call before their end (or the thread's)."""
    calls = _calls(trace)
    total = event_index(trace).groupBy("tid").agg(F.sum(F.when(F.col("kind") == "SYS", 1).otherwise(0)).cast("long").alias("total"))
    ahead = calls.withColumn("nx", F.lead("name").over(_all())).withColumn("ns", F.lead("state").over(_all())).withColumn("ni", F.lead("idx").over(_all()))
    alone = ahead.where("state = 'S' AND ((ns = 'E' AND nx = name) OR ns IS NULL)").join(total, "tid")
    return alone.withColumn("e", F.coalesce("ni", "total")).where("e > idx").select("tid", F.col("idx").alias("s"), "e", F.col("name").alias("api"))


def innermost_listed(spans: DataFrame) -> DataFrame:
    """LIFO spans but those in which the span listed before them (by end) starts."""
    before = F.lag("s").over(Window.partitionBy("tid").orderBy("e_pos"))
    return spans.withColumn("__p", before).where("__p IS NULL OR NOT (__p >= s AND __p < e)").drop("__p")


def union_spans(spans: DataFrame) -> DataFrame:
    """(tid, s, e): spans of a thread merged where they nest, overlap or touch."""
    order = Window.partitionBy("tid").orderBy("s", F.col("e").desc())
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    marked = marked.withColumn("__k", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("tid", "__k").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__k")
