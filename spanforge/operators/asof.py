"""As-of replacement: service calls take the place of the low-level events that carried them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_carriers(events: DataFrame, services: DataFrame, carrier: str) -> tuple[DataFrame, DataFrame]:
    """(events, unmatched services).

    events: tid, ts, pos, name; services: tid, ts, name. Each service replaces its thread's last event named carrier at
    or before its time, if a later event follows in the thread; of several on one carrier the last service wins. A
    union and a window find the carrier, so a thread's rows meet in one sort and nothing is joined by inequality.
    """
    e = events.select("tid", "ts", "pos", "name", F.lit(0).alias("what"))
    s = services.select("tid", "ts", F.lit(None).cast("long").alias("pos"), "name", F.lit(1).alias("what"))
    both = e.unionByName(s)
    upto = Window.partitionBy("tid").orderBy("ts", "what", "pos").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("tid")
    found = (
        both.withColumn("at", F.last(F.when((F.col("what") == 0) & (F.col("name") == carrier), F.col("pos")), ignorenulls=True).over(upto))
        .withColumn("end", F.max(F.when(F.col("what") == 0, F.col("ts"))).over(last))
        .where("what = 1")
    )
    hit = found.where("at IS NOT NULL AND end > ts")
    taken = hit.groupBy("tid", F.col("at").alias("pos")).agg(F.max_by("name", F.struct("ts", "name")).alias("service"))
    replaced = events.join(taken, ["tid", "pos"], "left").withColumn("name", F.coalesce("service", "name")).drop("service")
    return replaced.select(*events.columns), found.where("at IS NULL OR end IS NULL OR end <= ts").select("tid", "ts", "name")
