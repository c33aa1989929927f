"""From bracketed threads to a knowledge base: which calls and events every API made.

Well-nested threads are attributed with windows; others go through a stack machine, a thread at a time. START holds
what a thread does before its first call, NOAPI what it does between its outermost calls.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from spanforge.operators.clean import EMPTY_CALLS
from spanforge.plans.lineage import cut

Call = tuple[str, str]


def _all() -> WindowSpec:
    return Window.partitionBy("tid").orderBy("pos")


class ExclusiveMachine:
    """An event belongs to the innermost open call; a call is recorded in the one around it.

    An end that is not of the innermost call unwinds: every frame on the way is emitted, but the one that it names is
    lost with its calls. Where no frame has that name, NOAPI is emitted too and a new one begins.
    """

    def __init__(self) -> None:
        self.frames: list[tuple[str, list[Call]]] = [("START", [])]

    def step(self, kind: str, state: str | None, name: str) -> list[tuple[str, list[Call]]]:
        """What this event completes: (api, calls)."""
        api, calls = self.frames[-1]
        if kind == "SYS":
            calls.append(("SYS", name))
            return []
        if state == "S":
            done = []
            if api in ("START", "NOAPI"):
                self.frames.pop()
                if api == "START" or calls:
                    done.append((api, calls))
                self.frames.append(("NOAPI", []))
            else:
                calls.append(("API", name))
            self.frames.append((name, []))
            return done
        self.frames.pop()
        if api == name:
            if not self.frames:
                self.frames.append(("NOAPI", []))
            return [(api, calls)]
        done = [(api, calls)]
        while self.frames:
            api, calls = self.frames.pop()
            if api == name:
                break
            done.append((api, calls))
        if not self.frames:
            self.frames.append(("NOAPI", []))
        return done


class InclusiveMachine:
    """An event belongs to every open call; calls are not recorded. An unwinding end leaves the frame that it names open."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, list[Call]]] = [("START", [])]

    def step(self, kind: str, state: str | None, name: str) -> list[tuple[str, list[Call]]]:
        api, calls = self.frames[-1]
        if kind == "SYS":
            for _, c in self.frames:
                c.append(("SYS", name))
            return []
        if state == "S":
            done = []
            if api in ("START", "NOAPI"):
                self.frames.pop()
                if api == "START" or calls:
                    done.append((api, calls))
            self.frames.append((name, []))
            return done
        if api == name:
            self.frames.pop()
            if not self.frames:
                self.frames.append(("NOAPI", []))
            return [(api, calls)]
        if name in ("START", "NOAPI"):
            return []
        done = []
        while self.frames and self.frames[-1][0] != name:
            done.append(self.frames.pop())
        if not self.frames:
            self.frames.append(("NOAPI", []))
        return done


def realizations(rows: list[Call | tuple[str, str | None, str]], inclusive: bool = False) -> list[tuple[str, list[Call]]]:
    """The (api, calls) that one thread's (kind, state, name) complete, in order."""
    machine = InclusiveMachine() if inclusive else ExclusiveMachine()
    return [(api, list(calls)) for row in rows for api, calls in machine.step(*row)]


def attribute_exact(trace: DataFrame, inclusive: bool = False) -> DataFrame:
    """(tid, api, seq, calls) by the stack machine."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        found = realizations(list(zip(group["kind"], group["state"], group["raw"], strict=True)), inclusive)
        tid = group["tid"].iloc[0]
        return pd.DataFrame([(tid, api, i, [{"kind": k, "name": n} for k, n in calls]) for i, (api, calls) in enumerate(found)], columns=["tid", "api", "seq", "calls"])

    return trace.select("tid", "pos", "kind", "state", "raw").groupBy("tid").applyInPandas(run, f"tid {dict(trace.dtypes)['tid']}, api string, seq long, calls {EMPTY_CALLS}")


def _levels(trace: DataFrame) -> DataFrame:
    step = F.when((F.col("kind") == "API") & (F.col("state") == "S"), 1).when(F.col("kind") == "API", -1).otherwise(0)
    return trace.withColumn("depth", F.sum(step).over(_all()))


def well_nested(trace: DataFrame) -> DataFrame:
    """(tid, nested): whether each end closes the innermost open call, and every call is closed."""
    calls = _levels(trace).where("kind = 'API'").withColumn("level", F.when(F.col("state") == "S", F.col("depth")).otherwise(F.col("depth") + 1))
    opened = F.last(F.when(F.col("state") == "S", F.col("name")), ignorenulls=True).over(Window.partitionBy("tid", "level").orderBy("pos"))
    ok = calls.withColumn("opened", opened).groupBy("tid").agg((F.min("depth") >= 0).alias("a"), F.bool_and((F.col("state") == "S") | F.coalesce(F.col("opened") == F.col("name"), F.lit(False))).alias("b"), F.sum(F.when(F.col("state") == "S", 1).otherwise(-1)).alias("c"))
    return ok.select("tid", (F.col("a") & F.col("b") & (F.col("c") == 0)).alias("nested"))


def _frames(rows: DataFrame) -> DataFrame:
    """(tid, level, pos, e_pos, api) of every call of well-nested threads."""
    calls = rows.where("kind = 'API'").withColumn("level", F.when(F.col("state") == "S", F.col("depth")).otherwise(F.col("depth") + 1))
    pair = Window.partitionBy("tid", "level").orderBy("pos")
    return calls.withColumn("e_pos", F.lead("pos").over(pair)).where("state = 'S'").select("tid", "level", "pos", "e_pos", F.col("name").alias("api"))


def _outside(rows: DataFrame) -> DataFrame:
    """(tid, api, seq, calls) of START and NOAPI in well-nested threads. seq is the position of the start that ends them."""
    is_start = (F.col("kind") == "API") & (F.col("state") == "S") & (F.col("depth") == 1)
    ahead = Window.partitionBy("tid").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    until = rows.withColumn("until", F.first(F.when(is_start, F.col("pos")), ignorenulls=True).over(ahead))
    loose = until.where("kind = 'SYS' AND depth = 0 AND until IS NOT NULL").groupBy("tid", "until").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: F.struct(F.lit("SYS").alias("kind"), x["raw"].alias("name"))).alias("calls"))
    first = rows.where(is_start).groupBy("tid").agg(F.min("pos").alias("until"))
    start = first.join(loose, ["tid", "until"], "left").select("tid", F.lit("START").alias("api"), F.col("until").alias("seq"), F.coalesce("calls", F.array().cast(EMPTY_CALLS)).alias("calls"))
    between = loose.join(first, ["tid", "until"], "left_anti").select("tid", F.lit("NOAPI").alias("api"), F.col("until").alias("seq"), "calls")
    return start.unionByName(between)


def exclusive_nested(trace: DataFrame) -> DataFrame:
    """(tid, api, seq, calls) of well-nested threads, each event to the innermost call; seq orders a thread's realizations.

    Depths are written once (lineage.cut), as frames, their calls and what lies outside are all read from them.
    """
    rows = cut(_levels(trace).select("tid", "pos", "kind", "state", "name", "raw", "depth"))
    frames = _frames(rows)
    opens = frames.select("tid", "level", "pos", F.lit(0).alias("what"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("raw"))
    made = rows.where("kind = 'SYS' OR state = 'S'").select("tid", F.when(F.col("kind") == "SYS", F.col("depth")).otherwise(F.col("depth") - 1).alias("level"), "pos", F.lit(1).alias("what"), "kind", "raw").where("level > 0")
    order = Window.partitionBy("tid", "level").orderBy("pos", "what")
    owned = opens.unionByName(made).withColumn("frame", F.last(F.when(F.col("what") == 0, F.col("pos")), ignorenulls=True).over(order)).where("what = 1")
    calls = owned.groupBy("tid", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "raw"))), lambda x: F.struct(x["kind"].alias("kind"), x["raw"].alias("name"))).alias("calls"))
    inside = frames.join(calls.withColumnRenamed("frame", "pos"), ["tid", "pos"], "left").select("tid", "api", F.col("e_pos").alias("seq"), F.coalesce("calls", F.array().cast(EMPTY_CALLS)).alias("calls"))
    return inside.unionByName(_outside(rows))


def inclusive_nested(trace: DataFrame) -> DataFrame:
    """(tid, api, seq, calls) of well-nested threads, each event to every open call: slices of the thread's events."""
    rows = _levels(trace)
    before = F.coalesce(F.sum(F.when(F.col("kind") == "SYS", 1).otherwise(0)).over(_all().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    indexed = rows.withColumn("idx", before)
    calls = indexed.where("kind = 'API'").withColumn("level", F.when(F.col("state") == "S", F.col("depth")).otherwise(F.col("depth") + 1))
    pair = Window.partitionBy("tid", "level").orderBy("pos")
    frames = calls.withColumn("e_pos", F.lead("pos").over(pair)).withColumn("e", F.lead("idx").over(pair)).where("state = 'S'")
    events = rows.where("kind = 'SYS'").groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: F.struct(F.lit("SYS").alias("kind"), x["raw"].alias("name"))).alias("all"))
    cut = F.coalesce(F.slice("all", F.col("idx") + 1, F.col("e") - F.col("idx")), F.array().cast(EMPTY_CALLS))
    inside = frames.join(events, "tid", "left").select("tid", F.col("name").alias("api"), F.col("e_pos").alias("seq"), cut.alias("calls"))
    return inside.unionByName(_outside(rows))


def knowledge_base(trace: DataFrame, inclusive: bool = False) -> DataFrame:
    """(tid, api, seq, calls): windows for well-nested threads, the stack machine for the others."""
    nested = well_nested(trace)
    native = (inclusive_nested if inclusive else exclusive_nested)(trace.join(nested.where("nested"), "tid", "left_semi"))
    exact = attribute_exact(trace.join(nested.where("NOT nested"), "tid", "left_semi"), inclusive)
    return native.unionByName(exact)


def merge(*kbs: DataFrame) -> DataFrame:
    """Knowledge bases of several threads or logs as one."""
    out = kbs[0]
    for kb in kbs[1:]:
        out = out.unionByName(kb)
    return out


def event_index_of(kb: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, apis): the APIs whose realizations have an event, for events in known (name) or all."""
    rows = kb.select("api", F.explode("calls").alias("c")).where("c.kind = 'SYS'").select("api", F.substring_index("c.name", "(", 1).alias("name")).distinct()
    if known is not None:
        rows = rows.join(known.select("name").distinct(), "name", "left_semi")
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("api")).alias("apis"))
