"""Cleaning of traces (tid, pos, kind, state, name, raw) and of knowledge bases (api, rid, calls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from spanforge.functions.scalars import NOISY, TRIMMED


def _order() -> WindowSpec:
    return Window.partitionBy("tid").orderBy("pos")


_MMAP = r"^mmap2?\(.*PROT_READ\|PROT_WRITE, MAP_PRIVATE\|MAP_ANONYMOUS\|MAP_NORESERVE, -1, 0.*= (0x[a-f\d]+)"
_PRCTL = r'^prctl\(PR_SET_VMA, PR_SET_VMA_ANON_NAME, (0x[a-f\d]+).*"libc_malloc"'
_MUNMAP = r"^munmap\((0x[a-f\d]+),.*\)"
EMPTY_CALLS = "array<struct<kind:string,name:string>>"


def drop_names(trace: DataFrame, names: tuple[str, ...] = NOISY) -> DataFrame:
    """Without the events of these names; calls stay."""
    return trace.where((F.col("kind") != "SYS") | ~F.col("name").isin(*names))


def drop_allocator(trace: DataFrame) -> DataFrame:
    """Without the allocator's idiom: an anonymous mapping, its naming, and an unmapping of it with one more after that.

    The pattern is by position, so a call's start or end in between keeps it. Windows over three rows ahead are exact:
    a mapping is never one of the rows that another pattern drops.
    """
    raw = lambda i: F.lead("raw", i).over(_order())
    at = F.regexp_extract("raw", _MMAP, 1)
    named = (F.col("kind") == "SYS") & (at != "") & (F.regexp_extract(raw(1), _PRCTL, 1) == at)
    freed = named & (F.regexp_extract(raw(2), _MUNMAP, 1) == at)
    more = freed & F.contains(raw(3), F.lit("munmap"))
    size = F.when(F.coalesce(more, F.lit(False)), 4).when(F.coalesce(freed, F.lit(False)), 3).when(F.coalesce(named, F.lit(False)), 2).otherwise(0)
    sized = trace.withColumn("__n", size)
    hit = F.lit(False)
    for back in range(4):
        hit = hit | (F.coalesce(F.lag("__n", back).over(_order()), F.lit(0)) > back)
    return sized.withColumn("__hit", hit).where(~F.col("__hit")).drop("__n", "__hit")


def drop_signal_blocks(trace: DataFrame) -> DataFrame:
    """Without what lies from a signal (but SIGCHLD) to the next rt_sigreturn, both included; an open block drops the rest."""
    is_start = (F.col("kind") == "SYS") & F.col("raw").startswith("--- SIG") & ~F.col("raw").startswith("--- SIGCHLD")
    is_end = (F.col("kind") == "SYS") & (F.col("name") == "rt_sigreturn")
    mark = F.when(is_start, 1).when(is_end, 0)
    before = F.coalesce(F.last(mark, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return trace.withColumn("__in", F.when(is_start, 1).otherwise(before)).where("__in = 0").drop("__in")


def drop_signals(kb: DataFrame) -> DataFrame:
    """Realizations without any signal line."""
    return kb.withColumn("calls", F.filter("calls", lambda c: ~c["name"].startswith("--- SIG")))


def trim(trace: DataFrame) -> DataFrame:
    """Allocator idioms and signal blocks, then the two noisiest events."""
    return drop_names(drop_signal_blocks(drop_allocator(trace)), TRIMMED)


def remove_noise(trace: DataFrame, names: tuple[str, ...] = NOISY, compat_dup_head: bool = False) -> DataFrame:
    """Noisy events, then allocator idioms. compat_dup_head repeats each thread's first row, as a known fault does."""
    kept = drop_allocator(drop_names(trace, names))
    if not compat_dup_head:
        return kept
    first = drop_names(trace, names).withColumn("__k", F.row_number().over(_order())).where("__k = 1").drop("__k")
    return first.withColumn("pos", F.col("pos") - 1).unionByName(kept)


def explode_kb(kb: DataFrame) -> DataFrame:
    """A row for each call of each realization, as a trace whose threads are realizations."""
    return kb.select("api", "rid", F.posexplode("calls").alias("i", "c")).select("api", "rid", F.struct("api", "rid").alias("tid"), F.col("i").alias("pos"), F.col("c.kind").alias("kind"), F.substring_index("c.name", "(", 1).alias("name"), F.col("c.name").alias("raw"))


def regroup(kb: DataFrame, rows: DataFrame) -> DataFrame:
    """kb with the calls that are left in rows; realizations that lost all stay, empty."""
    calls = rows.groupBy("api", "rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "raw"))), lambda x: F.struct(x["kind"].alias("kind"), x["raw"].alias("name"))).alias("calls"))
    return kb.select("api", "rid").join(calls, ["api", "rid"], "left").select("api", "rid", F.coalesce("calls", F.array().cast(EMPTY_CALLS)).alias("calls"))


def prune_kb(kb: DataFrame) -> DataFrame:
    """Realizations without allocator idioms, signal blocks and noisy events; names lose their arguments."""
    rows = drop_names(drop_signal_blocks(drop_allocator(explode_kb(kb))))
    return regroup(kb, rows.withColumn("raw", F.when(F.col("kind") == "SYS", F.col("name")).otherwise(F.col("raw"))))


def drop_callees(kb: DataFrame, empties: DataFrame) -> DataFrame:
    """Realizations without calls to the given APIs (api); realizations stay even when empty."""
    rows = explode_kb(kb)
    gone = empties.select(F.col("api").alias("raw")).distinct()
    return regroup(kb, rows.join(gone, "raw", "left_anti"))


def drop_hanging(kb: DataFrame) -> DataFrame:
    """Realizations without calls to APIs that the knowledge base doesn't have."""
    rows = explode_kb(kb)
    known = kb.select(F.col("api").alias("raw")).distinct()
    calls = rows.where("kind = 'API'").join(known, "raw", "left_semi")
    return regroup(kb, calls.unionByName(rows.where("kind <> 'API'")))


def drop_modelless(trace: DataFrame, models: DataFrame) -> DataFrame:
    """Without starts and ends of APIs that have no model (api)."""
    known = models.where("api IS NOT NULL").select(F.col("api").alias("name")).distinct()
    return trace.where("kind = 'API'").join(known, "name", "left_semi").unionByName(trace.where("kind <> 'API'").select("name", *[c for c in trace.columns if c != "name"])).select(*trace.columns)


def drop_calls(trace: DataFrame) -> DataFrame:
    return trace.where("kind = 'SYS'")


def drop_java(lines: DataFrame) -> DataFrame:
    return lines.where(~F.contains(F.col("value"), F.lit("JAVA")))


def first_api(trace: DataFrame) -> DataFrame:
    """(tid, first): position of each thread's first call, -1 without one."""
    return trace.groupBy("tid").agg(F.coalesce(F.min(F.when(F.col("kind") == "API", F.col("pos"))), F.lit(-1)).cast("long").alias("first"))


def shuffle(kb: DataFrame, seed: int) -> DataFrame:
    """Realizations in a random order that the seed decides."""
    return kb.orderBy(F.xxhash64(F.lit(seed), "api", "rid"))


def is_unfinished(raw: Column) -> Column:
    return raw.rlike(r" [<]?unfinished \.\.\.>")


def is_resumed(raw: Column) -> Column:
    return raw.rlike(r"<\.\.\. \S+ resumed>")
