"""Predicates over the calls of a knowledge base (api, rid, calls), direct and transitive.

Transitive ones are the true closure, also under cycles: a frontier of APIs grows along edges until nothing is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.scalars import sequence_key
from spanforge.plans.lineage import cut

#: Events that a flat model leaves out, or that rule a realization out.
UNSTABLE = ("futex", "madvise")


def edges(kb: DataFrame) -> DataFrame:
    """(src, dst) of every API call."""
    return kb.select(F.col("api").alias("src"), F.explode("calls").alias("c")).where("c.kind = 'API'").select("src", F.col("c.name").alias("dst")).distinct()


def flags(kb: DataFrame) -> DataFrame:
    """(api, leaf, polymorph, empty, direct_sys, n): calls no API, has different realizations, has none but empty ones, makes an event."""
    has = lambda kind: F.exists("calls", lambda c: c["kind"] == kind)
    return kb.groupBy("api").agg(
        (~F.bool_or(has("API"))).alias("leaf"),
        (F.count_distinct(sequence_key(F.col("calls"))) > 1).alias("polymorph"),
        (F.max(F.size("calls")) == 0).alias("empty"),
        F.bool_or(has("SYS")).alias("direct_sys"),
        F.count(F.lit(1)).alias("n"),
    )


def reaching(graph: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(api): the seeds, and what reaches one along edges (src, dst). Each round only follows what the last one added."""
    found = cut(seeds.select("api").distinct())
    front = found
    for _ in range(max_rounds):
        front = cut(graph.join(front.withColumnRenamed("api", "dst"), "dst", "left_semi").select(F.col("src").alias("api")).distinct().join(found, "api", "left_anti"))
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front))
    raise RuntimeError("the call graph's closure did not settle")


def indirect_sys(kb: DataFrame) -> DataFrame:
    """(api): those that make an event themselves or through callees."""
    return reaching(edges(kb), flags(kb).where("direct_sys"))


def weak_polymorph(kb: DataFrame) -> DataFrame:
    """(api): those that are polymorphic or reach one that is, among APIs of the knowledge base."""
    return reaching(edges(kb), flags(kb).where("polymorph")).join(kb.select("api").distinct(), "api", "left_semi")


def all_flags(kb: DataFrame) -> DataFrame:
    """flags() with indirect_sys and weak."""
    yes = lambda df, name: df.withColumn(name, F.lit(True))
    joined = flags(kb).join(yes(indirect_sys(kb), "indirect_sys"), "api", "left").join(yes(weak_polymorph(kb), "weak"), "api", "left")
    return joined.fillna(False, ["indirect_sys", "weak"])


def contingency(kb: DataFrame) -> DataFrame:
    """Counts by direct or indirect events, leaf and polymorph, in all grouping sets of leaf and polymorph; null is a total."""
    f = all_flags(kb)
    out = None
    for measure in ("direct_sys", "indirect_sys"):
        part = f.withColumn("has", F.col(measure)).groupingSets([["has", "leaf", "polymorph"], ["has", "leaf"], ["has", "polymorph"], ["has"]], "has", "leaf", "polymorph").agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(measure).alias("measure"), "has", "leaf", "polymorph", "n")
        out = part if out is None else out.unionByName(part)
    return out


def invariant_violations(kb: DataFrame, precise: DataFrame, implicit: DataFrame) -> DataFrame:
    """(rule, api) that break: no indirect event without no direct one, polymorph is weak, precise models are implicit, empty APIs have a precise model."""
    f = all_flags(kb)
    return (
        f.where("NOT indirect_sys AND direct_sys").select(F.lit("no_indirect_is_no_direct").alias("rule"), "api")
        .unionByName(f.where("polymorph AND NOT weak").select(F.lit("polymorph_is_weak").alias("rule"), "api"))
        .unionByName(precise.select("api").exceptAll(implicit.select("api")).select(F.lit("precise_is_implicit").alias("rule"), "api"))
        .unionByName(f.where("empty").select("api").exceptAll(precise.select("api")).select(F.lit("empty_is_precise").alias("rule"), "api"))
    )


def _unstable(name: Column) -> Column:
    return name.isin(*UNSTABLE) | name.startswith("--- SIGCHLD")


def _flattened(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(api, rid, flat) of realizations whose callees all have a model; rows: api, rid, pos, kind, name."""
    joined = rows.join(models.select(F.col("api").alias("name"), F.col("flat").alias("inner")), "name", "left")
    piece = F.when(F.col("pos").isNull(), F.array().cast("array<string>")).when(F.col("kind") == "SYS", F.array("name")).otherwise(F.col("inner"))
    grouped = joined.withColumn("piece", piece).groupBy("api", "rid").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("ps"), F.count_if(F.col("piece").isNull()).alias("open"))
    return grouped.where("open = 0").select("api", "rid", F.flatten(F.transform("ps", lambda p: p["piece"])).alias("flat"))


def _call_rows(kb: DataFrame) -> DataFrame:
    """A row for each call, and one with null position for an empty realization."""
    return kb.select("api", "rid", F.posexplode_outer("calls").alias("pos", "c")).select("api", "rid", "pos", F.col("c.kind").alias("kind"), F.substring_index("c.name", "(", 1).alias("short"), F.col("c.name").alias("raw")).withColumn("name", F.when(F.col("kind") == "SYS", F.col("short")).otherwise(F.col("raw"))).drop("short", "raw")


def precise_models(kb: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(api, flat) of strong monomorphs: their first realization with callees' models in place, unstable events left out.

    Models are made bottom-up; an API in or above a cycle has none.
    """
    strong = kb.select("api").distinct().join(weak_polymorph(kb), "api", "left_anti")
    first = kb.join(strong, "api", "left_semi").groupBy("api").agg(F.min_by("calls", "rid").alias("calls"), F.min("rid").alias("rid"))
    whole = _call_rows(first)
    kept = whole.where("pos IS NULL OR kind <> 'SYS'").unionByName(whole.where("kind = 'SYS'").where(~_unstable(F.col("name"))))
    bare = first.select("api", "rid").join(kept, ["api", "rid"], "left_anti").select("api", "rid", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))
    rows = cut(kept.unionByName(bare))
    models = cut(_flattened(rows.where("1 = 0"), rows.select("api", F.array("name").alias("flat")).where("1 = 0")).select("api", "flat"))
    for _ in range(max_rounds):
        todo = rows.join(models, "api", "left_anti")
        new = cut(_flattened(todo, models).select("api", "flat"))
        if new.isEmpty():
            return models
        models = cut(models.unionByName(new))
    raise RuntimeError("precise models did not settle")


def implicit_models(kb: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(api, flat) of APIs all of whose expandable realizations flatten to one sequence.

    Realizations that call their own API, one without realizations, or make unstable events are skipped. An API with a
    callee that has no model has none, and neither do those in or above cycles.
    """
    rows = _call_rows(kb)
    known = kb.select(F.col("api").alias("name")).distinct().withColumn("known", F.lit(True))
    judged = rows.join(known, "name", "left")
    bad = F.coalesce(((F.col("kind") == "API") & (F.col("known").isNull() | (F.col("name") == F.col("api")))) | ((F.col("kind") == "SYS") & _unstable(F.col("name"))), F.lit(False))
    skipped = judged.where(bad).select("api", "rid").distinct()
    rows = cut(rows.join(skipped, ["api", "rid"], "left_anti"))
    apis = rows.groupBy("api").agg(F.count_distinct("rid").alias("n"))
    models = cut(rows.select("api", F.array("name").alias("flat")).where("1 = 0"))
    for _ in range(max_rounds):
        todo = rows.join(models, "api", "left_anti")
        flat = _flattened(todo, models).groupBy("api").agg(F.count(F.lit(1)).alias("got"), F.collect_set("flat").alias("flats"))
        new = cut(flat.join(apis, "api").where("got = n AND size(flats) = 1").select("api", F.col("flats")[0].alias("flat")))
        if new.isEmpty():
            return models
        models = cut(models.unionByName(new))
    raise RuntimeError("implicit models did not settle")


def without_empties(kb: DataFrame) -> DataFrame:
    """kb without calls to APIs whose implicit model is empty, and then without calls to what it doesn't have."""
    from spanforge.operators.clean import drop_callees, drop_hanging

    return drop_hanging(drop_callees(kb, implicit_models(kb).where("size(flat) = 0")))


def cycles(graph: DataFrame) -> DataFrame:
    """(api, length): APIs on a cycle, and the length of their shortest one.

    Walks are kept as pairs of their ends, met first, so that rows and rounds are bounded by the pairs of APIs.
    """
    walks = cut(graph.select(F.col("src").alias("api"), F.col("dst").alias("at")).distinct())
    seen = walks.withColumn("k", F.lit(1))
    step = graph.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    k = 1
    while True:
        k += 1
        walks = cut(walks.join(step, "at").select("api", F.col("to").alias("at")).distinct().join(seen, ["api", "at"], "left_anti"))
        if walks.isEmpty():
            break
        seen = cut(seen.unionByName(walks.withColumn("k", F.lit(k))))
    return seen.where("api = at").groupBy("api").agg(F.min("k").alias("length"))
