"""Whole runs: from logs to a knowledge base, from that to models, and from traces and models to scores."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import asof, attribute, callgraph, clean, learn, match, pairing, score, symbols
from spanforge.sources import logs, store

CARRIER = r"^ioctl\(\d+<.*binder.*>"


def typed_events(spark: SparkSession, path: str) -> DataFrame:
    """(ts, kind, tid, state, name) of raw logs: lines are mended, parsed and typed; what is neither mark nor event is dropped."""
    whole = logs.straighten(logs.read_lines(spark, path).select("value"))
    parsed = whole.select(logs.parse_strace(F.col("value")).alias("e")).where("e IS NOT NULL").select("e.*")
    return parsed.select("ts", F.when(F.col("kind") == "JAVA", "API").otherwise("SYS").alias("kind"), "tid", "state", F.col("payload").alias("name"))


def with_services(events: DataFrame, services: DataFrame) -> DataFrame:
    """A trace in which service calls (tid, ts, name) take the place of the events that carried them."""
    trace = logs.as_trace(events)
    name = F.when((F.col("kind") == "SYS") & F.col("raw").rlike(CARRIER), "carrier").otherwise(F.col("raw"))
    replaced, _ = asof.replace_carriers(trace.select("tid", "ts", "pos", name.alias("name")), services, "carrier")
    now = replaced.select("tid", "pos", F.nullif("name", F.lit("carrier")).alias("now"))
    return trace.join(now, ["tid", "pos"]).withColumn("raw", F.coalesce("now", "raw")).drop("now")


def build_kb(spark: SparkSession, path: str, tree: bool = True, services: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """(tid, api, seq, calls) of raw logs; tree attributes exclusively. With out it is appended there, and the whole table is returned."""
    events = typed_events(spark, path)
    trace = logs.as_trace(events) if services is None else with_services(events, services)
    kb = attribute.knowledge_base(trace, inclusive=not tree)
    if out is None:
        return kb
    store.dump(kb, out, "append")
    return store.load(spark, out)


def rid_kb(kb: DataFrame) -> DataFrame:
    """(api, rid, calls): realizations numbered by thread and order."""
    return kb.select("api", F.xxhash64("tid", "seq").alias("rid"), "calls")


def first_run(kb: DataFrame) -> dict[str, DataFrame]:
    """All classifications of a knowledge base, the pruned one, its alphabet, and broken rules."""
    pruned = clean.prune_kb(kb)
    precise, implicit = callgraph.precise_models(pruned), callgraph.implicit_models(pruned)
    names = pruned.select(F.explode("calls").alias("c")).select("c.name", "c.kind").distinct()
    return {
        "flags": callgraph.all_flags(pruned),
        "contingency": callgraph.contingency(pruned),
        "precise": precise,
        "implicit": implicit,
        "violations": callgraph.invariant_violations(pruned, precise, implicit),
        "kb": callgraph.without_empties(pruned),
        "symbols": symbols.alphabet(names),
    }


def create_models(kb: DataFrame, syms: DataFrame, kind: str = "less_generic") -> tuple[DataFrame, DataFrame]:
    """(models, stats) of a knowledge base without signal lines."""
    return learn.build_models(symbols.encode_calls(clean.drop_signals(kb), syms), kind)


def analyse(trace: DataFrame, models: DataFrame, syms: DataFrame) -> dict[str, DataFrame]:
    """Matches of a trace by leaf models, hits, coverage and mean length. Spans and matches share one numbering."""
    known = trace.where("kind = 'API'").unionByName(trace.where("kind = 'SYS'").join(syms.select("name").distinct(), "name", "left_semi").select(*trace.columns))
    cleaned = clean.remove_noise(known)
    spans = pairing.lifo_spans(cleaned)
    leaf = models.join(learn.syscall_only(models, syms), ["api", "model"], "left_semi")
    matches = match.munch(symbols.encode(clean.drop_calls(cleaned), syms), leaf)
    return {"matches": matches, "hits": score.hit_miss(spans, matches), "coverage": score.span_coverage(spans, matches), "length": score.match_length(matches)}


def ambiguity_of(trace: DataFrame, models: DataFrame, syms: DataFrame) -> DataFrame:
    """(tid, scope, ambiguity, log10) of trimmed threads, scanned from their first call on."""
    trimmed = clean.trim(trace)
    events = pairing.event_index(trimmed)
    start = events.where("kind = 'API'").groupBy("tid").agg(F.min("idx").alias("first"))
    return score.trace_ambiguity(match.munch(symbols.encode(clean.drop_calls(trimmed), syms), models, start))


def dump_ambiguity(ambiguity: DataFrame, path: str) -> None:
    """A line for each n-gram, the most effective ambiguity first, with the APIs beyond one."""
    store.dump_report(ambiguity, path, "concat_ws(' ', ngram, n_apis - 1, freq, effective)", F.col("effective").desc(), "ngram")


def dump_matches(labels: DataFrame, path: str) -> None:
    """A line for each n-gram with its APIs, in order."""
    store.dump_report(labels.groupBy("ngram").agg(F.array_join(F.array_sort(F.collect_set("api")), ",").alias("apis")), path, "concat_ws(' ', ngram, apis)", "ngram")


def main(args: list[str] | None = None) -> None:
    """traces... --no-tree --services TABLE --out TABLE"""
    parser = argparse.ArgumentParser(description="Build a knowledge base from trace logs.")
    parser.add_argument("traces", nargs="+")
    parser.add_argument("--no-tree", action="store_true")
    parser.add_argument("--services")
    parser.add_argument("--out", required=True)
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    for path in given.traces:
        build_kb(spark, path, not given.no_tree, store.load(spark, given.services) if given.services else None, given.out)


if __name__ == "__main__":
    main()
