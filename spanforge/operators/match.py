"""Matching traces by models: first symbols join, longest matches win, and each next match begins where one ended."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.patterns import Machine

TIMEOUT = 5.0  # seconds for a match of one model at one place
MAX_MODELS = 500_000  # models (with a first symbol each) that go to the tasks at most: some 100 bytes a model
PREFIXES = 100  # lengths of prefixes that evaluations take

def candidates(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """(tid, s, e, api): at every position, each model's longest match there.

    encoded: tid, enc; models: api, model, first_sym. Positions join models on their first symbol, so Spark plans a
    hash join, and only then is the pattern tried.
    """
    at = encoded.select("tid", "enc", F.posexplode(F.filter(F.split("enc", ""), lambda c: c != "")).alias("s", "first_sym"))
    tried = at.join(models.select("api", "model", "first_sym"), "first_sym")
    size = F.length(F.expr("regexp_extract(substr(enc, s + 1), concat('^(?:', model, ')'), 0)"))
    return tried.select("tid", F.col("s").cast("long").alias("s"), (F.col("s") + size).cast("long").alias("e"), "api").where("e > s")


def best(found: DataFrame) -> DataFrame:
    """(tid, s, e, apis): the longest match at every position, with all APIs that reach it."""
    longest = found.groupBy("tid", "s").agg(F.max("e").alias("e"))
    return found.join(longest, ["tid", "s", "e"]).groupBy("tid", "s", "e").agg(F.array_sort(F.collect_set("api")).alias("apis"))


def chain(matches: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Matches that the scan from the left meets: a match counts if it begins at or after the last one's end.

    Starts and ends of a thread are folded in order; start (tid, first) is where a thread's scan begins.
    """
    ordered = matches.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("s", "e", "apis"))).alias("ms"))
    zero = F.lit(0).cast("long")
    ordered = ordered.withColumn("from", zero) if start is None else ordered.join(start, "tid", "left").withColumn("from", F.greatest(F.coalesce("first", zero), zero))

    def step(acc, m):
        taken = F.struct(m["e"].alias("end"), F.concat(acc["starts"], F.array(m["s"])).alias("starts"))
        return F.when(m["s"] >= acc["end"], taken).otherwise(acc)

    first = F.struct(F.col("from").alias("end"), F.array().cast("array<bigint>").alias("starts"))
    kept = ordered.select("tid", F.explode(F.aggregate("ms", first, step, lambda a: a["starts"])).alias("s"))
    return matches.join(kept, ["tid", "s"], "left_semi")


def munch(encoded: DataFrame, models: DataFrame, start: DataFrame | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """Maximal munch: (tid, s, e, apis).

    At each place every model's match is the one its pattern finds first, as a regular expression does; the longest of
    them wins. Up to MAX_MODELS models go to the tasks, which scan each string once, without a shuffle; more meet the
    positions in a join. A match that takes more than timeout seconds counts as none.
    """
    rows = models.select("api", "model", "first_sym").distinct().limit(MAX_MODELS + 1).collect()
    if len(rows) > MAX_MODELS:
        return chain(best(candidates(encoded, models)), start)
    given = [tuple(r) for r in rows]
    zero = F.lit(0).cast("long")
    strings = encoded.select("tid", "enc").withColumn("first", zero) if start is None else encoded.select("tid", "enc").join(start.select("tid", "first"), "tid", "left").withColumn("first", F.coalesce("first", zero))

    def run(batches):
        by_first = _by_first(given)
        for batch in batches:
            found = [(t, s, e, apis) for t, enc, first in zip(batch["tid"], batch["enc"], batch["first"], strict=True) for s, e, apis in _scan(enc or "", by_first, int(first), timeout)]
            yield pd.DataFrame(found, columns=["tid", "s", "e", "apis"])

    return strings.mapInPandas(run, f"tid {dict(encoded.dtypes)['tid']}, s long, e long, apis array<string>")


def _by_first(models: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, regex.Pattern]]]:
    found: dict[str, list[tuple[str, regex.Pattern]]] = {}
    for api, model, first in models:
        found.setdefault(first, []).append((api, regex.compile(model)))
    return found


def _end(pattern: regex.Pattern, text: str, at: int, timeout: float) -> int:
    """Where the pattern's match at a place ends; -1 without one, or when it takes too long."""
    try:
        m = pattern.match(text, at, timeout=timeout)
    except TimeoutError:
        return -1
    return m.end() if m else -1


def _scan(text: str, by_first: dict[str, list[tuple[str, regex.Pattern]]], start: int, timeout: float) -> list[tuple[int, int, list[str]]]:
    out, at = [], max(start, 0)
    while at < len(text):
        ends = [(_end(p, text, at, timeout), api) for api, p in by_first.get(text[at], [])]
        end = max((e for e, _ in ends), default=-1)
        if end > at:
            out.append((at, end, sorted({api for e, api in ends if e == end})))
            at = end
        else:
            at += 1
    return out


def munch_one(text: str, models: list[tuple[str, str, str]], start: int = 0, timeout: float = TIMEOUT) -> list[tuple[int, int, list[str]]]:
    """Maximal munch of one string by models (api, model, first symbol)."""
    return _scan(text, _by_first(models), start, timeout)


@lru_cache(maxsize=4096)
def _machine(text: str) -> Machine:
    return Machine(text)


def _hits(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """Pairs of a thread and a model whose symbols it has: joined on the model's first symbol."""
    chars = encoded.select("tid", "enc", F.explode(F.array_distinct(F.filter(F.split("enc", ""), lambda c: c != ""))).alias("first_sym"))
    return chars.join(models.select("api", "model", "first_sym"), "first_sym").drop("first_sym")


def full_matches(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """(tid, api, model) of models that match a whole string."""
    at = encoded.select("tid", "enc", F.substring("enc", 1, 1).alias("first_sym"))
    return at.join(models.select("api", "model", "first_sym"), "first_sym").where(F.expr("enc RLIKE concat('^(?:', model, ')$')")).select("tid", "api", "model")


def searches(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """(tid, api, model, s, e) of the leftmost occurrence."""
    hit = _hits(encoded, models).withColumn("at", F.expr("regexp_instr(enc, model)")).where("at > 0")
    return hit.select("tid", "api", "model", (F.col("at") - 1).cast("long").alias("s"), (F.col("at") - 1 + F.length(F.expr("regexp_substr(enc, model)"))).cast("long").alias("e"))


def occurrences(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """(tid, api, model, n): non-overlapping occurrences."""
    return _hits(encoded, models).withColumn("n", F.expr("regexp_count(enc, model)").cast("long")).where("n > 0").select("tid", "api", "model", "n")


def occurrence_spans(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """(tid, api, model, s, e) of all non-overlapping occurrences: lengths of what lies between and of the matches, summed up."""

    def run(batches):
        for batch in batches:
            rows = [(t, a, m, s, e) for t, enc, a, m in zip(batch["tid"], batch["enc"], batch["api"], batch["model"], strict=True) for s, e in _machine(m).spans(enc)]
            yield pd.DataFrame(rows, columns=["tid", "api", "model", "s", "e"])

    return _hits(encoded, models).select("tid", "enc", "api", "model").mapInPandas(run, f"tid {dict(encoded.dtypes)['tid']}, api string, model string, s long, e long")


def prefixes(encoded: DataFrame, stop: int) -> DataFrame:
    """(tid, k, enc): every string's prefixes of lengths 1 to stop; a shorter string has no more than its length."""
    return encoded.select("tid", "enc", F.explode(F.sequence(F.lit(1), F.lit(stop))).alias("k")).where(F.length("enc") >= F.col("k")).select("tid", "k", F.substr("enc", F.lit(1), F.col("k")).alias("enc"))


def prefix_counts(encoded: DataFrame, models: DataFrame, stop: int = PREFIXES) -> DataFrame:
    """(k, n_full, n_search, n_all): over prefixes of each length, model matches of the whole, anywhere, and in all."""
    tried = _hits(prefixes(encoded, stop).select(F.struct("tid", "k").alias("tid"), "enc"), models)
    counted = tried.select(F.col("tid.k").alias("k"), F.expr("enc RLIKE concat('^(?:', model, ')$')").alias("full"), F.expr("regexp_count(enc, model)").alias("n"))
    return counted.groupBy("k").agg(F.count_if("full").alias("n_full"), F.count_if(F.col("n") > 0).alias("n_search"), F.sum("n").cast("long").alias("n_all"))


def match_order_violations(encoded: DataFrame, models: DataFrame, stop: int = PREFIXES) -> DataFrame:
    """(tid, api): whole matches of a prefix that a search in it would not find, and searches that find-all would not."""
    p = prefixes(encoded, stop).select(F.struct("tid", "k").alias("tid"), "enc")
    full, search, every = full_matches(p, models).select("tid", "api"), searches(p, models).select("tid", "api"), occurrences(p, models).select("tid", "api")
    return full.distinct().exceptAll(search.distinct()).unionByName(search.distinct().exceptAll(every.distinct()))


def expected_ratio(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(ratio): the share of predicted (s, e, api) that is expected; null without predictions."""
    p, e = predicted.select("s", "e", "api"), expected.select("s", "e", "api").distinct().withColumn("ok", F.lit(1))
    joined = p.join(e, ["s", "e", "api"], "left")
    return joined.agg((F.count("ok") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("ratio"))


def overlapping(kb: DataFrame) -> DataFrame:
    """(api, other, rid): other APIs' non-empty realizations without API calls that equal a sequence of events of this API.

    Sequences of this API are distinct, so its copies add no rows; those of the others stay.
    """
    names = F.array_join(F.transform("calls", lambda c: c["name"]), "|")
    flat = kb.where("size(calls) > 0").where(~F.exists("calls", lambda c: c["kind"] == "API"))
    mine = kb.withColumn("calls", F.filter("calls", lambda c: c["kind"] == "SYS")).where("size(calls) > 0").select("api", names.alias("seq")).distinct()
    others = flat.select(F.col("api").alias("other"), "rid", names.alias("seq"))
    return mine.join(others, "seq").where("api <> other").select("api", "other", "rid")


__all__ = ["best", "candidates", "chain", "expected_ratio", "full_matches", "match_order_violations", "munch", "munch_one", "occurrence_spans", "occurrences", "overlapping", "prefix_counts", "prefixes", "searches"]
