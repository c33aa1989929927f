"""Scores of matches: accuracy, coverage, length, ambiguity and its distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scalars import roll_up
from spanforge.operators.pairing import union_spans


def hit_miss(spans: DataFrame, matches: DataFrame, leaf: DataFrame | None = None) -> DataFrame:
    """(tid, hits, misses): spans (tid, s, e, api) that a match (tid, s, e, apis) labels exactly, and the others.

    leaf (api) restricts spans to APIs that have a leaf model.
    """
    judged = spans if leaf is None else spans.join(leaf.select("api").distinct(), "api", "left_semi")
    ok = F.coalesce(F.array_contains("apis", F.col("api")), F.lit(False))
    return judged.join(matches, ["tid", "s", "e"], "left").groupBy("tid").agg(F.count_if(ok).alias("hits"), F.count_if(~ok).alias("misses"))


def hit_classes(spans: DataFrame, matches: DataFrame, leaf: DataFrame) -> DataFrame:
    """(tid, good, bad, not_found, not_bad): right label; wrong label of an API with a leaf model; span not matched; no leaf model."""
    known = leaf.select("api").distinct().withColumn("leaf", F.lit(True))
    j = spans.join(matches, ["tid", "s", "e"], "left").join(known, "api", "left")
    right = F.col("apis").isNotNull() & F.coalesce(F.array_contains("apis", F.col("api")), F.lit(False))
    has = F.col("leaf").isNotNull()
    return j.groupBy("tid").agg(
        F.count_if(right).alias("good"), F.count_if(F.col("apis").isNotNull() & ~right & has).alias("bad"), F.count_if(F.col("apis").isNull() & has).alias("not_found"), F.count_if(~right & ~has).alias("not_bad")
    )


def correct_spans(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """Spans that are matched exactly by their own API."""
    labels = matches.select("tid", "s", "e", F.explode("apis").alias("api"))
    return spans.select("tid", "s", "e", "api").join(labels, ["tid", "s", "e", "api"], "left_semi")


def span_coverage(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """(tid, covered, total, ratio): length under correct matches over length under any call; null ratio without calls."""
    size = lambda df, name: union_spans(df).groupBy("tid").agg(F.sum(F.col("e") - F.col("s")).alias(name))
    j = size(spans.select("tid", "s", "e"), "total").join(size(correct_spans(spans, matches).select("tid", "s", "e"), "covered"), "tid", "left")
    j = j.withColumn("covered", F.coalesce("covered", F.lit(0)))
    return j.withColumn("ratio", F.col("covered") / F.nullif("total", F.lit(0)))


def match_length(matches: DataFrame) -> DataFrame:
    """(tid, mean): mean length of a thread's matches."""
    return matches.groupBy("tid").agg(F.avg(F.col("e") - F.col("s")).alias("mean"))


def corpus_averages(coverage: DataFrame, hits: DataFrame) -> DataFrame:
    """Unweighted mean coverage over threads, and all hits over all spans."""
    none = F.lit(None).cast("bigint")
    rows = coverage.select("ratio", none.alias("hits"), none.alias("misses")).unionByName(hits.select(F.lit(None).cast("double").alias("ratio"), "hits", "misses"))
    return rows.agg(F.avg("ratio").alias("coverage"), (F.sum("hits") / F.nullif(F.sum(F.col("hits") + F.col("misses")), F.lit(0))).alias("correct"))


def coverage_steps(outermost: DataFrame) -> DataFrame:
    """(tid, x, y): 1 from a span's start, 0 from its end; at a shared boundary the later span's value stays."""
    points = outermost.select("tid", F.explode(F.array(F.struct(F.col("s").alias("x"), F.lit(1).alias("y"), F.col("s").alias("o")), F.struct(F.col("e").alias("x"), F.lit(0).alias("y"), F.col("s").alias("o")))).alias("p"))
    return points.groupBy("tid", F.col("p.x").alias("x")).agg(F.max_by("p.y", F.struct(F.col("p.o"), F.col("p.y"))).alias("y"))


def trace_ambiguity(matches: DataFrame, scopes: tuple[str, ...] = ("full", "method", "class", "package")) -> DataFrame:
    """(tid, scope, ambiguity, log10): the product of the numbers of distinct APIs of a thread's matches, and its logarithm."""
    rows = matches.select("tid", "s", F.explode("apis").alias("api"))
    out = None
    for scope in scopes:
        k = rows.groupBy("tid", "s").agg(F.count_distinct(roll_up(F.col("api"), scope)).alias("k"))
        part = k.groupBy("tid").agg(F.product(F.col("k").cast("double")).alias("ambiguity"), F.sum(F.log10("k")).alias("log10")).select("tid", F.lit(scope).alias("scope"), "ambiguity", "log10")
        out = part if out is None else out.unionByName(part)
    return out


def _windows(enc: Column, sizes: list[int]) -> Column:
    """All windows of the given lengths."""
    of = lambda n: F.when(F.length(enc) >= n, F.transform(F.sequence(F.lit(1), F.length(enc) - n + 1), lambda i: F.substr(enc, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in sizes])


def ngram_counts(encoded: DataFrame, labels: DataFrame) -> DataFrame:
    """(ngram, n, freq): non-overlapping occurrences of labelled n-grams (ngram) in all strings.

    Windows are counted by their text in one scan, and only counts meet the labels. An n-gram that can overlap itself
    (one that ends as it begins) is counted from the left in each string that has it instead.
    """
    grams = labels.select("ngram").distinct().withColumn("n", F.length("ngram"))
    sizes = sorted(r[0] for r in grams.select("n").distinct().collect() if r[0])
    if not sizes:
        return grams.select("ngram", "n", F.lit(0).cast("long").alias("freq")).limit(0)
    border = F.exists(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda k: (k < F.col("n")) & (F.substr("ngram", F.lit(1), k) == F.substr("ngram", F.col("n") - k + 1, k)))
    grams = grams.withColumn("border", border)
    counted = encoded.select(F.explode(_windows(F.col("enc"), sizes)).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("freq"))
    plain = counted.join(grams.where("NOT border"), "ngram").select("ngram", "n", "freq")
    inside = encoded.select("enc", F.explode(F.array_distinct(_windows(F.col("enc"), [n for n in sizes if n > 1]))).alias("ngram")) if sizes[-1] > 1 else None
    if inside is None:
        return plain
    times = ((F.length("enc") - F.length(F.replace("enc", F.col("ngram"), F.lit("")))) / F.col("n")).cast("long")
    again = inside.join(grams.where("border"), "ngram").groupBy("ngram", "n").agg(F.sum(times).cast("long").alias("freq"))
    return plain.unionByName(again)


def ngram_ambiguity(encoded: DataFrame, labels: DataFrame, scope: str = "full") -> DataFrame:
    """(ngram, n, n_apis, freq, effective): distinct APIs (at a scope) of each n-gram in labels (ngram, api), its frequency, and (n_apis - 1) * freq."""
    k = labels.groupBy("ngram").agg(F.count_distinct(roll_up(F.col("api"), scope)).alias("n_apis"))
    j = k.join(ngram_counts(encoded, labels), "ngram", "left").withColumn("freq", F.coalesce("freq", F.lit(0))).withColumn("n", F.length("ngram"))
    return j.select("ngram", "n", "n_apis", "freq", ((F.col("n_apis") - 1) * F.col("freq")).alias("effective"))


def unmatched_starts(encoded: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(unmatched): positions of all strings at which no labelled n-gram of length n begins."""
    grams = labels.where(F.length("ngram") == n).select("ngram").distinct().withColumn("hit", F.lit(1))
    at = encoded.where(F.length("enc") >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("enc") - n + 1), lambda i: F.substr("enc", i, F.lit(n)))).alias("ngram"))
    return at.join(grams, "ngram", "left").agg((F.count(F.lit(1)) - F.count("hit")).alias("unmatched"))


def hist(ambiguity: DataFrame) -> DataFrame:
    """(n, k, count): n-grams by number of APIs, dense from 0."""
    top = ambiguity.groupBy("n").agg(F.max("n_apis").alias("top")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("k"))
    counts = ambiguity.groupBy("n", F.col("n_apis").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return top.join(counts, ["n", "k"], "left").select("n", "k", F.coalesce("c", F.lit(0)).alias("count"))


def _scaled(rows: DataFrame, value: str) -> DataFrame:
    run = Window.partitionBy("n").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("n")
    cum = F.sum(value).over(run)
    return rows.select("n", "k", cum.cast("long").alias("cum"), (100.0 * cum / F.nullif(F.sum(value).over(whole), F.lit(0))).alias("scaled"))


def cdf(ambiguity: DataFrame) -> DataFrame:
    """(n, k, cum, scaled): cumulative histogram, and to 100."""
    return _scaled(hist(ambiguity), "count")


def fullcdf(ambiguity: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(n, k, cum, scaled): frequencies by ambiguity, with unmatched (n, unmatched) positions at 0, cumulative and to 100."""
    rows = ambiguity.groupBy("n", F.col("n_apis").alias("k")).agg(F.sum("freq").alias("freq"))
    zero = unmatched.select("n", F.lit(0).cast("long").alias("k"), F.col("unmatched").alias("freq"))
    return _scaled(rows.unionByName(zero).groupBy("n", "k").agg(F.sum("freq").alias("freq")), "freq")
