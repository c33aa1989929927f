"""Queries of the trace engine over the star-schema tables: every operator, with columns aliased and typed."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import scalars as S
from spanforge.operators import asof, attribute, callgraph, clean, learn, match, pairing, score, symbols
from spanforge.operators import patterns as P
from spanforge.plans import pipelines
from spanforge.sources import adapters as A
from spanforge.sources import logs

#: Models of the events queries, in names; symbols replace them.
EVENT_MODELS = [
    ("pkg.A.click_view()", "click+ view"),
    ("pkg.A.view_error()", "( view error )+"),
    ("pkg.B.view()", "view"),
    ("pkg.B.error()", "error+"),
    ("org.C.sign()", "signup purchase"),
    ("org.C.click()", "click"),
    ("org.D.signs()", "signup+"),
]
#: Models of the orders queries.
ORDER_MODELS = [
    ("pkg.Order.1URGENT()", "RO+ AF"),
    ("pkg.Order.1URGENT()", "NO"),
    ("pkg.Order.2HIGH()", "( AO | RF )+"),
    ("pkg.Order.2HIGH()", "NO"),
    ("pkg.Order.3MEDIUM()", "NF+"),
    ("pkg.Order.3MEDIUM()", "RO RO"),
    ("pkg.Order.4NOTSPECIFIED()", "AF AO RF"),
    ("pkg.Order.5LOW()", "RO+ AF"),
    ("pkg.Order.5LOW()", "RF+"),
]


def _event_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.alphabet(A.trace_events(spark, sf_dir).select("name", "kind").distinct())


def _order_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.alphabet(A.kb_orders(spark, sf_dir).select(F.explode("calls").alias("c")).select("c.name", "c.kind").distinct())


def _models(spark: SparkSession, given: list[tuple[str, str]], syms: DataFrame) -> DataFrame:
    """(api, model, first_sym, max_len) of models written in names. The alphabet is a small dimension."""
    code = {r["name"]: r["sym"] for r in syms.select("name", "sym").collect()}
    rows = []
    for api, words in given:
        text = ""
        for w in words.split():
            name = w.rstrip("+?*")
            text += code.get(name, name) + w[len(name) :]
        tree = P.parse(text)
        rows.append((api, text, P.first_symbol(tree), P.max_length(tree)))
    return spark.createDataFrame(rows, "api string, model string, first_sym string, max_len int")


def _with_firsts(models: DataFrame) -> DataFrame:
    """A row for each symbol that a model can begin with: a choice has several."""
    rows = [(r["model"], sorted(P.first_symbols(r["model"]))) for r in models.select("model").distinct().collect()]  # a dimension
    firsts = models.sparkSession.createDataFrame(rows, "model string, firsts array<string>")
    return models.join(F.broadcast(firsts), "model").select(*[F.explode("firsts").alias(c) if c == "first_sym" else c for c in models.columns])


def _event_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, EVENT_MODELS, _event_symbols(spark, sf_dir))


def _encoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.encode(A.trace_events(spark, sf_dir), _event_symbols(spark, sf_dir))


def _encoded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.encode_calls(A.kb_orders(spark, sf_dir), _order_symbols(spark, sf_dir))


def trace_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_events(spark, sf_dir).select("tid", "enc", F.length("enc").cast("long").alias("n"))


def trace_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    syms = _event_symbols(spark, sf_dir)
    return symbols.decode(symbols.encode(A.trace_events(spark, sf_dir), syms), syms)


def fold_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every user's events folded, one native pass."""
    enc = _encoded_events(spark, sf_dir)
    folded = enc.select("tid", F.length("enc").cast("long").alias("n"), symbols.fold_repeats(F.col("enc")).alias("pattern"))
    return folded.select("tid", "n", "pattern", F.expr("regexp_count(pattern, '[+]')").cast("long").alias("n_folds"))


def fold_single_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_events(spark, sf_dir).select("tid", symbols.fold_runs(F.col("enc")).alias("pattern"))


def fold_multi_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct short realizations and their folded patterns, all passes."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda t: P.fold(t) if t else None)

    return _encoded_orders(spark, sf_dir).select("enc").distinct().select("enc", folded("enc").alias("pattern"))


def log_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = logs.split_bad(logs.thread_lines(A.raw_log(spark, sf_dir)))
    return good.select("ts", "kind", F.col("tid").cast("long").alias("tid"), "state", "name")


def strace_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines, as the collector would write them, parsed."""
    e = A.table(spark, sf_dir, "events")
    ts = F.concat(F.col("event_id").cast("string"), F.lit(".250000"))
    mark = F.concat(F.lit('write(5</dev/null>, "'), F.when(F.col("event_type") == "purchase", "S").otherwise("E"), F.lit(" pkg.A.m()\", 12) = 12"))
    event = F.concat("event_type", F.lit("("), F.col("event_id").cast("string"), F.lit(") = 0"))
    line = F.concat_ws(" ", F.col("user_id").cast("string"), ts, F.when(F.col("event_type").isin("purchase", "signup"), mark).otherwise(event))
    parsed = e.select(logs.parse_strace(F.when(F.col("event_type") == "error", F.lit("?? broken")).otherwise(line)).alias("e")).where("e IS NOT NULL").select("e.*")
    return parsed.select("ts", "kind", F.col("tid").cast("long").alias("tid"), "state", "payload")


def log_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines in time order, printed again, with their place."""
    good, _ = logs.split_bad(A.raw_log(spark, sf_dir))
    kind = F.when(F.col("kind") == "API", "JAVA").otherwise("SYSCALL")
    lines = good.select("ts", logs.format_event(F.col("ts"), kind, F.col("tid"), F.col("state"), F.col("name")).alias("line"))
    return lines.orderBy("ts", "line").select("ts", "line")


def syscall_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = logs.split_bad(A.raw_log(spark, sf_dir))
    return good.where("kind = 'SYS'").groupBy(S.event_name(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("threads"))


def api_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method, class and package of API names, with and without what argument types leak."""
    api = F.concat(F.lit("pkg."), F.col("p_brand"), F.lit(".m"), (F.col("p_size") % 5).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "(java.lang.String, int)").otherwise("()"))
    apis = A.table(spark, sf_dir, "part").select(F.replace(api, F.lit("#"), F.lit("")).alias("api")).distinct()
    c = F.col("api")
    return apis.select("api", S.method_name(c).alias("method"), S.class_name(c).alias("class"), S.package_name(c).alias("package"), S.class_name(c, True).alias("class_compat"))


def trace_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.length_stats(A.kb_orders(spark, sf_dir)).select("api", "total", F.round("mean", 6).alias("mean"), (F.col("mean") > learn.LONG).alias("too_long"))


def straighten_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some are cut in two lines, mended."""
    e = A.table(spark, sf_dir, "events")
    pid = F.lpad(F.col("user_id").cast("string"), 6, "0")
    ts = lambda half: F.concat(F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(half))
    cut = F.col("event_id") % 3 == 0
    name = F.concat("event_type", F.lit("(3, "))
    first = F.concat_ws(" ", pid, ts(".0"), F.when(cut, F.concat(name, F.lit("<unfinished ...>"))).otherwise(F.concat(name, F.lit('"x", 1) = 1'))))
    second = F.concat_ws(" ", pid, ts(".5"), F.concat(F.lit("<... "), "event_type", F.lit(' resumed>"x", 1) = 1')))
    lines = e.select(first.alias("value")).unionByName(e.where(cut).select(second.alias("value")))
    return logs.straighten_pairs(lines)


def straighten_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some halves are lost, mended by the state machine; counts by what became of them."""
    e = A.table(spark, sf_dir, "events")
    pid = F.lpad((F.col("user_id")).cast("string"), 6, "0")
    ts = F.lpad(F.col("event_id").cast("string"), 9, "0")
    text = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("(3, <unfinished ...>"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("<... "), "event_type", F.lit(" resumed>) = 1"))).otherwise(F.concat("event_type", F.lit("() = 0")))
    return logs.straighten(e.select(F.concat_ws(" ", pid, ts, text).alias("value")))


def asof_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as service calls that replace the last view before them."""
    e = A.trace_events(spark, sf_dir).select("tid", "pos", F.col("pos").cast("double").alias("ts"), "name")
    replaced, _ = asof.replace_carriers(e.where("name <> 'purchase'"), e.where("name = 'purchase'").select("tid", "ts", F.concat(F.lit("service"), (F.col("pos") % 7).cast("string")).alias("name")), "view")
    return replaced.select("tid", "pos", "name")


def drop_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_names(A.trace_events(spark, sf_dir), ("error", "signup")).select("tid", "pos", "name")


def drop_allocator_idiom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as the allocator's calls; each user's own address."""
    t = A.trace_events(spark, sf_dir)
    addr = F.concat(F.lit("0x"), F.lower(F.hex((F.col("pos") / 3).cast("long") % 2 + 10)))
    raw = (
        F.when(F.col("name") == "click", F.concat(F.lit("mmap(NULL, 4096, PROT_READ|PROT_WRITE, MAP_PRIVATE|MAP_ANONYMOUS|MAP_NORESERVE, -1, 0) = "), addr))
        .when(F.col("name") == "view", F.concat(F.lit("prctl(PR_SET_VMA, PR_SET_VMA_ANON_NAME, "), addr, F.lit(', 4096, "libc_malloc") = 0')))
        .when(F.col("name").isin("purchase", "signup"), F.concat(F.lit("munmap("), addr, F.lit(", 4096) = 0")))
        .otherwise(F.lit("read(3) = 0"))
    )
    return clean.drop_allocator(t.withColumn("raw", raw)).select("tid", "pos", "name")


def drop_signal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as signals, signups as the return from their handlers."""
    t = A.trace_events(spark, sf_dir).withColumn("raw", F.when((F.col("name") == "error") & (F.col("pos") % 3 == 0), "--- SIGCHLD {} ---").when(F.col("name") == "error", "--- SIGSEGV {} ---").otherwise(F.col("raw"))).withColumn("name", F.when(F.col("name") == "signup", "rt_sigreturn").otherwise(F.col("name")))
    return clean.drop_signal_blocks(t).select("tid", "pos", "name")


def trim_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning of a knowledge base: realization lengths before and after."""
    kb = A.kb_orders(spark, sf_dir).withColumn("calls", F.transform("calls", lambda c: F.struct(c["kind"].alias("kind"), F.when(c["name"] == "AF", "futex(1)").when(c["name"] == "NF", "--- SIGSEGV {} ---").when(c["name"] == "NO", "rt_sigreturn()").otherwise(c["name"]).alias("name"))))
    return clean.prune_kb(kb).select("api", "rid", S.sequence_key(F.col("calls")).alias("seq"))


def first_api_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.first_api(A.trace_brackets(spark, sf_dir))


def _kb_out(kb: DataFrame) -> DataFrame:
    return kb.select("api", "rid", S.sequence_key(F.col("calls")).alias("seq"))


def drop_empty_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = A.kb_graph(spark, sf_dir)
    return _kb_out(clean.drop_callees(kb, kb.groupBy("api").agg(F.max(F.size("calls")).alias("m")).where("m = 0")))


def drop_hanging_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kb_out(clean.drop_hanging(A.kb_graph(spark, sf_dir)))


def bracket_spans_lifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.lifo_spans(A.trace_brackets(spark, sf_dir)).select("tid", "s", "e", "api")


def bracket_spans_first_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.first_end_spans(A.trace_brackets(spark, sf_dir)).select("tid", "s", "e", "api")


def outermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.outermost_spans(A.trace_brackets(spark, sf_dir))


def leaf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.leaf_spans(A.trace_brackets(spark, sf_dir))


def innermost_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.innermost_listed(pairing.lifo_spans(A.trace_brackets(spark, sf_dir))).select("tid", "s", "e", "api")


def _kb_counts(kb: DataFrame) -> DataFrame:
    return kb.groupBy("api", S.sequence_key(F.col("calls")).alias("seq")).agg(F.count(F.lit(1)).alias("n"))


def kb_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kb_counts(attribute.exclusive_nested(A.trace_brackets(spark, sf_dir)))


def kb_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kb_counts(attribute.inclusive_nested(A.trace_brackets(spark, sf_dir)))


def kb_unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of which some lost ends: windows or the stack machine, as each needs."""
    t = A.trace_brackets(spark, sf_dir).where("NOT (kind = 'API' AND state = 'E' AND (tid * 31 + pos) % 11 = 0)")
    return _kb_counts(attribute.knowledge_base(t))


def syscall_to_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute.event_index_of(A.kb_orders(spark, sf_dir)).select("name", F.array_join("apis", ",").alias("apis"))


def api_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.flags(A.kb_orders(spark, sf_dir)).unionByName(callgraph.flags(A.kb_graph(spark, sf_dir)))


def reachable_syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.indirect_sys(A.kb_graph(spark, sf_dir))


def weak_polymorph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.weak_polymorph(A.kb_graph(spark, sf_dir))


def api_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.contingency(A.kb_graph(spark, sf_dir))


def precise_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.precise_models(A.kb_graph(spark, sf_dir, acyclic=True)).select("api", F.array_join("flat", " ").alias("flat"))


def implicit_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.implicit_models(A.kb_graph(spark, sf_dir, acyclic=True)).select("api", F.array_join("flat", " ").alias("flat"))


def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that must hold; the result is empty."""
    kb = A.kb_graph(spark, sf_dir, acyclic=True)
    kb = clean.drop_hanging(kb)
    precise, implicit = callgraph.precise_models(kb), callgraph.implicit_models(kb)
    found = callgraph.invariant_violations(kb, precise, implicit)
    order = match.match_order_violations(_encoded_events(spark, sf_dir), _event_models(spark, sf_dir))
    return found.unionByName(order.select(F.lit("full_is_search_is_all").alias("rule"), "api"))


def model_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.cycles(callgraph.edges(A.kb_graph(spark, sf_dir))).select("api", F.col("length").cast("long").alias("length"))


def models_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.build_models(_encoded_orders(spark, sf_dir), "generic")[0]


def models_less_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.build_models(_encoded_orders(spark, sf_dir), "less_generic")[0]


def model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.build_models(_encoded_orders(spark, sf_dir), "less_generic")[1]


def _order_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, ORDER_MODELS, _order_symbols(spark, sf_dir))


def model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = learn.evaluate(_encoded_orders(spark, sf_dir), _order_models(spark, sf_dir))
    bad = learn.troublesome(stats).withColumn("troublesome", F.lit(True))
    return stats.join(bad, "api", "left").select("api", "successes", "fails", F.round("ratio", 6).alias("fail_ratio"), F.coalesce("troublesome", F.lit(False)).alias("troublesome"))


def corpus_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = learn.success_ratio(learn.evaluate(_encoded_orders(spark, sf_dir), _order_models(spark, sf_dir)))
    return r.select(F.round("success", 6).alias("success"), F.round("fail", 6).alias("fail"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.count_matches(_encoded_orders(spark, sf_dir), _order_models(spark, sf_dir))


def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def local_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.local_rare(_counts(spark, sf_dir), 0.02)


def global_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.global_rare(_counts(spark, sf_dir), 0.02)


def same_model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.same_models(_order_models(spark, sf_dir))


def overlapping_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realizations of other APIs that equal one of an API's, counted by length."""
    return match.overlapping(A.kb_orders(spark, sf_dir)).groupBy("api", "other").agg(F.count(F.lit(1)).alias("n"))


def model_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _event_models(spark, sf_dir)
    leaf = learn.syscall_only(m, _event_symbols(spark, sf_dir)).withColumn("leaf", F.lit(True))
    return m.join(leaf, ["api", "model"], "left").select("api", "model", "first_sym", "max_len", F.coalesce("leaf", F.lit(False)).alias("leaf"))


def align_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.build_aligned(_encoded_orders(spark, sf_dir))


def align_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's flags aligned with those of the API's next order."""
    after = Window.partitionBy("api").orderBy("rid")

    @F.pandas_udf("a string, b string")
    def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([P.align(x, y) for x, y in zip(a, b, strict=True)], columns=["a", "b"])

    pairs = _encoded_orders(spark, sf_dir).withColumn("next", F.lead("enc").over(after)).where("next IS NOT NULL")
    return pairs.select("api", "rid", aligned("enc", "next").alias("x")).select("api", "rid", "x.a", "x.b")


def _ngram_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g, m["api"]) for m in _event_models(spark, sf_dir).collect() for n in range(1, 6) for g in sorted(P.matchable(m["model"], n))]  # models are a handful
    return spark.createDataFrame(rows, "ngram string, api string").distinct()


def matchable_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_labels(spark, sf_dir)


def prefix_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = match.prefix_counts(_encoded_events(spark, sf_dir), _event_models(spark, sf_dir))
    return c.select(F.col("k").cast("long").alias("k"), "n_full", "n_search", "n_all")


def _munched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.munch(_encoded_events(spark, sf_dir), _with_firsts(_event_models(spark, sf_dir)))


def maximal_munch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _munched(spark, sf_dir).select("tid", "s", "e", F.array_join("apis", ",").alias("apis"))


def _true_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled spans: runs of one event."""
    order = Window.partitionBy("tid").orderBy("pos")
    t = A.trace_events(spark, sf_dir)
    run = t.withColumn("new", F.when(F.lag("name").over(order) == F.col("name"), 0).otherwise(1)).withColumn("k", F.sum("new").over(order))
    spans = run.groupBy("tid", "k", "name").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
    api = F.when(F.col("name") == "error", "pkg.B.error()").when(F.col("name") == "view", "pkg.B.view()").when(F.col("name") == "click", "org.C.click()").when(F.col("name") == "signup", "org.D.signs()").otherwise("pkg.X.none()")
    return spans.select("tid", "s", "e", api.alias("api"))


def hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, matches = _true_spans(spark, sf_dir), _munched(spark, sf_dir)
    classes = score.hit_classes(spans, matches, _event_models(spark, sf_dir).select("api"))
    return score.hit_miss(spans, matches).join(classes, "tid")


def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.span_coverage(_true_spans(spark, sf_dir), _munched(spark, sf_dir)).select("tid", "covered", "total", F.round("ratio", 6).alias("ratio"))


def match_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.match_length(_munched(spark, sf_dir)).select("tid", F.round("mean", 6).alias("mean"))


def corpus_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, matches = _true_spans(spark, sf_dir), _munched(spark, sf_dir)
    return score.corpus_averages(score.span_coverage(spans, matches), score.hit_miss(spans, matches)).select(F.round("coverage", 6).alias("coverage"), F.round("correct", 6).alias("correct"))


def coverage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.coverage_steps(pairing.outermost_spans(A.trace_brackets(spark, sf_dir))).select("tid", "x", F.col("y").cast("long").alias("y"))


def trace_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.trace_ambiguity(_munched(spark, sf_dir)).select("tid", "scope", F.round("log10", 6).alias("log10"))


def _ambiguity(spark: SparkSession, sf_dir: str, scope: str = "full") -> DataFrame:
    return score.ngram_ambiguity(_encoded_events(spark, sf_dir), _ngram_labels(spark, sf_dir), scope)


def ngram_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ambiguity(spark, sf_dir).select("ngram", F.col("n").cast("long").alias("n"), "n_apis", "freq", "effective")


def ambiguity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for scope in ("full", "method", "class", "package"):
        part = _ambiguity(spark, sf_dir, scope).select(F.lit(scope).alias("scope"), "ngram", "n_apis", "effective")
        out = part if out is None else out.unionByName(part)
    return out


def ambiguity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.hist(_ambiguity(spark, sf_dir)).select(F.col("n").cast("long").alias("n"), "k", "count")


def ambiguity_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.cdf(_ambiguity(spark, sf_dir)).select(F.col("n").cast("long").alias("n"), "k", "cum", F.round("scaled", 6).alias("scaled"))


def ambiguity_fullcdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, labels = _encoded_events(spark, sf_dir), _ngram_labels(spark, sf_dir)
    loose = None
    for n in range(1, 6):
        part = score.unmatched_starts(enc, labels, n).withColumn("n", F.lit(n))
        loose = part if loose is None else loose.unionByName(part)
    return score.fullcdf(_ambiguity(spark, sf_dir), loose).select(F.col("n").cast("long").alias("n"), "k", "cum", F.round("scaled", 6).alias("scaled"))


def noise_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning with the known fault: each thread's first row is there twice."""
    return clean.remove_noise(A.trace_events(spark, sf_dir), ("error",), compat_dup_head=True).select("tid", "pos", "name")


def java_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_java(A.raw_log(spark, sf_dir)).select("value")


def signal_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = A.kb_orders(spark, sf_dir).withColumn("calls", F.transform("calls", lambda c: F.struct(c["kind"].alias("kind"), F.when(c["name"] == "NF", "--- SIGSEGV {} ---").otherwise(c["name"]).alias("name"))))
    return _kb_out(clean.drop_signals(kb))


def events_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_calls(A.trace_brackets(spark, sf_dir)).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def modelless_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends of the APIs of two models, and all events."""
    known = spark.sql("SELECT * FROM VALUES ('pkg.Order.1URGENT()'), ('pkg.Order.5LOW()'), (NULL) AS v(api)")
    left = clean.drop_modelless(A.trace_brackets(spark, sf_dir), known)
    return left.groupBy("tid").agg(F.count_if(F.col("kind") == "API").alias("n_calls"), F.count_if(F.col("kind") == "SYS").alias("n_events"))


def api_call_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.call_names(A.kb_orders(spark, sf_dir))


def sharing_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.sharing(_order_models(spark, sf_dir), "pkg.Order.1URGENT()")


def model_owner_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _order_models(spark, sf_dir)
    text = _models(spark, [("", "NO")], _order_symbols(spark, sf_dir)).first()["model"]
    return learn.model_owners(models, text)


def models_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.numbered(_order_models(spark, sf_dir)).select("api", "model", F.col("model_id").cast("long").alias("model_id"))


def model_eval_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation with a bound of time for each match, and which APIs are expensive."""
    stats = learn.evaluate_timed(_encoded_orders(spark, sf_dir), _order_models(spark, sf_dir))
    dear = learn.expensive(stats).select("api", F.lit(True).alias("expensive"))
    return stats.join(dear, "api", "left").select("api", "successes", "fails", "timeouts", F.coalesce("expensive", F.lit(False)).alias("expensive"))


def full_match_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realizations of orders that a model of any API matches whole."""
    enc = _encoded_orders(spark, sf_dir).select(F.col("rid").alias("tid"), "enc")
    return match.full_matches(enc, _with_firsts(_order_models(spark, sf_dir))).distinct()


def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.searches(_encoded_events(spark, sf_dir), _with_firsts(_event_models(spark, sf_dir))).distinct()


def all_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.occurrences(_encoded_events(spark, sf_dir), _with_firsts(_event_models(spark, sf_dir))).distinct()


def occurrence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all occurrences, summed up by thread and model."""
    spans = match.occurrence_spans(_encoded_events(spark, sf_dir), _with_firsts(_event_models(spark, sf_dir))).distinct()
    return spans.groupBy("tid", "api", "model").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"), F.sum(F.col("e") - F.col("s")).cast("long").alias("covered"))


def whole_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over bracketed threads and the order models: hits, coverage and mean match of every thread."""
    syms = _order_symbols(spark, sf_dir)
    found = pipelines.analyse(A.trace_brackets(spark, sf_dir), _with_firsts(_order_models(spark, sf_dir)), syms)
    rows = found["hits"].join(found["coverage"], "tid", "left").join(found["length"], "tid", "left")
    return rows.select("tid", "hits", "misses", "covered", "total", F.round("ratio", 6).alias("ratio"), F.round("mean", 6).alias("mean"))


def whole_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ambiguity of the same threads, from their first call on."""
    found = pipelines.ambiguity_of(A.trace_brackets(spark, sf_dir), _with_firsts(_order_models(spark, sf_dir)), _order_symbols(spark, sf_dir))
    return found.select("tid", "scope", F.round("log10", 6).alias("log10"))


def permission_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apps (customers) whose comma-joined permissions, with their prefix where it is missing, have a dangerous one."""
    c = A.table(spark, sf_dir, "customer")
    given = F.concat(F.upper(F.replace(F.trim("c_mktsegment"), F.lit(" "), F.lit("_"))), F.lit(",android.permission.P"), (F.col("c_nationkey") % 4).cast("string"))
    held = c.select(F.col("c_custkey").alias("app"), F.explode(F.split(given, ",")).alias("p")).select("app", S.full_permission(F.col("p")).alias("permission"))
    dangerous = spark.sql("SELECT * FROM VALUES ('MACHINERY'), ('P3') AS v(name)")
    return held.withColumn("name", S.permission_tail(F.col("permission"))).join(dangerous, "name", "left_semi").select("app").distinct()


_NAMES = """trace_encode trace_decode_roundtrip fold_patterns fold_single_runs fold_multi_pass log_parse_events strace_parse log_sorted
syscall_histogram api_rollups trace_length_stats straighten_pairs straighten_exact asof_replace drop_noise drop_allocator_idiom drop_signal_blocks
trim_noise first_api_index drop_empty_callees drop_hanging_callees bracket_spans_lifo bracket_spans_first_end outermost_spans leaf_spans
innermost_listed kb_exclusive kb_inclusive kb_unwind syscall_to_apis api_flags reachable_syscalls weak_polymorph api_contingency precise_models
implicit_models invariant_violations model_cycles models_generic models_less_generic model_stats model_eval corpus_success model_counts
local_rare global_rare same_model_pairs overlapping_traces model_properties align_learn align_pair matchable_ngrams prefix_match_counts
maximal_munch hit_miss span_coverage match_length corpus_averages coverage_steps trace_ambiguity ngram_ambiguity ambiguity_scope ambiguity_hist
ambiguity_cdf ambiguity_fullcdf permission_filter noise_removed java_lines_dropped signal_lines_dropped events_only modelless_dropped
api_call_names sharing_apis model_owner_apis models_numbered model_eval_timed full_match_threads first_occurrences all_occurrences occurrence_totals
whole_analysis whole_ambiguity""".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES}
