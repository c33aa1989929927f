"""The trace engine's operators on worked examples and properties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import scalars as S
from spanforge.operators import asof, attribute, callgraph, clean, learn, match, pairing, score, symbols
from spanforge.operators import patterns as P
from spanforge.sources import logs, store

TRACE = "tid long, pos long, kind string, state string, name string, raw string"
KB = "api string, rid long, calls array<struct<kind:string,name:string>>"


def trace(spark, text: str, tid: int = 7):
    """"S A, a, E A" as a trace; lower case is an event."""
    rows = []
    for i, x in enumerate(y.strip() for y in text.split(",") if y.strip()):
        parts = x.split(" ", 1)
        api = parts[0] in ("S", "E") and len(parts) == 2
        rows.append((tid, i, "API" if api else "SYS", parts[0] if api else None, parts[1] if api else x.split("(")[0], parts[1] if api else x))
    return spark.createDataFrame(rows, TRACE)


def found(kb) -> list:
    return sorted((r["api"], r["seq"], [(c["kind"], c["name"]) for c in r["calls"]]) for r in kb.collect())


def plain(kb) -> list:
    return sorted((r["api"], " ".join(("API " if c["kind"] == "API" else "") + c["name"] for c in r["calls"])) for r in kb.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a, S A, b, S B, c, E B, d, E A, e, S C, E C, f", [("A", "b API B d"), ("B", "c"), ("C", ""), ("NOAPI", "e"), ("START", "a")]),
        ("S A, a, S B, b, E A", [("B", "b"), ("START", "")]),
        ("S A, a, E Z", [("A", "a"), ("NOAPI", ""), ("START", "")]),
    ],
)
def test_exclusive_attribution(spark, text, want):
    assert plain(attribute.attribute_exact(trace(spark, text))) == want
    assert plain(attribute.knowledge_base(trace(spark, text))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a, S A, b, S B, c, E B, d, E A, e, S C, E C, f", [("A", "b c d"), ("B", "c"), ("C", ""), ("NOAPI", "e"), ("START", "a")]),
        ("S A, a, S B, b, E A", [("B", "b"), ("START", "")]),
    ],
)
def test_inclusive_attribution(spark, text, want):
    assert plain(attribute.attribute_exact(trace(spark, text), inclusive=True)) == want
    assert plain(attribute.knowledge_base(trace(spark, text), inclusive=True)) == want


def _random_nested(rng: random.Random) -> str:
    out: list[str] = []
    stack: list[str] = []
    for _ in range(rng.randint(2, 30)):
        x = rng.random()
        if x < 0.35:
            stack.append(rng.choice("ABC"))
            out.append(f"S {stack[-1]}")
        elif x < 0.6 and stack:
            out.append(f"E {stack.pop()}")
        else:
            out.append(rng.choice("xyz"))
    return ", ".join(out + [f"E {a}" for a in reversed(stack)])


@pytest.mark.parametrize("inclusive", [False, True])
def test_windows_equal_the_machine(spark, inclusive):
    rng = random.Random(4)
    all_threads = None
    for tid in range(40):
        t = trace(spark, _random_nested(rng), tid)
        all_threads = t if all_threads is None else all_threads.unionByName(t)
    all_threads = spark.createDataFrame(all_threads.collect(), TRACE)
    native = (attribute.inclusive_nested if inclusive else attribute.exclusive_nested)(all_threads)
    assert plain(native) == plain(attribute.attribute_exact(all_threads, inclusive))


def test_spans(spark):
    t = trace(spark, "S A, x, S A, y, E A, z, E A")
    assert sorted(tuple(r)[1:4] for r in pairing.lifo_spans(t).collect()) == [(0, 3, "A"), (1, 2, "A")]
    assert sorted(tuple(r)[1:4] for r in pairing.first_end_spans(t).collect()) == [(0, 2, "A"), (1, 2, "A")]
    assert [tuple(r)[1:4] for r in pairing.innermost_listed(pairing.lifo_spans(t)).collect()] == [(1, 2, "A")]
    assert [tuple(r)[1:] for r in pairing.outermost_spans(t).collect()] == [(0, 3)]
    assert [tuple(r)[1:] for r in pairing.outermost_spans_exact(t).collect()] == [(0, 3)]
    assert {r["api"] for r in pairing.leaf_spans(trace(spark, "S A, S B, x, E B, E A, S C, E C, S D, y")).collect()} == {"B", "D"}


def test_lifo_pairing_equals_stacks(spark):
    rng = random.Random(9)
    texts = {tid: [rng.choice(["S A", "E A", "S B", "E B", "x"]) for _ in range(rng.randint(1, 25))] for tid in range(60)}
    rows, want = [], []
    for tid, xs in texts.items():
        open_at: dict[str, list[int]] = {"A": [], "B": []}
        idx = 0
        for i, x in enumerate(xs):
            if x == "x":
                rows.append((tid, i, "SYS", None, "x", "x"))
                idx += 1
                continue
            state, api = x.split()
            rows.append((tid, i, "API", state, api, api))
            if state == "S":
                open_at[api].append(idx)
            elif open_at[api] and (s := open_at[api].pop()) != idx:
                want.append((tid, s, idx, api))
    got = [tuple(r)[:4] for r in pairing.lifo_spans(spark.createDataFrame(rows, TRACE)).collect()]
    assert sorted(got) == sorted(want)


def test_union_of_spans(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 3), (1, 5, 7), (1, 9, 10)], "tid long, s long, e long")
    assert sorted(tuple(r) for r in pairing.union_spans(df).collect()) == [(1, 0, 7), (1, 9, 10)]


def test_allocator_idiom(spark):
    m = "mmap(NULL, 4096, PROT_READ|PROT_WRITE, MAP_PRIVATE|MAP_ANONYMOUS|MAP_NORESERVE, -1, 0) = 0x7a"
    p = 'prctl(PR_SET_VMA, PR_SET_VMA_ANON_NAME, 0x7a, 4096, "libc_malloc") = 0'
    raws = [m, p, "munmap(0x7a, 4096) = 0", "munmap(0x90, 1) = 0", "read(3) = 0", m, p, "read(4) = 0", m, "read(5) = 0"]
    t = spark.createDataFrame([(1, i, "SYS", None, r.split("(")[0], r) for i, r in enumerate(raws)], TRACE)
    assert [r["pos"] for r in clean.drop_allocator(t).orderBy("pos").collect()] == [4, 7, 8, 9]


def test_signal_blocks(spark):
    raws = ["open", "--- SIGSEGV {} ---", "mprotect", "--- SIGBUS {} ---", "rt_sigreturn", "read", "--- SIGCHLD {} ---", "--- SIGSEGV {} ---", "tail"]
    t = spark.createDataFrame([(1, i, "SYS", None, r, r) for i, r in enumerate(raws)], TRACE)
    assert [r["raw"] for r in clean.drop_signal_blocks(t).orderBy("pos").collect()] == ["open", "read", "--- SIGCHLD {} ---"]


def test_noise_and_first_call(spark):
    t = trace(spark, "futex, read, write")
    assert [r["name"] for r in clean.remove_noise(t).orderBy("pos").collect()] == ["read", "write"]
    assert [r["name"] for r in clean.remove_noise(t, compat_dup_head=True).orderBy("pos").collect()] == ["read", "read", "write"]
    assert clean.first_api(trace(spark, "x, S A, y")).first()["first"] == 1 and clean.first_api(trace(spark, "x")).first()["first"] == -1


def test_lines():
    assert logs.mend(["1 1.0 read(3, <unfinished ...>", '1 1.5 <... read resumed>"x", 1) = 1']) == ['1 1.0 read(3,"x", 1) = 1']
    assert logs.mend(["1 1.0 <... read resumed>x"]) == [] and logs.mend(["1 1.0 a( <unfinished ...>", "1 1.1 b()", "1 1.2 +++ killed +++"]) == ["1 1.0 a( <unfinished ...>", "1 1.2 +++ killed +++"]
    assert logs.mend(["1 1.0 a( <unfinished ...>", "1 1.1 <... b resumed>)"]) == []


def test_parsing(spark):
    lines = spark.createDataFrame([("1.5 JAVA 7 S p.A.m()",), ("1.6 SYSCALL 7 read(3) = 0",), ("broken",)], "value string")
    good, bad = logs.split_bad(lines)
    assert sorted(tuple(r) for r in good.collect()) == [(1.5, "API", 7, "S", "p.A.m()"), (1.6, "SYS", 7, None, "read(3) = 0")] and bad.count() == 1
    raw = spark.createDataFrame([('4437  11.218684 write(53</dev/null>, "S p.A.m()", 32) = 32',), ("2016  10.977124 munmap(0x75, 8192) = 0",), ("?",)], "value string")
    got = [r["e"] for r in raw.select(logs.parse_strace(F.col("value")).alias("e")).collect()]
    assert tuple(got[0]) == (11.218684, "JAVA", 4437, "S", "p.A.m()") and tuple(got[1]) == (10.977124, "SYSCALL", 2016, None, "munmap(0x75, 8192) = 0") and got[2] is None


def test_names(spark):
    c = F.col("a")
    r = spark.createDataFrame([("a.B.m(java.X)",)], "a string").select(S.method_name(c), S.class_name(c), S.package_name(c), S.class_name(c, True)).first()
    assert tuple(r) == ("m", "a.B", "a", "a.B.m(java")


@pytest.mark.parametrize(("text", "want"), [("aaabab", "a+bab"), ("ababab", "(ab)+"), ("aabaab", "(a+b)+"), ("abc", "abc"), ("ababcababc", "(ab)+c(ab)+c")])
def test_folding(text, want):
    assert P.fold(text) == want and P.Machine(want).full(text)


def test_folds_match_what_they_fold():
    import re

    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        f = P.fold(s)
        assert f is None or (re.fullmatch(f, s) and P.Machine(f).full(s) and P.render(P.parse(f)) == f)
        at = rng.randint(0, len(s))
        if f:
            m = re.compile(f).match(s, at)
            assert P.Machine(f).longest(s, at) >= (m.end() if m else -1)


def test_matchable_and_alignment():
    assert P.matchable("ab+", 3) == {"abb"} and P.matchable("ab+", 1) == set() and P.matchable("a+b+", 3) == {"aab", "abb"}
    assert P.from_pair("ab-", "a-c") == [(frozenset("a"), 0), (frozenset("b"), 1), (frozenset("c"), 1)]
    assert P.align("", "ab") == ("--", "ab")
    rng = random.Random(2)
    for _ in range(300):
        learn.learn_aligned(["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 12))])


def test_learning_on_a_second_witness(spark):
    learned, test = learn.learn_less_generic(["aab", "aaab", "aaaab", "ac", "b", "c"])
    assert [(m, g) for m, g, _ in learned.models] == [("a+b", True), ("ac", False)] and learned.redundant == 1 and test == ["b", "c"]
    enc = spark.createDataFrame([("A", i, s) for i, s in enumerate(["aab", "aaab", "", "b"])] + [("B", 1, "")], "api string, rid long, enc string")
    models, stats = learn.build_models(enc, "generic")
    assert {r["api"] for r in models.collect()} == {"A"} and stats.collect()[0]["empty_allowed"]


def _models(spark, *pairs):
    return spark.createDataFrame([(a, m, P.first_symbol(P.parse(m))) for a, m in pairs], "api string, model string, first_sym string")


def test_munch_and_scores(spark):
    enc = spark.createDataFrame([(1, "abbac"), (2, ""), (3, "zzz")], "tid long, enc string")
    m = _models(spark, ("X", "ab+"), ("Y", "a"), ("Z", "abb"))
    got = match.munch(enc, m)
    want = [(1, 0, 3, ["X", "Z"]), (1, 3, 4, ["Y"])]
    assert sorted(tuple(r) for r in got.select("tid", "s", "e", "apis").collect()) == want
    assert sorted(tuple(r) for r in match.chain(match.best(match.candidates(enc, m))).collect()) == want
    spans = spark.createDataFrame([(1, 0, 3, "X"), (1, 3, 4, "W"), (1, 4, 5, "Y")], "tid long, s long, e long, api string")
    assert tuple(score.hit_miss(spans, got).first()) == (1, 1, 2)
    assert score.span_coverage(spans, got).first()["ratio"] == pytest.approx(0.6)
    labels = spark.createDataFrame([(1, 0, 3, ["p.A.m()", "p.B.m()"]), (1, 3, 4, ["p.A.n()"])], "tid long, s long, e long, apis array<string>")
    assert {r["scope"]: r["ambiguity"] for r in score.trace_ambiguity(labels).collect()} == {"full": 2, "class": 2, "package": 1, "method": 1}
    assert match.expected_ratio(spans, spans.limit(0)).first()["ratio"] == 0 and match.expected_ratio(spans.limit(0), spans).first()["ratio"] is None


def test_munch_equals_a_scan(spark):
    rng = random.Random(8)
    models = [("A", "ab+"), ("B", "(ab)+"), ("C", "b"), ("D", "ca"), ("E", "c+a"), ("F", "(a|ab)c?"), ("G", "(b|bc|bca)")]
    texts = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = match.munch(spark.createDataFrame(texts, "tid long, enc string"), _models(spark, *models))
    want = [(t, s, e, apis) for t, x in texts for s, e, apis in match.munch_one(x, [(a, m, P.first_symbol(P.parse(m))) for a, m in models])]
    assert sorted(tuple(r) for r in got.select("tid", "s", "e", "apis").collect()) == sorted(want)
    joined = match.chain(match.best(match.candidates(spark.createDataFrame(texts, "tid long, enc string"), _models(spark, *models))))
    assert sorted(tuple(r) for r in joined.collect()) == sorted(want)


def test_matches_that_take_too_long_count_as_none(spark):
    enc = spark.createDataFrame([("X", "a" * 60 + "b"), ("X", "aa")], "api string, enc string")
    stats = learn.evaluate_timed(enc, _models(spark, ("X", "(a|aa)+")), timeout=0.2)
    assert tuple(stats.first()) == ("X", 1, 0, 1) and learn.expensive(stats).first()["ratio"] == 0.5


def test_self_overlapping_ngrams_are_counted_from_the_left(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    grams = ["a", "aa", "aba", "ab", "abab", "bba", "zz"]
    got = score.ngram_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tid long, enc string"), spark.createDataFrame([(g,) for g in grams], "ngram string"))
    assert {r["ngram"]: r["freq"] for r in got.collect()} == {g: sum(t.count(g) for t in texts) for g in grams if any(g in t for t in texts)}


def test_full_distribution(spark):
    a = spark.createDataFrame([("x", 1, 1, 6), ("y", 1, 2, 2)], "ngram string, n int, n_apis long, freq long")
    loose = spark.createDataFrame([(1, 2)], "n int, unmatched long")
    assert [(r["k"], r["cum"], r["scaled"]) for r in score.fullcdf(a, loose).orderBy("k").collect()] == [(0, 2, 20.0), (1, 8, 80.0), (2, 10, 100.0)]


def test_rarity(spark):
    counts = spark.createDataFrame([("A", "m", 0, 200), ("B", "m", 1, 200), ("C", "m", 100, 200), ("A", "k", 0, 200)], "api string, model string, n long, total long")
    assert {(r["api"], r["model"]) for r in learn.local_rare(counts).collect()} == {("A", "m"), ("B", "m"), ("A", "k")}
    assert [r["model"] for r in learn.global_rare(counts).collect()] == ["k"]


def kb_of(spark, given: dict[str, list[list[str]]]):
    return spark.createDataFrame([(a, i, [("API" if c.isupper() else "SYS", c) for c in r]) for a, rs in given.items() for i, r in enumerate(rs)], KB)


def test_call_graph(spark):
    kb = kb_of(spark, {"A": [["B", "x"]], "B": [["y"], ["z"]], "C": [["C", "D"]], "D": [[]], "E": [["D", "futex", "w"]], "F": [["G"]]})
    f = {r["api"]: r for r in callgraph.all_flags(kb).collect()}
    assert f["A"]["weak"] and not f["A"]["polymorph"] and f["B"]["polymorph"] and f["D"]["empty"] and f["A"]["indirect_sys"] and not f["C"]["indirect_sys"]
    assert {r["api"]: r["flat"] for r in callgraph.precise_models(kb).collect()} == {"D": [], "E": ["w"]}
    assert {r["api"]: r["flat"] for r in callgraph.implicit_models(kb).collect()} == {"D": []}
    assert [tuple(r) for r in callgraph.cycles(callgraph.edges(kb)).collect()] == [("C", 1)]
    left = {(r["api"], r["rid"]): [c["name"] for c in r["calls"]] for r in clean.drop_hanging(kb).collect()}
    assert left[("F", 0)] == [] and left[("A", 0)] == ["B", "x"]
    assert {(r["api"], r["rid"]): [c["name"] for c in r["calls"]] for r in callgraph.without_empties(kb).collect()}[("E", 0)] == ["futex", "w"]


def test_asof(spark):
    e = spark.createDataFrame([(1, 1.0, 0, "ioctl"), (1, 2.0, 1, "read"), (1, 3.0, 2, "ioctl"), (2, 1.0, 0, "read")], "tid long, ts double, pos long, name string")
    s = spark.createDataFrame([(1, 1.5, "svc.A"), (1, 3.5, "svc.late"), (2, 1.0, "svc.none")], "tid long, ts double, name string")
    replaced, lost = asof.replace_carriers(e, s, "ioctl")
    assert sorted((r["tid"], r["pos"], r["name"]) for r in replaced.collect()) == [(1, 0, "svc.A"), (1, 1, "read"), (1, 2, "ioctl"), (2, 0, "read")]
    assert sorted(r["name"] for r in lost.collect()) == ["svc.late", "svc.none"]


def test_symbols_round_trip(spark):
    t = trace(spark, "b, a, b, c")
    syms = symbols.alphabet(t.select("name", "kind").distinct())
    assert [r["name"] for r in symbols.decode(symbols.encode(t, syms), syms).orderBy("pos").collect()] == ["b", "a", "b", "c"]
    many = symbols.alphabet(spark.range(25_000).selectExpr("'API' AS kind", "concat('n', lpad(id, 6, '0')) AS name"))
    assert many.select(F.count_distinct("sym"), F.max(F.length("sym"))).first() == (25_000, 1)


def test_tables(spark, tmp_path):
    path = str(tmp_path / "done")
    todo = spark.createDataFrame([(1,), (2,)], "id long")
    assert store.open_or_create(spark, path, "id long").count() == 0
    seen = []
    work = lambda df: (seen.append(df.count()), df)[1]
    assert store.resumed(spark, path, todo, ["id"], work, "id long").count() == 2
    assert store.resumed(spark, path, todo.unionByName(spark.range(3, 4)), ["id"], work, "id long").count() == 3
    assert seen == [2, 1]
    assert store.memoized(spark, str(tmp_path / "m"), lambda: todo).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from spanforge.streaming.attribution import attribute_stream

    t = trace(spark, "a, S A, b, S B, c, E B, d, E A, e, S C, E C, f").withColumn("ts", F.timestamp_seconds(F.col("pos") + 1_700_000_000))
    for i, (low, high) in enumerate([(0, 4), (4, 7), (7, 12)]):
        t.where((F.col("pos") >= low) & (F.col("pos") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = attribute_stream(stream).writeStream.format("memory").queryName("kb").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    assert plain(spark.table("kb")) == plain(attribute.attribute_exact(t))
