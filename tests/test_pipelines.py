"""Whole runs on a small log."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import scalars as S
from spanforge.operators import patterns as P
from spanforge.plans import pipelines
from spanforge.sources import logs

LOG = """7 1.0 open(1) = 0
7 2.0 write(5</dev/null>, "S p.A.m()", 12) = 12
7 3.0 read(3, <unfinished ...>
7 3.5 <... read resumed>"x", 1) = 1
7 4.0 write(5</dev/null>, "S p.B.n()", 12) = 12
7 5.0 ioctl(4</dev/binder>, 1) = 0
7 6.0 write(5</dev/null>, "E p.B.n()", 12) = 12
7 7.0 write(5</dev/null>, "E p.A.m()", 12) = 12
9 1.5 close(3) = 0
"""


def _names(kb):
    return {r["api"]: [c["name"] for c in r["calls"]] for r in kb.collect()}


def test_log_to_models_and_scores(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    out = str(tmp_path / "kb")
    kb = pipelines.build_kb(spark, str(tmp_path / "log"), out=out)
    assert _names(kb) == {"START": ["open(1) = 0"], "p.A.m()": ['read(3,"x", 1) = 1', "p.B.n()"], "p.B.n()": ["ioctl(4</dev/binder>, 1) = 0"]}
    flat = pipelines.build_kb(spark, str(tmp_path / "log"), tree=False)
    assert _names(flat)["p.A.m()"] == ['read(3,"x", 1) = 1', "ioctl(4</dev/binder>, 1) = 0"]
    services = spark.createDataFrame([(7, 5.5, "svc.X")], "tid int, ts double, name string")
    assert _names(pipelines.build_kb(spark, str(tmp_path / "log"), services=services))["p.B.n()"] == ["svc.X"]

    run = pipelines.first_run(pipelines.rid_kb(kb))
    assert run["violations"].count() == 0 and {r["api"]: r["flat"] for r in run["precise"].collect()}["p.A.m()"] == ["read", "ioctl"]
    models, stats = pipelines.create_models(run["kb"], run["symbols"])
    assert stats.count() == 3
    trace = logs.as_trace(pipelines.typed_events(spark, str(tmp_path / "log")))
    scores = pipelines.analyse(trace, models, run["symbols"])
    assert scores["matches"].count() > 0 and scores["coverage"].first()["total"] > 0
    assert pipelines.ambiguity_of(trace, models, run["symbols"]).count() > 0
    pipelines.dump_matches(spark.createDataFrame([("ab", "X"), ("ab", "Y")], "ngram string, api string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()["value"] == "ab X,Y"
    pipelines.dump_ambiguity(spark.createDataFrame([("ab", 3, 10, 20)], "ngram string, n_apis int, freq int, effective int"), str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).first()["value"] == "ab 2 10 20"


def test_pattern_algebra(spark):
    aligned = P.parse_aligned("^(a|b)c?$")
    assert aligned == [(frozenset("ab"), P.MANDATORY), (frozenset("c"), P.OPTIONAL)] and P.aligned_text(P.conditional(aligned)) == "(a|b)?c?"
    assert P.fold_flagged_runs("aabb?c?c?d") == "a+b+c*d"
    assert P.inline("xAy", {"A": ["b+"]}) == "x(b+)y" and P.inline("A", {"A": ["bA"]}) == "(bA)"
    assert P.loop("A", {"A": ["xB"], "B": ["yA"]}) == ["A", "B", "A"] and P.loop("A", {"A": ["x"]}) is None
    r = spark.range(1).select(S.api_identifier(F.lit("p"), F.lit("A"), F.lit("m"), F.array(F.lit("int"), F.lit("X"))).alias("a"), S.listed_api(F.lit("public void p.A.m(int, X) throws Y")).alias("b")).first()
    assert tuple(r) == ("p.A.m(int, X)", "p.A.m(int, X)")
