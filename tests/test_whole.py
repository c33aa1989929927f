"""Whole results of the trace engine: what its queries once cut short."""

from __future__ import annotations

from spanforge.operators import callgraph
from spanforge.plans.queries import QUERIES


def test_long_cycles_are_found(spark):
    edges = [(f"a{i}", f"a{(i + 1) % 14}") for i in range(14)] + [("b", "a0"), ("c", "c")]
    got = {r["api"]: r["length"] for r in callgraph.cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"c": 1, **{f"a{i}": 14 for i in range(14)}}


def test_straighten_reads_all_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type").collect()
    want, pending = [], {}
    for e in sorted(events, key=lambda e: e["event_id"]):
        user, name = e["user_id"], e["event_type"]
        head = f"{user:06d} {e['event_id']:09d} "
        if e["event_id"] % 3 == 0:
            pending.setdefault(user, (head, name))
        elif e["event_id"] % 3 == 1:
            if user in pending and (cut := pending.pop(user))[1] == name:
                want.append(cut[0] + name + "(3,) = 1")
        elif user not in pending:
            want.append(head + name + "() = 0")
    assert sorted(r["value"] for r in QUERIES["straighten_exact"](spark, sf_dir).collect()) == sorted(want)
