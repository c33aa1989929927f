"""Call attribution over streams: the stack machine of a thread is its state.

Events arrive in micro-batches; each thread's open calls are kept between them, and a realization is emitted when its
call ends. State times out when a thread stays silent, so threads that never end don't stay forever.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.operators.attribute import ExclusiveMachine, InclusiveMachine
from spanforge.operators.clean import EMPTY_CALLS

OUTPUT = f"tid long, api string, seq long, calls {EMPTY_CALLS}"


def attribute_stream(events: DataFrame, inclusive: bool = False, silence: str | None = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(tid, api, seq, calls) of a stream of events (tid, ts, pos, kind, state, raw), ts a timestamp.

    Events of a thread must arrive in order across batches; within a batch they are sorted by pos. seq numbers a
    thread's realizations. After `silence` of event time a thread's open calls are dropped; None keeps them.
    """
    machine_of = InclusiveMachine if inclusive else ExclusiveMachine

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine, seq = machine_of(), 0
        if state.exists:
            saved, seq = state.get
            machine.frames = [(a, [tuple(c) for c in calls]) for a, calls in json.loads(saved)]
        rows = []
        batch = pd.concat(list(frames)).sort_values("pos")
        for kind, mark, raw in zip(batch["kind"], batch["state"], batch["raw"], strict=True):
            for api, calls in machine.step(kind, mark, raw):
                rows.append((key[0], api, seq, [{"kind": k, "name": n} for k, n in calls]))
                seq += 1
        state.update((json.dumps(machine.frames), seq))
        if silence is not None:
            state.setTimeoutTimestamp(max(int(batch["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(pd.Timedelta(silence).total_seconds() * 1000))
        yield pd.DataFrame(rows, columns=["tid", "api", "seq", "calls"])

    stream = events.withWatermark("ts", watermark) if silence is not None else events
    timeout = GroupStateTimeout.EventTimeTimeout if silence is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy(F.col("tid").cast("long").alias("tid")).applyInPandasWithState(run, OUTPUT, "frames string, seq long", "append", timeout)


def folded_rates(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(window, name, n): events by name in tumbling windows of event time; late ones beyond the watermark are dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "name").agg(F.count(F.lit(1)).alias("n"))
